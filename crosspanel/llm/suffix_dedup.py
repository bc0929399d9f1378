"""Repeated byte strings across documents (operator 5).

Removed is each byte covered by a SPAN-byte string that also starts in a document with a smaller doc_id. Since only the
first SPAN bytes of a suffix matter, the difference-cover idea is used with a cover chosen by content, so that it needs
no order of all suffixes:

* Sample: of every SPAN-byte window, one K-byte string at a place that depends on the window alone (the least hash).
  Equal windows have equal samples at equal places, which is what a difference cover is for.
* Names: samples are sorted and named in hash buckets, and named again with all bytes of the windows they stand for. If
  those are equal too, the first document with them settles all these windows. If no other document has the sample, or
  none with a smaller id, the windows stay.
* Merge: only windows of samples whose surroundings differ are left. They are sorted by their own hash, and neighbours
  that are equal show the first document that has them.

Chunks send their distinct samples and windows to hash buckets and get flags back, so a string that a third of all
documents hold reaches its bucket once from each chunk. Names are hashes of 64 bits and more, as in the other operators.

Defined cases: a null or empty text has no bytes; texts below SPAN bytes lose nothing; equal doc_ids are not smaller
than each other; documents with null ids neither lose bytes nor take them from others; repeated rows give repeated
rows; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crosspanel.llm import chunks as C
from crosspanel.llm.common import arrow_rows, stored
from crosspanel.llm.near_dup import MIX, mixed

SPAN, K = 50, 20
#: Text in a chunk; hashes of all its positions are some 20 times as large.
CHUNK_BYTES = 3 << 20
KEEP, GONE, OPEN = 0, 1, 2


#: A number for each byte, and for each doubling an odd factor of the left half, which has remainder 3 by 4.
BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * MIX)
FACTORS = mixed(np.arange(1001, 1065, dtype=np.uint64) * MIX) | np.uint64(3)


def rolling(a: np.ndarray, size: int, have: dict[int, np.ndarray]) -> np.ndarray:
    """Hashes of all strings of `size` bytes: sums of the bytes' numbers times factors by place, mixed once at the end.
    They come from those of half the size; `have` keeps powers of two."""
    n, power, level = len(a) - size + 1, 1, 0
    if 1 not in have:
        have[1] = BYTES[a]
    while 2 * power <= size:
        h = have[power]
        if 2 * power not in have:
            made = h[: len(h) - power] * FACTORS[level]
            made += h[power:]
            have[2 * power] = made
        power, level = 2 * power, level + 1
    h = have[power]
    made = h[:n] * FACTORS[level + 16]
    made += h[size - power : size - power + n]
    return mixed(made) + np.uint64(size)


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of its least one, the first of equals."""
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    rest = width - span
    key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Chunk:
    """Windows of a chunk's documents, grouped by the sample they share."""

    def __init__(self, data: bytes):
        self.ids, self.texts = C.texts_in(data)
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        a = np.frombuffer(b"".join(self.texts), np.uint8)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.n = len(a)
        self.order = np.array([i if i is not None else 0 for i in self.ids], np.int64)
        self.first = np.zeros(0, np.int64)
        if self.n < SPAN:
            self.last = self.doc = self.first
            self.samples = self.around = self.windows = np.zeros(0, np.uint64)
            return
        have: dict[int, np.ndarray] = {}
        small, self.windows = rolling(a, K, have), rolling(a, SPAN, have)
        have.clear()
        valid = (doc[: self.n - SPAN + 1] == doc[SPAN - 1 :]) & np.array([i is not None for i in self.ids])[doc[: self.n - SPAN + 1]]
        place = least_in_windows(small, SPAN - K + 1)[: self.n - SPAN + 1]
        starts = np.flatnonzero(valid)
        cut = np.flatnonzero((np.diff(place[starts], prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1)) if len(starts) else starts
        self.first = starts[cut]
        self.last = starts[np.append(cut[1:], len(starts)) - 1] if len(starts) else starts
        at = place[self.first]
        self.doc = doc[self.first]
        self.samples = mixed(small[at] + MIX)  # least hashes crowd at the low end; mixed again they fill all buckets alike
        self.around = mixed(mixed(self.windows[self.first] + MIX) ^ self.windows[self.last]) ^ mixed(((at - self.first) * 64 + self.last - self.first).astype(np.uint64) + MIX)

    def named(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (sample, surroundings), sorted, the smallest doc_id of each, and for each group of windows its entry."""
        order = np.lexsort((self.order[self.doc], self.around, self.samples))
        s, c = self.samples[order], self.around[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        entry = np.empty(len(s), np.int64)
        entry[order] = np.cumsum(new) - 1
        return s[new], c[new], self.order[self.doc[order[new]]], entry

    def open_windows(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows of groups with open entries: distinct hashes, sorted, their smallest doc_id, each window's start, and its hash's number."""
        groups = np.flatnonzero(flags == OPEN)
        n = self.last[groups] - self.first[groups] + 1
        starts = np.repeat(self.first[groups] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        ids = self.order[np.repeat(self.doc[groups], n)]
        keys, number = np.unique(self.windows[starts] if len(starts) else np.zeros(0, np.uint64), return_inverse=True)
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, number, ids)
        return keys, least, starts, number

    def removed(self, starts: np.ndarray) -> np.ndarray:
        """Which bytes the windows at `starts` cover."""
        edges = np.zeros(self.n + 1, np.int32)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + SPAN, -1)
        return np.cumsum(edges[:-1]) > 0


def flags_of(it: Chunk, answers: list[dict]) -> np.ndarray:
    """For each group of windows KEEP, GONE or OPEN. What the smallest doc_id of an entry keeps, a larger one in the chunk loses."""
    samples, _, least, entry = it.named()
    got = np.concatenate([C.unpack(a["flags"], np.uint8) for a in answers]) if answers else np.zeros(len(samples), np.uint8)
    flags = got[entry]
    later = it.order[it.doc] > least[entry]
    return np.where(later, GONE, flags)


def _bucketed(keys, buckets: int, chunk: int, columns: dict) -> pa.RecordBatch:
    edges = C.bucket_edges(keys, buckets)
    out = {"bucket": [], "chunk": [], "keys": [], **{k: [] for k in columns}}
    for k in range(buckets):
        if edges[k] < edges[k + 1]:
            some = slice(edges[k], edges[k + 1])
            for name, x in (("bucket", k), ("chunk", chunk), ("keys", C.pack_sorted(keys[some])), *((n, C.pack(v[some])) for n, v in columns.items())):
                out[name].append(x)
    return arrow_rows(out, {"bucket": pa.int32(), "chunk": pa.int64(), "keys": pa.binary(), **{k: pa.binary() for k in columns}})


def _gathered(t: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([C.unpack(x.as_py(), dtype) for x in t[name]])


def _answers(asked: DataFrame, judge) -> DataFrame:
    """In each bucket, flags for all keys of all chunks, given back in the order of each chunk's keys."""

    def answer(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        keys = [C.unpack_sorted(x.as_py()) for x in t["keys"]]
        flags = np.split(judge(np.concatenate(keys), t).astype(np.uint8), np.cumsum([len(k) for k in keys])[:-1])
        return pa.Table.from_batches([arrow_rows({"chunk": t["chunk"].to_pylist(), "bucket": t["bucket"].to_pylist(), "flags": [C.pack(f) for f in flags]}, {"chunk": pa.int64(), "bucket": pa.int32(), "flags": pa.binary()})])

    return stored(asked.groupBy("bucket").applyInArrow(answer, "chunk long, bucket int, flags binary"), "suffix-answers")


def _judge_samples(samples: np.ndarray, t: pa.Table) -> np.ndarray:
    around, ids = _gathered(t, "around", np.uint64), _gathered(t, "ids", np.int64)
    order = np.lexsort((ids, around, samples))
    s, c, i = samples[order], around[order], ids[order]
    new_s = np.append(True, s[1:] != s[:-1])
    new_c = new_s | np.append(True, c[1:] != c[:-1])
    least_c = i[new_c][np.cumsum(new_c) - 1]
    group = np.cumsum(new_s) - 1
    kinds, least_s = np.bincount(group, new_c)[group], np.minimum.reduceat(i, np.flatnonzero(new_s))[group]
    # a group of one kind is settled; a sample of several kinds is open: as a source even where it is the first
    flag = np.where(i > least_c, GONE, np.where((kinds == 1) | (least_s == np.maximum.reduceat(i, np.flatnonzero(new_s))[group]), KEEP, OPEN))
    out = np.empty(len(flag), np.uint8)
    out[order] = flag
    return out


def _judge_windows(keys: np.ndarray, t: pa.Table) -> np.ndarray:
    ids = _gathered(t, "ids", np.int64)
    _, number = np.unique(keys, return_inverse=True)
    least = np.full(number.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids)
    return np.where(ids > least[number], GONE, KEEP)


def _in_order(got) -> list[dict]:
    return sorted(got.as_py() or [], key=lambda a: a["bucket"])


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the kept bytes and the spans [begin, end)."""
    spark = docs.sparkSession
    table = C.chunked(docs, "suffix_chunks", CHUNK_BYTES)
    buckets = C.buckets_for(spark)

    def ask_samples(batches):
        for b in batches:
            for chunk, data in zip(b.column(0), b.column(1)):
                s, c, ids, _ = Chunk(data.as_py()).named()
                yield _bucketed(s, buckets, chunk.as_py(), {"around": c, "ids": ids})

    def ask_windows(batches):
        for b in batches:
            for chunk, data, got in zip(b.column(0), b.column(1), b.column(2)):
                it = Chunk(data.as_py())
                keys, least, _, _ = it.open_windows(flags_of(it, _in_order(got)))
                yield _bucketed(keys, buckets, chunk.as_py(), {"ids": least})

    named = _answers(table.select("chunk", "texts").mapInArrow(ask_samples, "bucket int, chunk long, keys binary, around binary, ids binary"), _judge_samples)
    first = C.with_answers(table, named)
    settled = _answers(first.mapInArrow(ask_windows, "bucket int, chunk long, keys binary, ids binary"), _judge_windows)

    types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    if keep_text:
        types |= {"kept_bytes": pa.binary(), "spans": pa.list_(pa.list_(pa.int64()))}

    def finish(batches):
        for b in batches:
            for data, got, more in zip(b.column(1), b.column(2), b.column(3)):
                it = Chunk(data.as_py())
                flags = flags_of(it, _in_order(got))
                gone = np.flatnonzero(flags == GONE)
                size = it.last[gone] - it.first[gone] + 1
                starts = [np.repeat(it.first[gone] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                keys, least, open_starts, number = it.open_windows(flags)
                answers = _in_order(more)
                if answers:
                    settled_flags = np.concatenate([C.unpack(a["flags"], np.uint8) for a in answers])
                    ids = np.array(it.order)[np.searchsorted(it.begin, open_starts, "right") - 1]
                    starts.append(open_starts[(settled_flags[number] == GONE) | (ids > least[number])])
                mask = it.removed(np.concatenate(starts).astype(np.int64))
                out = {k: [] for k in types}
                out["doc_id"] = it.ids
                for begin, text in zip(it.begin, it.texts):
                    cut = mask[begin : begin + len(text)]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], cut.astype(np.int8), [0]))))
                    kept = np.frombuffer(text, np.uint8)[~cut].tobytes() if len(edges) else text
                    out["n_bytes"].append(len(text))
                    out["n_removed"].append(len(text) - len(kept))
                    out["n_spans"].append(len(edges) // 2)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        out["kept_bytes"].append(kept)
                        out["spans"].append(edges.reshape(-1, 2).tolist())
                yield arrow_rows(out, types)

    both = first.withColumnRenamed("answers", "named").join(C.with_answers(table, settled).select("chunk", "answers"), "chunk", "left").select("chunk", "texts", "named", "answers")
    return both.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary, spans array<array<long>>" * keep_text)
