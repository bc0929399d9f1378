"""Token ids in ORC files (operator 1).

Documents are range-partitioned by doc_id and sorted, each text is encoded by the tokenizers library, and the ids go to
ORC: integer columns with run-length encoding, stripes that tasks read in parallel, row indexes, and Bloom filters on
doc_id, so that a reader who looks for a few documents skips stripes and row groups by metadata alone.

The encoding is a byte-level BPE whose pattern never matches across a space that follows a non-space, so a text falls
into parts there, and each different part is encoded once for a batch of parts and remembered within bounds. A text that
holds a special token of the library goes through it whole.

Defined cases: a null or empty text has only the end id; documents stand in ascending doc_id order, null first, equal
doc_ids in the order of their texts; repeated rows are written as often as they stand; an empty table writes an empty
table; other columns of the input play no part; a very
long text is cut into parts like any other, or encoded in one call where nothing can be cut.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import arrow_rows, bounded_batches, larger_batches, stored, texts_of

END_ID = 0
END = np.array([END_ID], "<u4").tobytes()
#: Parts remembered by a worker in one generation; the one before it stays at hand. Longer parts are not remembered.
MOST_PARTS, LONG_PART = 250_000, 256
#: Parts joined for one call of the library.
GROUP = 1000
#: Kinds of bytes: ASCII letters, digits and the apostrophe, all other marks, which end a run of letters, first bytes of characters that are no
#: white space, later bytes, and all others: space and line break, further white space and first bytes that may be white space.
LETTER, PLAIN, MARK, LEAD, TAIL, BREAK, OTHER = range(7)


def _kind(b: int) -> int:
    c = chr(b)
    if b < 0x80:
        return LETTER if c.isalpha() else BREAK if c in " \n" else OTHER if c.isspace() else PLAIN if c.isdigit() or c == "'" else MARK
    return TAIL if b < 0xC0 else OTHER if b in (0xC2, 0xE1, 0xE2, 0xE3) else LEAD


KINDS = np.array([_kind(b) for b in range(256)], np.uint8)
#: Options of the ORC writer.
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "snappy"}


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, special_as_text: bool = False):
    """The library's tokenizer. Special tokens in a text are found, as is its default, or taken as other text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = special_as_text
    return out


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts begin in the UTF-8 bytes `data` of texts that begin at `offsets`: at each text, before a space or line
    break after another character, and before a mark after an ASCII letter. The pattern never matches across these.
    No cut comes after a character that may be wide white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = KINDS[data]
    behind = np.concatenate(([np.uint8(OTHER)], kind[:-1]))
    wide = np.flatnonzero((kind == BREAK) & (behind == TAIL))
    cut = (kind == BREAK) & (behind <= MARK) | (kind == MARK) & (behind == LETTER)
    # the character before ends in a byte that many have in common: it is no white space if its first byte tells so
    for back in (2, 3, 4):
        first = data[np.maximum(wide - back, 0)]
        some = (first >= 0xC0) & (wide >= back)
        cut[wide[some & (KINDS[first] == LEAD)]] = True
        wide = wide[~some]
    cut[offsets[offsets < n]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts by their parts; each part goes through the library once while one of two generations remembers it."""

    def __init__(self, path: str, special_as_text: bool = False):
        self.library, self.known, self.old = tokenizer(path, special_as_text), {}, {}
        sizes = {i: len(token) for token, i in self.library.get_vocab().items()}  # one character stands for one byte
        self.n_bytes = np.zeros(max(sizes) + 1, np.int64)
        self.n_bytes[list(sizes)] = list(sizes.values())
        self.special = [] if special_as_text else [t.content for t in self.library.get_added_tokens_decoder().values()]

    def _encode_new(self, new: list[str]) -> dict[str, bytes]:
        """Parts that begin with white space and end without are joined for the library; the bytes that each id stands for show where a part ends."""
        out: dict[str, bytes] = {}
        joined, single = [], []
        for p in new:
            (joined if p[0] in " \n" and len(p) > 1 and not p[-1].isspace() else single).append(p)
        for k in range(0, len(single), GROUP):
            some = single[k : k + GROUP]
            out.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False)))
        groups = [joined[k : k + GROUP] for k in range(0, len(joined), GROUP)]
        for parts, e in zip(groups, self.library.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(list(map(len, map(str.encode, parts))))) + 1
            raw, at = ids.tobytes(), 0
            for p, end in zip(parts, (4 * ends).tolist()):
                out[p] = raw[at:end]
                at = end
        return out

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """The ids of each of the distinct parts, as bytes."""
        if len(self.known) > MOST_PARTS:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = []
        for p in set(parts).difference(known):
            if p in old:
                known[p] = old[p]
            else:
                new.append(p)
        made = self._encode_new(new)
        known.update((p, ids) for p, ids in made.items() if len(p) <= LONG_PART)
        return [known[p] if p in known else made[p] for p in parts]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids with the end id, and all these ids."""
        n = len(texts)
        if not n:
            return np.zeros(1, np.int64), np.zeros(0, "<u4")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        begin = cuts(data, offsets[:-1])
        if self.special:
            # a text with a special token stays whole, as the library looks for these before all else
            for k in np.flatnonzero(np.logical_or.reduce([pc.match_substring(texts, s).to_numpy(zero_copy_only=False) for s in self.special])):
                begin = begin[(begin <= offsets[k]) | (begin >= offsets[k + 1])]
        edges = np.append(begin, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(begin), pa.py_buffer(edges), pa.py_buffer(data)).dictionary_encode()
        ids = [*self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), END]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        # the end id follows the parts of each text
        ends = np.searchsorted(begin, offsets[1:])
        at = np.insert(coded.indices.to_numpy(), ends, len(ids) - 1)
        each = sizes[at]
        stop = np.cumsum(each)
        taken = flat[np.repeat(first[at] - (stop - each), each) + np.arange(stop[-1])]
        return np.concatenate(([0], stop[ends + np.arange(n)])), taken


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str, special_as_text: bool) -> Encoder:
    """What a worker remembers holds for all its tasks."""
    return Encoder(path, special_as_text)


def write(docs: DataFrame, path: str, partitions: int | None = None, special_as_text: bool = False) -> DataFrame:
    """Writes doc_id, part, start_in_part, n_ids and ids as ORC in the shared folder, in ascending doc_id order; returns the table as read back."""
    names = ["doc_id", "part", "start_in_part", "n_ids", "ids"]

    def run(batches):
        from pyspark import TaskContext

        encoder, start, part = worker_encoder(path, special_as_text), 0, TaskContext.get().partitionId()
        for b in larger_batches(batches, 4 << 20):
            offsets, ids = encoder.encode(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=names
            )
            start += int(offsets[-1])

    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts_of(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, "doc_id long, part int, start_in_part long, n_ids long, ids array<int>"), "tokens", "orc", **ORC_OPTIONS)


def read(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of the written documents. A part's first id is the sum of the parts before it."""
    types = {"doc_id": pa.int64(), "part": pa.int32(), "start_in_part": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}

    def run(batches):
        for b in batches:
            ids = b.column(3)
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(offsets[:-1], offsets[1:])]
            yield arrow_rows({"doc_id": b.column(0), "part": b.column(1), "start_in_part": b.column(2), "n_tokens": np.diff(offsets).astype(np.int64), "ids_crc32": crc}, types)

    bounded_batches(tokens.sparkSession)
    sizes = tokens.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_ids")).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    each = tokens.select("doc_id", "part", "start_in_part", "ids").mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    # one row for each written part, so the broadcast side is bounded by the number of tasks
    return each.join(F.broadcast(before), "part").select("doc_id", (F.col("first") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def find(tokens: DataFrame, doc_ids: list[int]) -> DataFrame:
    """The written documents of a few ids. The condition goes to the ORC reader, which skips stripes and row groups by their ranges and Bloom filters."""
    return tokens.where(F.col("doc_id").isin([int(i) for i in doc_ids]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    return read(write(docs, path))
