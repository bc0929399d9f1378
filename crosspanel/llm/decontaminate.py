"""Benchmark decontamination with a generalised suffix automaton over words (operator 8).

The normalised items of the benchmark become one automaton per block of items. Each document streams through it word
by word and carries the length of the longest match that ends there. A match of a window's length (10 words, or a whole
shorter item) marks its words as hit. Spans of hit words go from the text, and a document whose hit share exceeds a
limit goes as a whole.

The automaton of one block has at most 2 * BLOCK_WORDS states, so what is broadcast has a proven bound, and so has what
a worker holds. A larger benchmark makes more blocks, which run one after another over the same documents: the marks of
the blocks so far are stored with the documents in the shared folder, and the block's broadcast is given up before the next.

Defined cases: a null or empty text, or one without words, has no words and no hits; an empty benchmark hits nothing;
null items have no words; repeated items count by item_id; repeated document rows give repeated rows; an empty table of
documents gives an empty table; extra columns stay or play no part; a very long text is streamed like any other.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from crosspanel.llm.common import arrow_rows, bounded_batches, stored, texts_of, with_texts

WINDOW = 10
BLOCK_WORDS = 400_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes to lower case, and all that is in no word to a space.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class Automaton:
    """States with word arcs and suffix links. `items` holds, by state, the items of the windows that end there."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.arcs, self.link, self.length = [{}], [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for item, words in items if words]
        for _, word_ids in coded:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, tuple[int, set[int]]] = {}
        for item, word_ids in coded:
            at = 0
            for k, w in enumerate(word_ids, 1):
                at = self.arcs[at][w]
                if k >= window:
                    self.items.setdefault(self._trim(at), set()).add(item)
            if len(word_ids) < window:
                self.short.setdefault(at, (len(word_ids), set()))[1].add(item)
        self.least = min((min(len(w), window) for _, w in coded), default=0)
        self.ends = self._short_ends()

    def _extend(self, last: int, w: int) -> int:
        if w in self.arcs[last]:
            q = self.arcs[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        new = self._state({}, -1, self.length[last] + 1)
        p = last
        while p >= 0 and w not in self.arcs[p]:
            self.arcs[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.arcs[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return new

    def _state(self, arcs: dict, link: int, length: int) -> int:
        self.arcs.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.arcs) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        copy = self._state(dict(self.arcs[q]), self.link[q], self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.arcs[p].get(w) == q:
            self.arcs[p][w] = copy
            p = self.link[p]
        return copy

    def _trim(self, at: int) -> int:
        """The state of the last `window` words of a match that ends in `at`."""
        while self.length[self.link[at]] >= self.window:
            at = self.link[at]
        return at

    def _short_ends(self) -> dict[int, list[int]]:
        """By state, the states of whole short items among its suffixes."""
        if not self.short:
            return {}
        out: dict[int, list[int]] = {}
        for at in sorted(range(1, len(self.arcs)), key=self.length.__getitem__):
            found = [at] if at in self.short else []
            if found or self.link[at] in out:
                out[at] = found + out.get(self.link[at], [])
        return out

    def stream(self, word_ids: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (begin, end) of window occurrences in a stretch of known words, and the items they belong to."""
        spans, found, at, n = [], set(), 0, 0
        arcs, link, length, window = self.arcs, self.link, self.length, self.window
        for i, w in enumerate(word_ids):
            while w not in arcs[at]:
                if at == 0:
                    break
                at = link[at]
                n = length[at]
            else:
                at, n = arcs[at][w], n + 1
            if n >= window:
                at = self._trim(at)
                n = window
                spans.append((i + 1 - window, i + 1))
                found |= self.items[at]
            if at in self.ends:
                for end in self.ends[at]:
                    size, items = self.short[end]
                    if size <= n:
                        spans.append((i + 1 - size, i + 1))
                        found |= items
        return spans, found

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """For each word whether it is hit, and the items that occur."""
        hit, found, get = np.zeros(len(words), bool), set(), self.vocabulary.get
        if not self.least or len(words) < self.least:
            return hit, found
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= self.least:
                spans, items = self.stream(ids[a:b].tolist())
                found |= items
                for x, y in spans:
                    hit[a + x : a + y] = True
        return hit, found


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW):
    """Automata of blocks of items, read one after another from the benchmark. A block has `block_words` words at most (a window, if that is more)."""
    block, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull())
    for row in rows.toLocalIterator():
        words = words_of(row.text)
        for piece in pieces_of(words, block_words, window):
            if block and n + len(piece) > block_words:
                yield Automaton(block, window)
                block, n = [], 0
            block.append((row.item_id, piece))
            n += len(piece)
    yield Automaton(block, window)


def pieces_of(words: list[bytes], most: int, window: int) -> list[list[bytes]]:
    """A long item in pieces of up to `most` words, neighbours with window - 1 words in common, so that each window is in one piece."""
    step = max(1, most - (window - 1))
    return [words[k : k + step + window - 1] for k in range(0, max(1, len(words) - (window - 1)), step)]


def _through(docs: DataFrame, benchmark: DataFrame, text: str, finish, schema, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents through the automata of all blocks, one block in memory at a time. `finish` gets a batch of `docs` and for
    each text its words, which of them are hit, and the items found, and gives the rows of `schema`."""
    spark, names = docs.sparkSession, docs.columns
    bounded_batches(spark)
    at, n = names.index(text), len(names)
    # the marks go along as two more columns, named unlike any other
    marks = ["hits", "items"]
    while set(marks) & set(names):
        marks = ["_" + m for m in marks]
    kept_schema = StructType([*docs.schema.fields, StructField(marks[0], BinaryType()), StructField(marks[1], ArrayType(LongType()))])

    def marker(broadcast, first: bool, last: bool):
        def run(batches):
            automaton = broadcast.value
            for b in batches:
                words = [words_of(t) for t in b.column(at).to_pylist()]
                old = [None] * b.num_rows if first else b.column(n).to_pylist()
                items = [()] * b.num_rows if first else b.column(n + 1).to_pylist()
                hits, found = [], []
                for w, bits, known in zip(words, old, items):
                    hit, new = automaton.hits(w)
                    hits.append(hit if not bits else hit | np.unpackbits(np.frombuffer(bits, np.uint8), count=len(w)).astype(bool))
                    found.append(new | set(known or ()))
                plain = pa.RecordBatch.from_arrays(b.columns[:n], names=names)
                if last:
                    yield finish(plain, words, hits, found)
                else:
                    packed = pa.array([np.packbits(h).tobytes() if h.any() else None for h in hits], pa.binary())
                    yield pa.RecordBatch.from_arrays([*plain.columns, packed, pa.array([sorted(f) for f in found], pa.list_(pa.int64()))], names=[*names, *marks])

        return run

    automata = blocks_of(benchmark, block_words)
    current, first = next(automata), True
    while True:
        following = next(automata, None)
        broadcast = spark.sparkContext.broadcast(current)
        made = docs.mapInArrow(marker(broadcast, first, following is None), schema if following is None else kept_schema)
        if following is None:
            return made
        docs, current, first = stored(made, "marked"), following, False
        broadcast.unpersist()


def without(text: str, hit: np.ndarray) -> str:
    """The text without its runs of hit words and what stands between them."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.lower())]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    out, at = [], 0
    for a, b in zip(edges[::2], edges[1::2]):
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), clean_text, kept (false if the hit share exceeds most_share)."""
    types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_hit": pa.int64(), "item_ids": pa.list_(pa.string()), "clean_text": pa.string(), "kept": pa.bool_()}

    def finish(b, words, hits, found):
        texts, counts = b.column(1).to_pylist(), [int(h.sum()) for h in hits]
        return arrow_rows(
            {
                "doc_id": b.column(0),
                "n_words": [len(w) for w in words],
                "n_hit": counts,
                "item_ids": [sorted(map(str, f)) for f in found],
                "clean_text": [without(t, h) if n else t for t, h, n in zip(texts, hits, counts)],
                "kept": [n <= most_share * len(w) for w, n in zip(words, counts)],
            },
            types,
        )

    schema = "doc_id long, n_words long, n_hit long, item_ids array<string>, clean_text string, kept boolean"
    return _through(texts_of(docs), benchmark, "text", finish, schema, block_words)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def digest(items: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def cleaned(docs: DataFrame, benchmark: DataFrame, most_share: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` with its columns, without spans of hit words and without documents whose hit share exceeds most_share."""
    at = docs.columns.index("text")

    def finish(b, words, hits, found):
        texts, counts = b.column(at).to_pylist(), [int(h.sum()) for h in hits]
        return with_texts(b, [None if n > most_share * len(w) else without(t, h) if n else t or "" for t, w, h, n in zip(texts, words, hits, counts)])

    return _through(docs, benchmark, "text", finish, docs.schema, block_words)
