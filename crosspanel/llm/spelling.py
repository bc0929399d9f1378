"""Spelling variants: words one edit apart, found by dynamic programming over sorted word lists (operator 11).

Words come from the maximal runs of letters of whole texts. Two words are near if one inserted, deleted or replaced code
point leads from one to the other. The form of a word is its most frequent near word, if that is ten times as frequent.

How near words are found. A pair differs at one place, so it shares either the first half of the shorter word or the rest
of it. Words therefore meet in blocks: those of length s and s + 1 with equal first halves, and, read backwards, those with
equal second halves. In a block the words are sorted, and each word of length s is compared with all of them by walking down
the list's common prefixes (LCPs): a range of words that share a prefix has one band of the edit matrix, made from the band of
the range that it came from, and a range whose band exceeds one edit is left out as a whole. As list words are never shorter, the
band has two cells: `a` for equally long prefixes, `b` for a list prefix that is one longer. Many ranges of many words are held in arrays and
go one code point deeper at a time.

A block of over BLOCK words is split without loss: pairs that agree in one more code point stay together by that longer prefix,
and pairs that differ right there share the word without that code point, as which no more words than letters can go. So no task's memory
grows with the vocabulary. A pair is taken in one block only, by the length of its common prefix.

Defined cases: a null text has no words; a null doc_id reads as the empty text; empty and very long texts and repeated rows
count as they stand (a repeated row's run has the same h, so it loses the same code point); a word longer than its neighbours
is compared to its end, however long; ties of n go to the smallest word in code-point order; an empty table gives an empty
table; other columns play no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import bounded_batches, stored

#: Words of a block at most, before it is split; words that a task compares at once at least (all blocks among them whole).
BLOCK, AT_ONCE = 8192, 32768
#: Words of those that walk down the lists together.
WALKERS = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least_length: int = 7, least_n: int = 2, one_in: int = 31) -> DataFrame:
    """word and n. Runs that the checksum picks (one in `one_in`) lose the code point it points at."""
    run = f"[A-Za-zÀ-ÿ]{{{least_length},}}"
    words = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(run), F.lit(0))).alias("run"),
    ).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h, at = F.crc32(F.concat_ws(":", "id", "run").cast("binary")), F.col("at").cast("int")
    words = words.withColumn("h", h).withColumn("at", F.when(F.col("h") % one_in == 0, F.col("h") % F.char_length("run")))
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = words.select(F.when(F.col("at").isNull(), F.col("run")).otherwise(cut).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def lcp_of(code: np.ndarray, x: np.ndarray, y: np.ndarray, lx: np.ndarray, ly: np.ndarray) -> np.ndarray:
    """How many code points are equal from `x` and `y` (places in `code`) on, within the lengths."""
    out, most, d = np.zeros(len(x), np.int64), np.minimum(lx, ly), 0
    alive = np.flatnonzero(most > 0)
    while len(alive):
        alive = alive[code[x[alive] + d] == code[y[alive] + d]]
        d += 1
        out[alive] = d
        alive = alive[most[alive] > d]
    return out


class Lists:
    """Sorted lists of distinct words, one for each block, one after the other. `shared` is the length of the prefix that a block's words share."""

    def __init__(self, words: list[str], starts: np.ndarray, ends: np.ndarray, shared: np.ndarray, size: np.ndarray):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.at = np.cumsum(self.length) - self.length
        self.code = np.frombuffer(("".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.starts, self.ends, self.shared, self.size = starts, ends, shared, size
        n = len(words)
        lcp = lcp_of(self.code, self.at[:-1], self.at[1:], self.length[:-1], self.length[1:])
        inside = np.flatnonzero(starts[1:] == starts[:-1]) + 1  # places whose word before is of the same block
        #: Places in order of (LCP with the word before, place): the places in a range at which a prefix of d ends are neighbours here.
        self.step = n + 1
        self.breaks = np.sort(lcp[inside - 1] * self.step + inside)

    def near(self, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the words `asking` all list words of their blocks, as long or one longer, at exactly one edit."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        q, lo, hi, d = asking, self.starts[asking], self.ends[asking], self.shared[asking]
        a, b = np.zeros(len(q), np.int8), np.where(d > 0, 1, 9).astype(np.int8)
        while len(q):
            s, first = self.size[q], self.length[lo]
            ended = first == d
            hit = ended & (((first == s) & (a == 1)) | ((first == s + 1) & (b == 1)))
            found.append((q[hit], lo[hit]))
            lo = lo + ended
            left = np.searchsorted(self.breaks, d * self.step + lo + 1)
            children = np.where(lo < hi, np.searchsorted(self.breaks, d * self.step + hi) - left + 1, 0)
            parent = np.repeat(np.arange(len(q)), children)
            nth = np.arange(len(parent)) - np.repeat(np.cumsum(children) - children, children)
            last = nth == children[parent] - 1
            places = left[parent] + nth
            new_hi = np.where(last, hi[parent], self.breaks[np.where(last, 0, places)] % self.step if len(self.breaks) else 0)
            new_lo = np.where(nth == 0, lo[parent], self.breaks[np.where(nth == 0, 0, places - 1)] % self.step if len(self.breaks) else 0)
            q, d, s, a, b = q[parent], d[parent], s[parent], a[parent], b[parent]
            c = self.code[self.at[new_lo] + d]
            own = self.at[q]
            a_new = np.where(d < s, a + (c != self.code[own + np.minimum(d, s - 1)]), 9)
            b_new = np.minimum(np.where(d > 0, b + (c != self.code[own + np.maximum(d, 1) - 1]), 9), a + 1)
            keep = np.minimum(a_new, b_new) <= 1
            q, lo, hi, d, a, b = q[keep], new_lo[keep], new_hi[keep], d[keep] + 1, a_new[keep].astype(np.int8), b_new[keep].astype(np.int8)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def near_in(block: pa.Table) -> pa.RecordBatch:
    """All near pairs of a table of whole blocks (kind, s, key, shared, word sorted by kind, s, key and word), in both directions."""
    words, n = block["word"].to_pylist(), block["n"].to_numpy()
    kind, size, shared = (block[c].to_numpy().astype(np.int64) for c in ("kind", "s", "shared"))
    key = block["key"].to_pylist()
    new = np.fromiter((i == 0 or key[i] != key[i - 1] for i in range(len(key))), bool, len(key))
    new[1:] |= (kind[1:] != kind[:-1]) | (size[1:] != size[:-1])
    begins = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    ends = np.append(begins[1:], len(words))[number]
    twins = kind >= 2  # keys that are no prefixes: the walk begins with the whole block, and the pair must differ at `shared`
    lists = Lists(words, begins[number], ends, np.where(twins, 0, shared), size)
    asking = np.flatnonzero(lists.length == size)
    x, y = [], []
    for i in range(0, len(asking), WALKERS):
        p, o = lists.near(asking[i : i + WALKERS])
        x.append(p)
        y.append(o)
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (x, y))
    lx, ly, at, code = lists.length, lists.length, lists.at, lists.code
    apart = lcp_of(code, at[x], at[y], lx[x], ly[y])
    keep = ~twins[x] | (apart == shared[x])
    # Read backwards: pairs that share the first half as well are those of the blocks of first halves.
    half = size[x] // 2
    tails = np.ones(len(x), bool)
    back = kind[x] % 2 == 1
    for t in range(int(half[back].max(initial=0))):
        some = np.flatnonzero(back & tails & (half > t))
        tails[some] = code[at[x[some]] + lx[x[some]] - 1 - t] == code[at[y[some]] + ly[y[some]] - 1 - t]
    keep &= ~back | ~tails
    x, y = x[keep], y[keep]
    longer = lx[y] > lx[x]
    one, two = np.concatenate([x, y[longer]]), np.concatenate([y, x[longer]])
    backwards = kind[one] % 2 == 1
    said = lambda places: [words[i][::-1] if r else words[i] for i, r in zip(places.tolist(), backwards.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(said(one), pa.string()), pa.array(said(two), pa.string()), pa.array(n[two], pa.int64())], names=["word", "near", "near_n"])


def blocks(words: DataFrame) -> DataFrame:
    """Every word in the blocks of its halves: kind (0: first half, 1: second half, read backwards), s (length of the shorter words), shared, key and the word as it is read."""
    made = []
    for s in (F.char_length("word"), F.char_length("word") - 1):
        half = F.floor(s / 2).cast("int")
        for kind, word, shared in ((0, F.col("word"), half), (1, F.reverse("word"), s - half)):
            made.append(F.struct(F.lit(kind).alias("kind"), s.cast("int").alias("s"), shared.cast("int").alias("shared"), word.substr(F.lit(1), shared).alias("key"), word.alias("word"), F.col("n").alias("n")))
    return words.select(F.explode(F.array(*made)).alias("b")).select("b.*")


def split(entries: DataFrame) -> DataFrame:
    """Blocks that are too large, one code point deeper: by a prefix longer by one, and by the words without the code point at which pairs differ (kinds 2 and 4; read backwards 3 and 5)."""
    k = F.col("shared")
    without = F.concat(F.col("word").substr(F.lit(1), k), F.col("word").substr(k + 2, F.char_length("word")))
    entry = lambda kind, shared, key: F.struct(kind.cast("int").alias("kind"), F.col("s"), shared.alias("shared"), key.alias("key"), F.col("word"), F.col("n"))
    short = F.char_length("word") == F.col("s")
    deeper = F.when(F.char_length("word") > k, entry(F.col("kind"), k + 1, F.col("word").substr(F.lit(1), k + 1)))
    replaced = F.when(short, entry(F.col("kind") + 2, k, without))
    inserted = entry(F.col("kind") + 4, k, F.when(short, F.col("word")).otherwise(without))
    return entries.select(F.explode(F.array_compact(F.array(deeper, replaced, inserted))).alias("b")).select("b.*")


def near_pairs(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, near, near_n for all near pairs of a table of distinct words (word, n), in both directions, each once."""
    by, done, entries = ["kind", "s", "key"], [], blocks(words)
    while True:
        large = stored(entries.where("kind < 2").groupBy(*by).count().where(F.col("count") > most).drop("count"), "large-blocks")
        if large.isEmpty():
            break
        done.append(entries.join(large, by, "left_anti"))
        entries = split(stored(entries.join(large, by, "left_semi"), "blocks"))
    rows = functools.reduce(DataFrame.unionByName, [*done, entries])

    def run(batches: Iterator[pa.RecordBatch]):
        waiting, held = [], 0

        def whole(last: bool):
            table = pa.Table.from_batches(waiting).combine_chunks()
            cut, key = table.num_rows, None
            while not last and cut:
                now = tuple(table[c][cut - 1].as_py() for c in by)
                if key is not None and now != key:
                    break
                key, cut = now, cut - 1
            return table.slice(0, cut), table.slice(cut).to_batches()

        for b in batches:
            if b.num_rows:
                waiting.append(b)
                held += b.num_rows
            if held >= AT_ONCE:
                table, waiting = whole(False)
                held = sum(x.num_rows for x in waiting)
                if table.num_rows:
                    yield near_in(table)
        if held:
            yield near_in(whole(True)[0])

    bounded_batches(words.sparkSession)
    return rows.repartition(*by).sortWithinPartitions(*by, "word").mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for a table of word and form: pointers are followed two, four, eight steps at a time. As each form is ten times as frequent as its word, chains are short."""
    chains = stored(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        on = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(chains.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "chains")
        if step.where("moved").isEmpty():
            return chains
        chains = step.drop("moved")


def grouped(words: DataFrame, times: int = 10, most: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words (word, n)."""
    words = stored(words.select("word", "n"), "words")
    best = near_pairs(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    good = -F.col("best.less") >= times * F.col("n")
    linked = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")
    )
    linked = stored(linked, "forms")
    known = roots(linked.where(F.col("form").isNotNull()))
    return linked.join(known, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """The vocabulary of all texts, each word with its near words counted, its form and its root."""
    return grouped(vocabulary(docs))
