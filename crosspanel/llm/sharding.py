"""Documents into shards of nearly equal bytes: minimax contiguous partition, with DataFrame functions only (operator 13).

Documents with equal texts are one atomic group, and groups are ordered by the 64-bit hash of their text, so each shard is a range of
hashes: a row finds its shard from its own text, without a join or a shuffle, and however many rows one text has. (Texts whose
hashes collide are one group; that is as good for the law.) What is sought is the smallest capacity for which, filling one shard after the
other in this order, `shards` shards are enough, where a group above the capacity has a shard of its own. The largest shard is then
as small as any contiguous partition can make it, as it is either such a group or as full as the capacity; and one giant group leaves the
other shards even.

The search runs on summaries. One pass sums bytes by blocks of hashes. For a capacity, taking blocks as divisible gives a lower bound on
the number of shards, taking them as whole an upper bound. Binary search over both leaves an interval for the smallest capacity; the blocks in
which the cuts can fall are summed again, FINER times finer, until the interval is one number. The driver holds some ten thousand sums a round,
whatever the size of the corpus, and a round reads 16 bytes a document. In the end each cut goes where, within the capacity, the shards become most even.

Slots go by doc_id. Rows are sorted in ranges over all tasks, numbered in each, and the counts of the ranges before are added, so
no task holds a shard.

Defined cases: a null text has no bytes and goes with the empty text (crc32 0, size 8); a null doc_id sorts first; repeated rows have a slot each;
equal doc_ids go by hash; an empty table gives an empty table; with fewer groups than shards, some shards stay empty; a text of any length is atomic;
other columns play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import ranked, stored

#: Bits of the first blocks, and how many more each further pass looks at.
FIRST_BITS, MORE_BITS = 12, 6
#: What each document takes besides the bytes of its text.
OVERHEAD = 8


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + OVERHEAD
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_hash().alias("h"))


class Blocks:
    """Neighbouring ranges of hashes in order: where each begins, how many of the leading bits it fixes, its bytes, and whether all its rows have one hash."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]):
        self.rows = sorted(rows)
        self.atomic = np.array([r[3] for r in self.rows], bool)
        self.ends = np.concatenate(([0], np.cumsum([r[2] for r in self.rows], dtype=np.int64)))
        self.total, self.n = int(self.ends[-1]), len(self.rows)

    def reach(self, start: int, capacity: int) -> int:
        """The block after the last that fits, if a shard begins with block `start`; a larger group stands alone."""
        end = int(np.searchsorted(self.ends, self.ends[start] + capacity, "right")) - 1
        return end if end > start else start + 1 if self.atomic[start] else start

    def whole(self, capacity: int, shards: int) -> list[int] | None:
        """Where shards end if blocks stay whole; None if they are too few."""
        cuts = [0]
        while cuts[-1] < self.n:
            end = self.reach(cuts[-1], capacity)
            if end == cuts[-1] or len(cuts) > shards:
                return None
            cuts.append(end)
        return cuts

    def divided(self, capacity: int, shards: int) -> list[int] | None:
        """Where, in bytes, shards end if all but atomic blocks can be cut anywhere; None if they are too few."""
        cuts = [0]
        while cuts[-1] < self.total:
            if len(cuts) > shards:
                return None
            target = cuts[-1] + capacity
            if target < self.total:
                k = int(np.searchsorted(self.ends, target, "right")) - 1
                if self.atomic[k]:
                    begin = int(self.ends[k])
                    target = begin if begin > cuts[-1] else int(self.ends[k + 1])
            cuts.append(min(target, self.total))
        return cuts


def smallest(fits, low: int, high: int) -> int:
    """The smallest number from `low` to `high` that fits, where `high` is known to."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def open_blocks(blocks: Blocks, least: int, most: int, shards: int) -> np.ndarray:
    """The blocks in which a cut of a capacity from `least` to `most` can fall: for each cut, those from where whole blocks at `least` end to where divided ones at `most` end."""
    early, start = [], 0
    for _ in range(shards):
        start = blocks.reach(start, least) if start < blocks.n else blocks.n
        early.append(int(blocks.ends[start]))
    late = blocks.divided(most, shards)[1:]
    late += [blocks.total] * (shards - len(late))
    touched = np.zeros(blocks.n, bool)
    for a, b in zip(early, late):
        touched[max(0, int(np.searchsorted(blocks.ends, a, "right")) - 1) : int(np.searchsorted(blocks.ends, b, "left"))] = True
    return touched & ~blocks.atomic


def summed(sized: DataFrame, bits: int, within: list[int] | None = None, known: int = 0) -> list[tuple[int, int, int, bool]]:
    """Blocks of `bits` leading bits, of all rows or of those whose `known` leading bits are among `within`."""
    if within is not None:
        sized = sized.where(F.shiftright("h", 64 - known).isin(within))
    sums = sized.groupBy(F.shiftright("h", 64 - bits).alias("b")).agg(F.sum("size").alias("bytes"), (F.min("h") == F.max("h")).alias("one"))
    return [(r.b << (64 - bits), bits, r.bytes, r.one) for r in sums.collect()]


def minimax(sized: DataFrame, shards: int, first_bits: int = FIRST_BITS) -> tuple[Blocks, int]:
    """The smallest capacity for `shards` shards of rows of h and size, and blocks whose edges are enough to reach it."""
    blocks = Blocks(summed(sized, first_bits))
    while blocks.n:
        least = smallest(lambda c: blocks.divided(c, shards) is not None, 1, blocks.total)
        most = smallest(lambda c: blocks.whole(c, shards) is not None, least, blocks.total)
        if least == most:
            return blocks, least
        touched = open_blocks(blocks, least, most, shards)
        rows = [r for r, t in zip(blocks.rows, touched) if not t]
        for known in sorted({r[1] for r, t in zip(blocks.rows, touched) if t}):
            within = [r[0] >> (64 - known) for r, t in zip(blocks.rows, touched) if t and r[1] == known]
            rows += summed(sized, min(64, known + MORE_BITS), within, known)
        blocks = Blocks(rows)
    return blocks, 0


def even_cuts(blocks: Blocks, capacity: int, shards: int) -> list[int]:
    """The hashes at which all shards but the first begin: block edges, no shard above `capacity` but single groups, each cut as near as may be to an even share of what is left."""
    n, ends = blocks.n, blocks.ends
    giant = blocks.atomic & (np.diff(ends) > capacity)
    giants = np.concatenate(([0], np.cumsum(giant)))
    giant_bytes = np.concatenate(([0], np.cumsum(np.where(giant, np.diff(ends), 0))))
    earliest = [n]  # the first block from which on so many shards are enough
    for _ in range(shards - 1):
        end = earliest[-1]
        start = int(np.searchsorted(ends, ends[end] - capacity, "left"))
        earliest.append(min(start, max(0, end - 1)))
    cuts, start = [], 0
    for left in range(shards, 1, -1):
        if start < n:
            share = (blocks.total - ends[start] - (giant_bytes[n] - giant_bytes[start])) / max(1, left - (giants[n] - giants[start]))
            at = int(np.searchsorted(ends, ends[start] + share))
            if at > 0 and ends[start] + share - ends[at - 1] < ends[min(at, n)] - ends[start] - share:
                at -= 1
            at = min(at, n - (left - 1))
            start = min(max(at, start + 1, earliest[left - 1]), max(start + 1, blocks.reach(start, capacity)))
        cuts.append(blocks.rows[start][0] if start < n else None)
    return [c for c in cuts if c is not None]


def shard_of(cuts: list[int], h: Column) -> Column:
    """The number of cuts at or below a hash."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= h))


def plan(docs: DataFrame, shards: int) -> list[int]:
    """The cuts for `docs`."""
    return even_cuts(*minimax(stored(sizes(docs).select("h", "size"), "sizes"), shards), shards)


def with_shard(docs: DataFrame, cuts: list[int]) -> DataFrame:
    """`docs` with shard, without a shuffle; a column of that name is replaced."""
    return docs.withColumn("shard", shard_of(cuts, text_hash()))


def assigned(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    sized = stored(sizes(docs), "sizes")
    cuts = even_cuts(*minimax(sized, shards), shards)
    placed = sized.withColumn("shard", shard_of(cuts, F.col("h")))
    slots = ranked(placed, ["shard"], ["doc_id", "h"], "placed")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
