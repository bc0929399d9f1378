"""Prefix trie of conversations as balanced parentheses, one for each shard, with their shared spines merged (operator 12).

Conversations with equal turns become one sequence first, so that a conversation that many share is one row. Sequences are sorted in ranges
over all tasks, by the digests of their turns; a shard is a run of neighbouring sequences. Its trie is a string of parentheses
in preorder. The depth of a node is the excess of opening parentheses; block minima of the excess, and the minima of pairs of
blocks above them, find the closing parenthesis of a node and thereby its subtree (findclose). Cumulative counts then answer for the whole
subtree: of opening parentheses (nodes), of `()` pairs (leaves), of members and of saved words.

Only nodes on the first and the last path of a shard, its spine, can stand in other shards too. For each the shard gives what hangs on it
besides the spine. One walk over all spines, in order and with a stack as deep as the trie, merges the nodes that neighbours share and adds up
their subtrees. It reads two paths a shard, however many conversations a shard has.

A node's conversations that end there are joined into one text and hashed. Their ids travel sorted in pieces of up to 32,768 and go
through the hash one piece after the other, so that no group of equal conversations is held in memory.

A conversation is one row with 16 bytes a turn, its texts stay behind. Digests of 128 bits stand for role and text.

Defined cases: rows without a conv_id belong to no conversation; a null turn comes first; rows of the same turn go by role, then by the md5
of the text; null role and text are empty; repeated rows are turns of their own; very long texts only count their words; an empty table gives an empty
table; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import bounded_batches, stored

#: Bytes of a turn's digest, bits of the ids in a piece, nodes in a shard (more if one sequence has more), parentheses in a block.
DIGEST, PIECE_BITS, NODES, BLOCK = 16, 15, 200_000, 64
#: How many conversations share the first turns of one of them, and how many turns at most.
FAMILY, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each with digest (hex) and words."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.md5(text.cast("binary")).alias("m"), F.regexp_count(text, F.lit(WORD)).cast("int").alias("words")
    )
    gathered = F.sort_array(F.collect_list(F.struct("turn", "role", "m", "words")))
    turn = lambda x: F.struct(F.md5(F.concat(F.md5(x.role.cast("binary")), x.m).cast("binary")).alias("digest"), x.words.alias("words"))
    return rows.groupBy("conv_id").agg(gathered.alias("t")).select("conv_id", F.transform("t", turn).alias("t"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation with the first turns of the first of its family in place of as many of its own."""
    turns = stored(turns, "turns")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))
    heads = turns.where(F.pmod("conv_id", F.lit(FAMILY)) == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    own = turns.withColumns({"base": base, "h": h}).join(heads, "base", "left")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("t", 1, 0))
    return own.select("conv_id", F.concat(head, F.slice("t", F.col("h") + 1, F.greatest(F.size("t"), F.lit(1)))).alias("t"))


class Parentheses:
    """Balanced parentheses from the depths of nodes in preorder."""

    def __init__(self, depth: np.ndarray):
        n = len(depth)
        self.opens = 2 * np.arange(n) - depth  # before a node opens, all nodes before it have opened, and all but `depth` of them closed
        bits = np.zeros(2 * n, np.int8)
        bits[self.opens] = 1
        excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        self.excess = np.pad(excess, (0, -len(excess) % BLOCK), constant_values=1 << 40).reshape(-1, BLOCK)
        #: Minima of blocks, of pairs of blocks, and so on.
        self.minima = [self.excess.min(1)]
        while len(self.minima[-1]) > 1:
            low = self.minima[-1]
            self.minima.append(np.pad(low, (0, len(low) % 2), constant_values=1 << 40).reshape(-1, 2).min(1))
        #: How many nodes opened, and how many leaf pairs began, before each place.
        self.rank = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))
        self.leaf_rank = np.concatenate(([0], np.cumsum((bits == 1) & (np.append(bits[1:], 0) == 0), dtype=np.int64)))

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """For opening parentheses the places of those that close them: the first after them with a smaller excess."""
        flat = self.excess.reshape(-1)
        below, out = flat[at] - 1, np.full(len(at), -1, np.int64)
        self._scan(at + 1, at // BLOCK, below, out, np.arange(len(at)))
        left = np.flatnonzero(out < 0)
        block, level = at[left] // BLOCK, np.zeros(len(left), np.int64)
        climbing = np.ones(len(left), bool)
        for k, low in enumerate(self.minima):  # up, until a sibling to the right holds a smaller excess
            sibling = np.minimum(block + 1, len(low) - 1)
            met = climbing & (block % 2 == 0) & (block + 1 < len(low)) & (low[sibling] <= below[left])
            block, level = np.where(met, block + 1, block), np.where(met, k, level)
            climbing &= ~met
            block = np.where(climbing, block // 2, block)
        for k in range(len(self.minima) - 1, 0, -1):  # and down, to the first block that does
            some = level == k
            first = np.minimum(2 * block, len(self.minima[k - 1]) - 1)
            block = np.where(some, np.where(self.minima[k - 1][first] <= below[left], first, first + 1), block)
            level = np.where(some, k - 1, level)
        self._scan(block * BLOCK, block, below[left], out, left)
        return out

    def _scan(self, begin: np.ndarray, block: np.ndarray, below: np.ndarray, out: np.ndarray, to: np.ndarray) -> None:
        flat = self.excess.reshape(-1)
        some, at = np.arange(len(begin)), begin.copy()
        while True:
            inside = at < (block[some] + 1) * BLOCK
            some, at = some[inside], at[inside]
            if not len(some):
                return
            met = flat[at] == below[some]
            out[to[some[met]]] = at[met]
            some, at = some[~met], at[~met] + 1


def range_min(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of values[begin:end] for many ranges: each is two overlapping spans of a power of two."""
    power = np.frexp(end - begin)[1] - 1
    out, low = np.empty(len(begin), values.dtype), values
    for k in range(int(power.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            low = np.minimum(low[:-half], low[half:])
        some = power == k
        out[some] = np.minimum(low[begin[some]], low[end[some] - (1 << k)])
    return out


def common(a: bytes, b: bytes) -> int:
    """How many turns two sequences share from the first on, by halving."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[: middle * DIGEST] == b[: middle * DIGEST] else (low, middle - 1)
    return low


EMPTY = hashlib.sha256().hexdigest()
#: Rows of a shard: its nodes, and its spine nodes with what hangs on them besides the spine.
SHARD = {
    "task": pa.int64(), "shard": pa.int64(), "spine": pa.int64(), "last": pa.bool_(), "step": pa.binary(), "words": pa.int64(), "depth": pa.int64(), "conv_id": pa.int64(),
    "parent_conv_id": pa.int64(), "parent_spine": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(),
}
SHARD_SQL = "task long, shard long, spine long, last boolean, step binary, words long, depth long, conv_id long, parent_conv_id long, parent_spine long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class Shard:
    """The trie of neighbouring sequences, given in order."""

    def __init__(self):
        self.depth, self.words, self.parent, self.step = [0], [0], [-1], [b""]
        self.ends: list[tuple[int, int, int, str]] = []
        self.path, self.before, self.first = [0], b"", 0

    def add(self, steps: bytes, words: list[int], n: int, low: int, digest: str) -> None:
        shared, size = common(self.before, steps), len(steps) // DIGEST
        del self.path[shared + 1 :]
        for d in range(shared + 1, size + 1):
            self.depth.append(d)
            self.words.append(words[d - 1])
            self.parent.append(self.path[-1])
            self.step.append(steps[(d - 1) * DIGEST : d * DIGEST])
            self.path.append(len(self.depth) - 1)
        if not self.ends:
            self.first = size
        self.ends.append((self.path[-1], n, low, digest))
        self.before = steps

    def rows(self, task: int, shard: int) -> pa.RecordBatch:
        depth, words, parent = (np.array(x, np.int64) for x in (self.depth, self.words, self.parent))
        size = len(depth)
        nodes = np.arange(size)
        at, n, low = (np.array(x, np.int64) for x in list(zip(*self.ends))[:3])
        ends_n, ends_low, digests = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), [EMPTY] * size
        ends_n[at], ends_low[at] = n, low
        for place, _, _, digest in self.ends:
            digests[place] = digest
        trie = Parentheses(depth)
        close = trie.find_close(trie.opens)
        end = trie.rank[close]  # the subtree of a node are the nodes from itself to here
        members = np.concatenate(([0], np.cumsum(ends_n)))
        n_convs = members[end] - members[nodes]
        conv_id = range_min(ends_low, nodes, end)
        n_children = np.bincount(parent[1:], minlength=size)
        n_leaves = trie.leaf_rank[close] - trie.leaf_rank[trie.opens]
        on_spine = np.zeros(size, bool)
        on_spine[: self.first + 1] = True
        on_spine[self.path] = True
        saved = np.concatenate(([0], np.cumsum(np.where(on_spine, 0, (n_convs - 1) * words))))
        saved_tokens = saved[end] - saved[nodes]
        spine = np.flatnonzero(on_spine)
        number = np.full(size, -1, np.int64)
        number[spine] = np.arange(len(spine))
        own = np.zeros((4, size), np.int64)  # what spine nodes have besides their children in the spine
        for k, v in enumerate((n_convs, n_children, n_leaves, saved_tokens)):
            own[k] = v
            below = spine[1:]
            np.subtract.at(own[k], parent[below], 1 if k == 1 else v[below])
        own[2] -= n_children == 0
        for k, v in enumerate((n_convs, n_children, n_leaves, saved_tokens)):
            v[spine] = own[k][spine]
        over = parent.clip(0)
        parent_on_spine = on_spine[over]
        null = lambda values, mask: pa.array(values, pa.int64(), mask=mask)
        made = {
            "task": pa.array(np.full(size, task)), "shard": pa.array(np.full(size, shard)), "spine": null(number, ~on_spine), "last": pa.array(nodes > self.first),
            "step": pa.array([s if o else None for s, o in zip(self.step, on_spine.tolist())], pa.binary()), "words": pa.array(words), "depth": pa.array(depth), "conv_id": pa.array(conv_id),
            "parent_conv_id": null(conv_id[over], on_spine | parent_on_spine), "parent_spine": null(number[over], on_spine | ~parent_on_spine),
            "n_convs": pa.array(n_convs), "n_children": pa.array(n_children.astype(np.int64)), "n_leaves": pa.array(n_leaves), "saved_tokens": pa.array(saved_tokens), "ends_sha256": pa.array(digests),
        }
        return pa.RecordBatch.from_arrays([made[c] for c in SHARD], schema=pa.schema(list(SHARD.items())))


def shards(pieces: DataFrame, most: int = NODES) -> DataFrame:
    """The tries of all shards from pieces of sequences: steps, piece, ids (joined), n, low and words."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        task, number, trie, now = TaskContext.get().partitionId(), 0, Shard(), None
        for b in batches:
            for r in b.to_pylist():
                if now is not None and now[0] == r["steps"]:
                    now[1].update(b"," + r["ids"].encode())
                    now[2], now[3] = now[2] + r["n"], min(now[3], r["low"])
                    continue
                if now is not None:
                    trie.add(now[0], now[4], now[2], now[3], now[1].hexdigest())
                    if len(trie.depth) >= most:
                        yield trie.rows(task, number)
                        trie, number = Shard(), number + 1
                now = [r["steps"], hashlib.sha256(r["ids"].encode()), r["n"], r["low"], r["words"]]
        if now is not None:
            trie.add(now[0], now[4], now[2], now[3], now[1].hexdigest())
            yield trie.rows(task, number)

    bounded_batches(pieces.sparkSession)
    return pieces.repartitionByRange("steps").sortWithinPartitions("steps", "piece").mapInArrow(run, SHARD_SQL)


#: Rows of the merged spine: where a shard's spine node went (node), and the merged nodes (parent, and all their numbers).
MERGED = {k: pa.int64() for k in ("task", "shard", "spine", "node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")} | {"ends_sha256": pa.string()}


def merge(spines: DataFrame) -> DataFrame:
    """One walk over the spines in order of task, shard and spine, with the path that is open as its stack."""

    def run(batches: Iterator[pa.RecordBatch]):
        stack, count, out = [], 0, []

        def closed(to: int):
            while len(stack) > to:
                x = stack.pop()
                x["n_leaves"] = x["n_leaves"] if x["n_children"] else 1
                x["saved_tokens"] += (x["n_convs"] - 1) * x["words"]
                if stack:
                    up = stack[-1]
                    up["n_children"] += 1
                    up["conv_id"] = min(up["conv_id"], x["conv_id"])
                    for k in ("n_convs", "n_leaves", "saved_tokens"):
                        up[k] += x[k]
                out.append({k: x.get(k) for k in MERGED} | {"task": None, "shard": None, "spine": None, "parent": stack[-1]["node"] if stack else None})

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in MERGED.items()], names=list(MERGED))
            out.clear()
            return made

        same = True
        for b in batches:
            for r in b.to_pylist():
                d = r["depth"]
                same = (same or d == 0) and not r["last"] and len(stack) > d and stack[d]["step"] == r["step"]
                if same:
                    x = stack[d]
                    for k in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                        x[k] += r[k]
                    x["conv_id"] = min(x["conv_id"], r["conv_id"])
                    x["ends_sha256"] = r["ends_sha256"] if r["ends_sha256"] != EMPTY else x["ends_sha256"]
                else:
                    closed(d)
                    stack.append(r | {"node": count})
                    count += 1
                out.append(dict.fromkeys(MERGED) | {k: r[k] for k in ("task", "shard", "spine")} | {"node": stack[d]["node"]})
            yield batch()
        closed(0)
        yield batch()

    kinds = ", ".join(f"{k} {'string' if t == pa.string() else 'long'}" for k, t in MERGED.items())
    return spines.repartition(1).sortWithinPartitions("task", "shard", "spine").mapInArrow(run, kinds)


def trie(conversations: DataFrame, most: int = NODES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    whole = rebuilt(turns_of(conversations))
    steps = F.unhex(F.array_join(F.transform("t", lambda x: x.digest), ""))
    sequences = whole.select("conv_id", steps.alias("steps"), F.transform("t", lambda x: x.words).alias("words"), F.shiftright("conv_id", PIECE_BITS).alias("piece"))
    pieces = sequences.groupBy("steps", "piece").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("words").alias("words"))
    pieces = pieces.select("steps", "piece", F.array_join("ids", ",").alias("ids"), F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("low"), "words")
    made = stored(shards(pieces, most), "tries")
    spines = made.where(F.col("spine").isNotNull())
    merged = stored(merge(spines.select("task", "shard", "spine", "last", "step", "words", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")), "spines")
    nodes = merged.where(F.col("task").isNull())
    numbers = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = nodes.join(parents, "parent", "left").select("conv_id", "depth", "parent_conv_id", *numbers)
    went = merged.where(F.col("task").isNotNull()).select("task", "shard", F.col("spine").alias("parent_spine"), F.col("node").alias("parent")).join(parents, "parent").drop("parent")
    inner = made.where(F.col("spine").isNull())
    hanging = inner.where(F.col("parent_spine").isNotNull()).drop("parent_conv_id").join(went, ["task", "shard", "parent_spine"])
    columns = ["conv_id", "depth", "parent_conv_id", *numbers]
    return top.select(columns).unionByName(hanging.select(columns)).unionByName(inner.where(F.col("parent_spine").isNull()).select(columns))
