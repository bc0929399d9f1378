"""Operator 13 against a plain search over the groups one by one."""

import random
import zlib

import pytest

from crosspanel.llm import queries, sharding
from tests.llm.helpers import documents


def shards_needed(groups, capacity):
    """Filling in order; a group above the capacity stands alone."""
    n, held = 0, None
    for g in groups:
        if held is not None and held + g <= capacity:
            held += g
        else:
            n, held = n + 1, g
    return n


def brute_capacity(groups, shards):
    low, high = 1, sum(groups)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if shards_needed(groups, middle) <= shards else (middle + 1, high)
    return low


def check(rows, docs, shards):
    """Rows, groups, slots and the least largest shard; `docs` are (doc_id, text, hash)."""
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in docs)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want
    assert all(r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None for r in rows)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    for some in by_shard.values():
        some.sort(key=lambda r: r.slot)
        assert [r.slot for r in some] == list(range(len(some)))
        ids = [(r.doc_id is not None, r.doc_id or 0) for r in some]
        assert ids == sorted(ids)
    homes = {}
    for r in rows:
        homes.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in homes.values())
    groups = {}
    for _, t, h in docs:
        groups[h] = groups.get(h, 0) + len((t or "").encode()) + 8
    ordered = [groups[h] for h in sorted(groups)]
    largest = max(sum(r.size for r in some) for some in by_shard.values())
    capacity = brute_capacity(ordered, shards)
    assert largest <= max(capacity, max(ordered))
    return by_shard, ordered


def hashed(docs):
    return [(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", sharding.text_hash().alias("h")).collect()]


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    by_shard, ordered = check(queries.op13_sharding(spark, d).collect(), hashed(docs), 24)
    total = [sum(r.size for r in some) for some in by_shard.values()]
    assert len(total) == 24 and max(total) - min(total) <= 2 * max(ordered)


@pytest.mark.parametrize("first_bits", [1, 12])
def test_random_sizes(spark, first_bits):
    """Few first blocks make many rounds; sizes with giants, ties and one hash for a third of all rows."""
    rng = random.Random(13)
    for shards, n in ((1, 5), (3, 40), (7, 300), (24, 20), (24, 900)):
        rows = [(rng.getrandbits(64) - 2**63, rng.choice([8, 9, 40, 500, 20_000 if rng.random() < 0.02 else 100])) for _ in range(n)]
        rows += [(rows[0][0], 50)] * (n // 2)
        groups = {}
        for h, size in rows:
            groups[h] = groups.get(h, 0) + size
        ordered = [groups[h] for h in sorted(groups)]
        df = spark.createDataFrame(rows, "h long, size long")
        blocks, capacity = sharding.minimax(df, shards, first_bits)
        assert capacity == brute_capacity(ordered, shards)
        cuts = sharding.even_cuts(blocks, capacity, shards)
        assert cuts == sorted(cuts) and len(cuts) < shards
        totals, counts = {}, {}
        for h, size in groups.items():
            s = sum(c <= h for c in cuts)
            totals[s], counts[s] = totals.get(s, 0) + size, counts.get(s, 0) + 1
        assert all(t <= capacity or counts[s] == 1 for s, t in totals.items())


def test_awkward(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(None, "a", "en", 0, "k"), (None, None, "en", 0, "k"), (8, "b", "en", 0, "k")], documents(spark).schema))
    check(sharding.assigned(docs, 24).collect(), hashed(docs), 24)
    check(sharding.assigned(docs, 3).collect(), hashed(docs), 3)
    assert sharding.assigned(docs.limit(0)).collect() == []
    one = sharding.assigned(docs.where("doc_id = 9"), 24).collect()
    assert len({r.shard for r in one}) == 1 and sorted(r.slot for r in one) == [0, 1]
    cuts = sharding.plan(docs, 3)
    again = {(r.doc_id, r.text): r.shard for r in sharding.with_shard(docs, cuts).collect()}
    assert len(again) == docs.select("doc_id", "text").distinct().count()
