"""Operator 2 against brute force."""

import random

import numpy as np

from pyspark.sql import functions as F

from crosspanel.llm import common, near_dup
from tests.llm.helpers import documents
from tests.llm.test_simple_ops import WORDS, data, rows


def brute(docs, size=4):
    sets = {}
    for i, text in docs:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids, where = sorted(sets), {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    near = {(a, b) for v in where.values() for a in v for b in v if a < b}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def check(spark, docs):
    got = rows(near_dup.near_duplicates(docs, 4))
    assert sorted({(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got}) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return got


def test_op2_awkward_and_tables(spark):
    assert len(check(spark, documents(spark))) == 10
    check(spark, data(spark, "/root/testdata/sf0.01"))
    assert rows(near_dup.near_duplicates(documents(spark, []), 4)) == []


def test_op2_large_bucket(spark, monkeypatch):
    """One text in many slightly different copies: more than a small bucket, and pivots that miss some."""
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 3)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    made = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randrange(7)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        made.append((i, " ".join(t)))
    check(spark, spark.createDataFrame(made, "doc_id long, text string"))


def test_op2_hot_keys_are_dealt(spark, monkeypatch):
    """The same groups where every band, pivot, label and side of a pair of a few rows counts as hot: results are those of brute force."""
    monkeypatch.setattr(common, "LEAST_HOT", 2)
    monkeypatch.setattr(common, "SHARES", 10**6)
    dealt = []
    plain = common.hot_keys
    monkeypatch.setattr(near_dup, "hot_keys", lambda *a, **k: dealt.append((a[1], plain(*a, **k))) or dealt[-1][1])
    test_op2_large_bucket(spark, monkeypatch)
    assert {"band", "a", "b", "pivot", "label"} <= {key for key, hot in dealt if hot is not None}


def test_met_spreads_a_hot_key(spark):
    """A key with a third of the rows: as plain a join, in parts of at most a few shares; hot keys are fewer than the shares."""
    rows = spark.range(30000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.max("id").alias("top"))
    hot = common.hot_keys(rows, "k")
    share = 30000 / (common.SHARES * 4)
    assert [(r.k, r._salts) for r in hot.collect()] == [(-1, -(-10000 // int(share + 1)))]
    for h in (hot, None):
        got = common.met(rows, facts, "k", h, "id")
        assert got.columns == ["k", "id", "top"] and got.exceptAll(rows.join(facts, "k")).isEmpty() and got.count() == 30000
    salt = F.pmod(F.xxhash64("id"), F.lit(hot.first()._salts))
    assert rows.where("k = -1").groupBy(salt).count().agg(F.max("count")).first()[0] < 1.2 * share
    assert common.hot_keys(rows.where("k > 0"), "k") is None and common.hot_keys(rows.limit(0), "k") is None


def test_op2_one_id_on_several_texts(spark):
    """Whatever the order of the rows, each row links as its own text."""
    z, w = " ".join(f"z{k}" for k in range(60)), " ".join(f"w{k}" for k in range(60))
    made = [(5, z), (5, w), (7, z + " more"), (1, w), (None, z), (None, None)]
    for seed in range(4):
        random.Random(seed).shuffle(made)
        docs = spark.createDataFrame(made, "doc_id long, text string").repartition(2)
        got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in rows(near_dup.near_duplicates(docs, 4)))
        assert got == [(0, 0, 0), (0, 57, 0), (1, 57, 1), (5, 57, 1), (5, 57, 5), (7, 58, 5)]
        left = [(r["doc_id"], r["text"]) for r in rows(near_dup.deduplicated(docs, 4))]
        assert near_dup.deduplicated(docs.selectExpr("*", "1 as gone_id", "2 as _gone_id", "3 as kept"), 4).count() == len(left)
        assert sorted(left, key=str) == sorted([(1, w), (5, z), (5, w), (None, z), (None, None)], key=str)


def test_op2_likelihood_and_merge():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate((a[:900], rng.integers(0, 2**63, 100).astype(np.uint64))))
    ra, rb = near_dup.registers(a), near_dup.registers(b)
    union = near_dup.registers(np.union1d(a, b))
    assert (np.maximum(ra, rb) == union).all()
    est = near_dup.likeliest(np.array([len(a)]), np.array([len(b)]), np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]))
    assert abs(est[0] - 900 / 1100) < 0.12
