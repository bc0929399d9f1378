"""Operator 5 against brute force."""

import hashlib
import random

from crosspanel.llm import chunks, suffix_dedup
from crosspanel.llm.common import BATCH_ROWS
from tests.llm.helpers import documents
from tests.llm.test_simple_ops import data, rows


def brute(docs, span=50):
    docs = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, t in docs:
        for k in range(len(t) - span + 1):
            w = t[k : k + span]
            first[w] = min(i, first.get(w, i))
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - span + 1):
            if first[t[k : k + span]] < i:
                gone[k : k + span] = b"\1" * span
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), bytes([0, *gone]).count(b"\0\1"), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(docs):
    got = rows(suffix_dedup.remove_repeats(docs, keep_text=False))
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    return want


def test_op5_table(spark):
    assert sum(w[2] for w in check(data(spark, "/root/testdata/sf0.001").repartition(3))) > 1000


def test_op5_awkward(spark):
    check(documents(spark).where("length(text) < 30000 or text is null"))
    assert rows(suffix_dedup.remove_repeats(documents(spark, []))) == []


def test_op5_random_overlaps(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("ab ") for _ in range(rng.randrange(20, 160))) for _ in range(12)]
    made = []
    for i in range(120):
        text = "".join(rng.choice([rng.choice(base), rng.choice(base)[: rng.randrange(80)], rng.choice(base)[rng.randrange(60) :], "é", "x" * rng.randrange(70)]) for _ in range(rng.randrange(6)))
        made.append((rng.randrange(10**6), text))
    want = check(spark.createDataFrame(made, "doc_id long, text string").repartition(5))
    assert sum(w[2] for w in want) > 1000


def test_chunk_begins_with_a_batch(spark):
    made = [(i, "ab") for i in range(BATCH_ROWS)] + [(BATCH_ROWS, "x" * 1000)] + [(BATCH_ROWS + 1 + i, "cd") for i in range(BATCH_ROWS)]
    table = chunks.chunked(spark.createDataFrame(made, "doc_id long, text string").coalesce(1), "test_chunks", 2 * BATCH_ROWS + 500)
    got = [list(zip(*chunks.texts_in(r.texts))) for r in table.orderBy("chunk").collect()]
    assert [len(g) for g in got] == [BATCH_ROWS, 1 + 750, 250]
    assert [(i, t.decode()) for g in got for i, t in g] == made
