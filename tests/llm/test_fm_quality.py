"""Operator 4: held-out accuracy, the linear-time identity and the awkward cases."""

import zlib

import numpy as np

from crosspanel.llm import fm_quality as fm
from tests.llm.helpers import documents
from tests.llm.test_simple_ops import data, rows


def test_op4_pairwise_identity():
    m = fm.Machine()
    m.factors = np.random.default_rng(3).normal(0, 1, m.factors.shape).astype(np.float32)
    index, value = fm.vector("some words make pairs\nand more")
    z = m.sums(index, value, np.array([0]))[0][0]
    want = sum(float(m.factors[i] @ m.factors[j]) * a * b for k, (i, a) in enumerate(zip(index, value)) for j, b in list(zip(index, value))[k + 1 :])
    assert abs(z - want) < 1e-3 * max(1, abs(want))


def test_op4_scores_of_a_table_by_all_pairs(spark, sf_dir):
    """Bias, linear terms and every pair of features, one after the other."""
    docs = documents(spark).select("doc_id", "text").where("length(text) < 3000 or text is null").union(data(spark, sf_dir).select("doc_id", "text").where("n_chars < 500"))
    m = fm.train(data(spark, sf_dir), data(spark, sf_dir, "labels"))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = sorted((r["doc_id"], r["score"]) for r in rows(fm.classify(docs, m)))
    want = []
    for i, t in texts:
        index, value = fm.vector(t)
        f = m.factors[index].astype(float) * value[:, None].astype(float)
        pairs = sum(float(f[a] @ f[b]) for a in range(len(f)) for b in range(a + 1, len(f)))
        want.append((i, 1 / (1 + np.exp(-(m.bias + float(m.linear[index].astype(float) @ value.astype(float)) + pairs)))))
    assert m.fitted and len(got) == len(want) > 25
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-4 for a, b in zip(got, sorted(want)))


def test_op4_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in rows(fm.train_and_classify(data(spark, d), data(spark, d, "labels")))}
    assert len(got) == data(spark, d).count()
    labels = [(got[r.doc_id], r.quality) for r in data(spark, d, "labels").collect() if got[r.doc_id]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    right = [r["predicted"] == q for r, q in labels]
    good = np.array([r["score"] for r, q in labels if q])
    bad = np.array([r["score"] for r, q in labels if not q])
    auc = (good[:, None] > bad[None, :]).mean()
    print("accuracy", np.mean(right), "auc", auc, "bad kept", (bad >= 0.3).mean(), "good lost", (good < 0.3).mean())
    assert np.mean(right) > 0.95 and auc > 0.97


def test_op4_fits_on_one_row_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(fm.Machine, "fit", lambda self, vectors, labels: seen.append(len(vectors)) or self)
    docs = spark.range(3000).selectExpr("1 as doc_id", "concat('text ', id) as text").union(spark.createDataFrame([(2, "a"), (3, None)], "doc_id int, text string"))
    fm.train(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 1), (6, 1)], "doc_id long, quality int"))
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 2, 3))]


def test_op4_awkward(spark, sf_dir):
    got = rows(fm.train_and_classify(documents(spark), data(spark, sf_dir, "labels").limit(0)))
    assert len(got) == 10 and all(r["score"] == fm.PRIOR for r in got)
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, None), (None, 1), (3, 1), (9, 0), (1, 0)], "doc_id long, quality int")
    got = rows(fm.train_and_classify(documents(spark), labels))
    assert all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert rows(fm.train_and_classify(documents(spark, []), labels)) == []
