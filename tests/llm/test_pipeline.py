"""The pipeline against the operators' plain functions, one document at a time."""

import hashlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from crosspanel.llm import bpe, decontaminate, fm_quality, secrets
from tests.llm.test_near_dup import brute
from tests.llm.test_simple_ops import data, rows


def test_pipeline(spark):
    d = "/root/testdata/sf0.01"
    docs = data(spark, d)
    machine = fm_quality.train(docs, data(spark, d, "labels"))
    left = {r.doc_id: r.text for r in docs.collect()}
    scores = machine.scores([fm_quality.vector(t) for t in left.values()])
    left = {i: t for (i, t), s in zip(left.items(), scores) if s >= 0.3}
    left = {i: left[i] for i, _, c in brute(left.items(), 5) if i == c}
    automaton = decontaminate.Automaton([(r.item_id, decontaminate.words_of(r.text)) for r in data(spark, d, "benchmark").collect()])
    enc, want = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), []
    for i, text in left.items():
        words = decontaminate.words_of(text)
        hit, _ = automaton.hits(words)
        if hit.sum() > 0.5 * len(words):
            continue
        text = decontaminate.without(text, hit)
        text = secrets.redact(text, secrets.base_spans(text) + secrets.confirmed_spans(text))
        want.append((i, hashlib.sha256(np.array(enc.encode_ordinary(text), "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = rows(corpus_pipeline.run(spark, d))
    assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert 300 < len(want) < 1000


def test_pipeline_stages_keep_columns_and_nulls(spark):
    d = "/root/testdata/sf0.001"
    long = " ".join(f"{w}{k}" for k in range(30_000) for w in ("walk", "stone", "green"))
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, long, "en", "s", 1), (10**9 + 2, long, "en", "s", 1), (None, long, "en", "s", 1)], data(spark, d).schema)
    clashing = [F.lit(k).alias(n) for k, n in enumerate(("gone_id", "kept", "hits", "items", "score", "component_id", "n_words", "chunk", "id", "quality"))]
    docs = data(spark, d).unionByName(odd).select("*", *clashing)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
        stage(spark, docs, d).count()
        assert stage(spark, docs.limit(0), d).count() == 0
    out = {r.doc_id: r.text for r in corpus_pipeline.without_secrets(spark, docs, d).collect()}
    assert out[10**9] is None and not any("token = \"" in (t or "") and secrets.base_spans(t) for t in out.values())
