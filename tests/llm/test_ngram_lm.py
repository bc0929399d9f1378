"""Operator 6 against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from crosspanel.llm import chunks, ngram_lm
from tests.llm.helpers import documents
from tests.llm.test_simple_ops import WORDS, data, rows


def brute(docs):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = [(i, [*WORDS.findall(low(t)), None]) for i, t in docs]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    one, two, three = Counter(), Counter(), Counter()
    for i, t in tokens:
        if not held(i):
            one.update(t)
            two.update(zip([None, *t[:-1]], t))
            three.update(zip([None, *t[:-2]], t[:-1], t[1:]))
    n, v, mu, d = sum(one.values()), len(one), ngram_lm.MU, ngram_lm.D
    kinds = Counter((a, b) for a, b, _ in three)
    out = []
    for i, t in tokens:
        total, state = 0.0, (None,) if one[None] else ()
        for last, w in zip([None, *t], t):
            p1 = (one[w] + 0.5) / (n + 0.5 * (v + 1))
            p2 = lambda h, w=w, p1=p1: (two[h, w] + mu * p1) / (one[h] + mu)
            while True:  # failure arcs until a state has an arc for the word
                if len(state) == 2:
                    if three[*state, w]:
                        total += math.log10((three[*state, w] - d) / two[state] + d * kinds[state] / two[state] * p2(state[1]))
                        break
                    total += math.log10(d * kinds[state] / two[state])
                elif len(state) == 1:
                    if two[*state, w]:
                        total += math.log10(p2(state[0]))
                        break
                    total += math.log10(mu / (one[state[0]] + mu))
                else:
                    total += math.log10(p1)
                    break
                state = state[1:]
            state = (last, w) if two[last, w] else (w,) if one[w] else ()
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out.append((i, held(i), len(t), sum(one[w] > 0 for w in t), n, round(base, 6), round(total, 6)))
    return sorted(out)


def check(docs):
    got = rows(ngram_lm.score(docs))
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert sorted((*(r[k] for k in names), round(r["base_score"], 6), round(r["score"], 6)) for r in got) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    return got


def test_op6_tables_and_awkward(spark):
    got = check(data(spark, "/root/testdata/sf0.01"))
    held = [r for r in got if r["held_out"]]
    # above the base and above the -294,929 of a bigram model
    assert sum(r["score"] for r in held) > max(sum(r["base_score"] for r in held), -294_929)
    print("held out", sum(r["score"] for r in held), sum(r["base_score"] for r in held))
    check(documents(spark))
    assert rows(ngram_lm.score(documents(spark, []))) == []


def test_op6_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "CHUNK_BYTES", 20_000)
    check(data(spark, "/root/testdata/sf0.001").repartition(3))


def test_op6_messages_grow_with_the_corpus(spark, monkeypatch):
    """The number of buckets does not depend on the number of chunks, and no bucket has far more keys than another."""
    monkeypatch.setattr(ngram_lm, "CHUNK_BYTES", 50_000)
    docs = data(spark, "/root/testdata/sf0.01").repartition(2)
    per_chunk = []
    for some in (docs.where("doc_id % 4 = 0"), docs):
        table = chunks.chunked(some, "test_chunks", ngram_lm.CHUNK_BYTES)
        sent = ngram_lm._asked(table, chunks.buckets_for(spark))
        per_chunk.append(sent.count() / table.count())
    assert abs(per_chunk[0] - per_chunk[1]) < 0.1 * per_chunk[1] and per_chunk[1] <= chunks.buckets_for(spark)
    sizes = [r.n for r in sent.groupBy("bucket").agg(F.sum(F.length("pairs")).alias("n")).collect()]
    assert max(sizes) < 1.5 * sum(sizes) / len(sizes)


def chunk_of(texts, train=3):
    """A chunk of texts whose ids are all learnt from."""
    ids = [i for i in range(10 * len(texts)) if not ngram_lm.is_held_out(i)][: len(texts)]
    sink = pa.BufferOutputStream()
    made = pa.table({"doc_id": ids, "text": texts})
    with pa.ipc.new_stream(sink, made.schema) as out:
        out.write_table(made)
    return ngram_lm.Chunk(zstandard.ZstdCompressor().compress(sink.getvalue().to_pybytes()))


def counts_of(it):
    c, c2 = np.bincount(it.token).astype(float), np.bincount(it.pair).astype(float)
    return c, c2, np.bincount(it.owner, minlength=len(it.pairs)).astype(float), np.bincount(it.triple, minlength=len(it.marks)).astype(float)


def test_op6_each_state_sums_to_one():
    """From any state, over all words with the unknown one: the scores of two-word texts that differ in their last token."""
    texts = ["a b c", "a b d", "a b", "b a", "c c c"]
    it = chunk_of(texts)
    c, c2, kinds, c3 = counts_of(it)
    n, v = c.sum(), (c > 0).sum()
    p1 = (c + 0.5) / (n + 0.5 * (v + 1))
    assert abs(p1.sum() + 0.5 / (n + 0.5 * (v + 1)) - 1) < 1e-12
    unknown = 0.5 / (n + 0.5 * (v + 1))
    pair_of = {(b, t): k for b, t, k in zip(it.before, it.token, it.pair)}
    p2 = lambda h, w: ((c2[pair_of[h, w]] if (h, w) in pair_of else 0) + ngram_lm.MU * (p1[w] if w is not None else unknown)) / (c[h] + ngram_lm.MU)
    words = [*range(len(c)), None]
    for h in range(len(c)):
        assert abs(sum(p2(h, w) for w in words) - 1) < 1e-12
    inner = np.flatnonzero(it.inner)
    seen = {(it.pair[i - 1], it.token[i]): c3[k] for i, k in zip(inner, it.triple)}
    for (_, b), pair in pair_of.items():
        if b == it.end:
            continue
        p3 = lambda w: max(seen.get((pair, w), 0) - ngram_lm.D, 0) / c2[pair] + ngram_lm.D * kinds[pair] / c2[pair] * p2(b, w)  # noqa: B023, E731
        assert abs(sum(p3(w) for w in words) - 1) < 1e-12


def test_op6_failure_arcs_matter():
    it = chunk_of(["a b c", "a b d", "x y z", "b a"])
    counts = counts_of(it)
    with_arcs, without = it.scores(*counts, 14, 8)["score"], it.scores(*counts, 14, 8, failures=False)["score"]
    held = chunk_of(["a b c", "a b d", "x y z", "b a", "a b z"])
    assert (with_arcs <= without + 1e-12).all()
    c, c2, kinds, c3 = counts_of(held)
    last = slice(held.begin[4], None)
    c[np.unique(held.token[last])] -= np.bincount(held.token[last])[np.unique(held.token[last])]
    for a, at in ((c2, held.pair[last]), (c3, held.triple[-3:])):
        np.subtract.at(a, at, 1)
    kinds = np.bincount(held.owner, c3 > 0, minlength=len(held.pairs))
    assert held.scores(c, c2, kinds, c3, 14, 8)["score"][4] < held.scores(c, c2, kinds, c3, 14, 8, failures=False)["score"][4] - 0.1
