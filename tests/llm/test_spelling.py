"""Operator 11 against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from crosspanel.llm import queries, spelling
from tests.llm.helpers import documents


def brute_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if n >= 2 and len(w) >= 7}


def brute_groups(words, times=10):
    near = {w: set() for w in words}
    twins = {}
    for w in words:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            twins.setdefault((i, cut), []).append(w)
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
    for some in twins.values():
        for w in some:
            near[w] |= set(some) - {w}
    form = {}
    for w, some in near.items():
        if some:
            best = min(some, key=lambda x: (-words[x], x))
            if words[best] >= times * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("most", [8192, 3])
def test_random_words(spark, most):
    """Few letters make nearly all words near; with small blocks every split is used."""
    rng = random.Random(11)
    words = {}
    for _ in range(700):
        words["".join(rng.choice("abé") for _ in range(rng.choice([7, 7, 8, 8, 9, 12])))] = rng.choice([2, 3, 30, 30, 500, 6000])
    words |= {"x" * n: 2 for n in (7, 8, 10, 3000, 3001)} | {"x" * 2999 + "yz": 40}
    assert got(spelling.grouped(spark.createDataFrame(list(words.items()), "word string, n long"), most=most)) == brute_groups(words)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_groups(brute_words((r.doc_id, r.text) for r in docs.collect()))
    assert got(queries.op11_spelling_variants(spark, sf_dir)) == want and sum(r[1] is not None for r in want) > 5


def test_awkward(spark):
    odd = [(None, "Straßenbahn straßenbahn", "de"), (None, None, "de"), (8, "ÀÉÎõü÷× ÀÉÎõü÷× Lettern lettern", "fr"), (10, "lettern Letternx", "de"), (11, "letterz letterz" + " lettern" * 20, "de")] * 2
    docs = documents(spark, [(1, None, "en"), (2, "", "en"), (9, "x" * 20000, "en"), (9, "x" * 20000, "en"), *odd])
    assert got(spelling.variants(docs)) == brute_groups(brute_words((r.doc_id, r.text) for r in docs.collect()))
    assert got(spelling.variants(docs.limit(0))) == []
