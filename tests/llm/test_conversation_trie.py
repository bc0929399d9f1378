"""Operator 12 against a plain trie of tuples."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from crosspanel.llm import conversation_trie, queries


def brute(rows):
    turns = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    children = {}
    for v in members:
        if v:
            children.setdefault(v[:-1], []).append(v)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for v, some in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", v[-1][1])) if v else 0
        for d in range(len(v) + 1):
            leaves[v[:d]] += v not in children
            saved[v[:d]] += (len(some) - 1) * words
    sha = lambda v: hashlib.sha256(",".join(map(str, sorted(c for c in members[v] if made[c] == v))).encode()).hexdigest()
    return sorted((len(v), min(some), min(members[v[:-1]]) if v else -1, len(some), len(children.get(v, [])), leaves[v], saved[v], sha(v)) for v, some in members.items())


def got(df):
    return sorted((r.depth, r.conv_id, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_parentheses():
    rng = random.Random(1)
    for n in (1, 2, 70, 500, 3000):
        depth = [0]
        while len(depth) < n:
            depth.append(rng.randint(1, depth[-1] + 1) if rng.random() < 0.4 else depth[-1] + 1)
        trie = conversation_trie.Parentheses(np.array(depth))
        close = trie.find_close(trie.opens)
        for v in rng.sample(range(n), min(n, 200)):
            end = next((k for k in range(v + 1, n) if depth[k] <= depth[v]), n)
            assert trie.rank[close[v]] == end
            assert trie.leaf_rank[close[v]] - trie.leaf_rank[trie.opens[v]] == sum(k + 1 == n or depth[k + 1] <= depth[k] for k in range(v, end))
    values = np.array([rng.randrange(99) for _ in range(50)])
    spans = [(a, b) for a in range(50) for b in range(a + 1, 51)]
    assert conversation_trie.range_min(values, *np.array(spans).T).tolist() == [values[a:b].min() for a, b in spans]


@pytest.mark.parametrize("most", [200_000, 3])
def test_random(spark, most):
    """Few different turns make deep shared spines; with shards of few nodes most nodes are merged. Half of the conversations are equal."""
    rng = random.Random(2)
    rows = []
    for c in rng.sample(range(400), 250):
        same = rng.random() < 0.5
        for t in range(9 if same else rng.randrange(1, 12)):
            rows.append((c, t, "user" if t % 2 else "bot", f"hello {t} again" if same else rng.choice(["a", "b c", "", "d e f"])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(conversation_trie.trie(df, most)) == brute(rows)


def test_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert got(queries.op12_conversation_trie(spark, sf_dir)) == brute(rows)


def test_awkward(spark):
    rows = [(None, 1, "a", "x"), (20, None, "u", "first"), (20, 0, None, "second one"), (20, 0, None, "second one"), (20, 0, "u", None), (21, 5, "u", "x " * 50_000), (21, 3, "b", "　"), (45, 1, "u", "only"), (47, 2, "u", "only"), (10**12 + 1, 0, "u", "far")]
    rows += [(60, t, "u", "long") for t in range(150)] + [(61, t, "u", "long") for t in range(140)] + [(c, 0, "u", "one") for c in range(100_000, 100_040)]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "conv_id long, turn long, role string, text string, depth int, words string")
    assert got(conversation_trie.trie(df)) == brute(rows)
    assert got(conversation_trie.trie(df, 40)) == brute(rows)
    assert conversation_trie.trie(df.limit(0)).collect() == []
