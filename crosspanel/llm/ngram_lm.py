"""Language-model scores with a weighted backoff automaton (operator 6).

The model is a smoothed trigram model. Its automaton has three kinds of states: pairs of words seen as a history, words
seen as a history, and the root. With c for counts in the training documents and t(h) for the different words seen after
a history h,

* the root has an arc for every word, of probability p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1));
* the state of a word v has an arc for each word seen after it, of p2(w) = (c(vw) + MU p1(w)) / (c(v) + MU), and a
  failure arc to the root, of weight MU / (c(v) + MU);
* the state of a pair uv has an arc for each word seen after it, discounted by D: p3(w) = (c(uvw) - D) / c(uv) +
  D t(uv) / c(uv) p2(w), and a failure arc to the state of v, of weight D t(uv) / c(uv).

Over all words with the unknown one, each state's probabilities add up to 1. A text runs through once from left to
right. Before each token the text is in the longest history that is a state; it takes failure arcs until a state has
an arc for the token, adds up the logarithms of all arcs taken, and goes on in the longest state that ends in the token.

No task holds the whole automaton, which grows with the corpus: counts are summed in hash buckets of words and of pairs,
where all words after one pair meet, and each chunk of documents gets back the states and arcs that its own texts can take.
Words have 64-bit keys and pairs 56-bit ones; words after a pair are told apart by 32 bits.

Defined cases: a null or empty text is scored as the end alone; documents with null ids are learnt from and scored, not
held out; without training documents N and V are 0 and every token has the probability of an unknown one; repeated rows
count as often as they stand; an empty table gives an empty table; other columns play no part; a very long text makes a
chunk of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm import chunks as C
from crosspanel.llm.common import arrow_rows, stored
from crosspanel.llm.near_dup import LOWER, MIX, mixed

MU, D = 5.0, 0.75
END = b"\n"  # no word holds a line break
CHUNK_BYTES = 12 << 20
#: Pairs have 56-bit keys, at the top of 64, as their bytes make up most of what is sent.
PAIR_KEY = np.uint64((1 << 64) - (1 << 8))
#: What a chunk sends to a bucket, and what it gets back: counts of words, of pairs and of words after pairs, and t.
SENT = ("words", "word_counts", "pairs", "pair_counts", "followers", "marks", "mark_counts")
BACK = ("words", "pairs", "kinds", "triples")


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and each key's place in it."""
    order = np.argsort(keys)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return order, place


class Chunk:
    """Tokens of a chunk's texts as numbers, with its distinct words and pairs under sorted keys, and the words after each pair."""

    def __init__(self, data: bytes):
        self.ids, texts = C.texts_in(data)
        known: dict[bytes, int] = {END: 0}
        tokens, sizes = [], []
        for t in texts:
            words = t.translate(LOWER).split()
            tokens.append(np.array([known.setdefault(w, len(known)) for w in words] + [0], np.int32))
            sizes.append(len(words) + 1)
        self.sizes = np.array(sizes, np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.held = np.array([is_held_out(i) for i in self.ids], bool)
        hashes = mixed(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known)))
        order, place = _ranked(hashes)
        self.words = hashes[order]
        self.end = place[0]
        self.token = place[np.concatenate(tokens)]
        # the word before each token; a text begins after an end, so that the end's count is that of the beginnings too
        self.before = np.concatenate((self.token[:1], self.token[:-1]))
        self.before[self.begin] = self.end
        pair, number = np.unique(self.before.astype(np.int64) * len(order) + self.token, return_inverse=True)
        keys = mixed(mixed(self.words[pair // len(order)] + MIX) ^ self.words[pair % len(order)]) & PAIR_KEY
        order, place = _ranked(keys)
        self.pairs, self.pair = keys[order], place[number]
        # the pair before each token but the first of a text, and the token, told by 32 bits
        self.inner = np.ones(len(self.token), bool)
        self.inner[self.begin] = False
        history = np.concatenate((self.pair[:1], self.pair[:-1]))[self.inner]
        mark = mixed(self.words + MIX)[self.token[self.inner]] >> np.uint64(32)
        triples, triple = np.unique(history.astype(np.uint64) << np.uint64(32) | mark, return_inverse=True)
        self.history, self.triple = history, triple.astype(np.int32)
        self.owner = (triples >> np.uint64(32)).astype(np.int64)
        self.marks = triples.astype(np.uint32)
        self.learnt = np.repeat(~self.held, self.sizes)

    def messages(self, buckets: int) -> list[tuple[int, dict[str, bytes]]]:
        """For each bucket the keys that fall to it and their counts in the chunk's training documents."""
        c, c2 = np.bincount(self.token[self.learnt], minlength=len(self.words)), np.bincount(self.pair[self.learnt], minlength=len(self.pairs))
        c3 = np.bincount(self.triple[self.learnt[self.inner]], minlength=len(self.marks))
        followers = np.bincount(self.owner, minlength=len(self.pairs))
        e, f = C.bucket_edges(self.words, buckets), C.bucket_edges(self.pairs, buckets)
        g = np.searchsorted(self.owner, f)
        out = []
        for k in range(buckets):
            w, p, t = slice(e[k], e[k + 1]), slice(f[k], f[k + 1]), slice(g[k], g[k + 1])
            if w.start < w.stop or p.start < p.stop:
                packed = (C.pack_sorted(self.words[w]), C.pack(c[w]), C.pack_sorted(self.pairs[p]), C.pack(c2[p]), C.pack(followers[p].astype(np.uint32)), C.pack(self.marks[t]), C.pack(c3[t]))
                out.append((k, dict(zip(SENT, packed))))
        return out

    def scores(self, c: np.ndarray, c2: np.ndarray, kinds: np.ndarray, c3: np.ndarray, total: int, distinct: int, failures: bool = True) -> dict:
        """One traversal of every text, given the corpus counts of its words, pairs and triples. Without `failures` these arcs cost nothing, which is for tests."""
        p1 = (c + 0.5) / (total + 0.5 * (distinct + 1))
        root = np.log10(p1)[self.token]
        n1, n2 = c[self.before], c2[self.pair]
        p2 = (n2 + MU * p1[self.token]) / (n1 + MU)
        to_root = np.log10(MU / (n1 + MU)) * failures
        # from the state of a word: its arc, or the failure arc and the root's arc
        taken = np.where(n2 > 0, np.log10(p2), to_root + root)
        # from the state of a pair, where the pair before was seen and so is a state: its arc, or the failure arc and what the word's state gives
        h, n3 = c2[self.history], c3[self.triple]
        state = h > 0
        back = D * np.divide(kinds[self.history], h, out=np.ones(len(h)), where=state)
        arc = np.divide(n3 - D, h, out=np.zeros(len(h)), where=state) + back * p2[self.inner]
        down = np.where(state, np.log10(back, where=state, out=np.zeros(len(h))), 0.0) * failures
        has_arc = state & (n3 > 0)
        taken[self.inner] = np.where(has_arc, np.log10(arc, where=has_arc, out=np.zeros(len(h))), down + taken[self.inner])
        return {
            "doc_id": self.ids,
            "held_out": self.held,
            "n_tokens": self.sizes,
            "n_known": np.add.reduceat((c > 0)[self.token].astype(np.int64), self.begin),
            "train_tokens": np.full(len(self.ids), total, np.int64),
            "base_score": np.add.reduceat(root, self.begin),
            "score": np.add.reduceat(taken, self.begin),
        }


def _asked(table: DataFrame, buckets: int) -> DataFrame:
    types = {"bucket": pa.int32(), "chunk": pa.int64(), **{k: pa.binary() for k in SENT}}

    def run(batches):
        for b in batches:
            for chunk, data in zip(b.column(0), b.column(1)):
                sent = Chunk(data.as_py()).messages(buckets)
                yield arrow_rows({"bucket": [k for k, _ in sent], "chunk": [chunk.as_py()] * len(sent), **{c: [m[c] for _, m in sent] for c in SENT}}, types)

    return table.select("chunk", "texts").mapInArrow(run, "bucket int, chunk long, " + ", ".join(f"{k} binary" for k in SENT))


def _joined(t: pa.Table, name: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The packed numbers of all rows, and where each row's end."""
    made = [C.unpack(x.as_py(), dtype) for x in t[name]]
    return np.concatenate(made), np.cumsum([len(x) for x in made])


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the number of each key among them, and the sums of their counts."""
    distinct, number = np.unique(keys, return_inverse=True)
    return distinct, number, np.bincount(number, counts.astype(np.float64), minlength=len(distinct)).astype(np.uint64)


def _answer(t: pa.Table) -> pa.Table:
    """Sums over all chunks of one bucket, in the order in which each chunk sent its keys."""
    t = t.sort_by("chunk")
    keys = lambda name: [C.unpack_sorted(x.as_py()) for x in t[name]]
    words, pairs = keys("words"), keys("pairs")
    _, word, c = _sums(np.concatenate(words), _joined(t, "word_counts", np.int64)[0])
    distinct, pair, c2 = _sums(np.concatenate(pairs), _joined(t, "pair_counts", np.int64)[0])
    followers, _ = _joined(t, "followers", np.uint32)
    marks, ends = _joined(t, "marks", np.uint32)
    owner = np.repeat(pair, followers).astype(np.uint64) << np.uint64(32)
    triples, triple, c3 = _sums(owner | marks, _joined(t, "mark_counts", np.int64)[0])
    kinds = np.bincount((triples >> np.uint64(32)).astype(np.int64), c3 > 0, minlength=len(distinct)).astype(np.uint64)
    split = lambda x, parts: [C.pack(v) for v in np.split(x, np.cumsum([len(p) for p in parts])[:-1])]
    once = lambda n: [int(n), *[0] * (t.num_rows - 1)]
    made = {"chunk": t["chunk"].to_pylist(), "bucket": t["bucket"].to_pylist(), "words": split(c[word], words), "pairs": split(c2[pair], pairs), "kinds": split(kinds[pair], pairs), "triples": [C.pack(v) for v in np.split(c3[triple], ends[:-1])], "tokens": once(c.sum()), "known": once((c > 0).sum())}
    types = {"chunk": pa.int64(), "bucket": pa.int32(), **{k: pa.binary() for k in BACK}, "tokens": pa.int64(), "known": pa.int64()}
    return pa.Table.from_batches([arrow_rows(made, types)])


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    table = C.chunked(docs, "lm_chunks", CHUNK_BYTES)
    asked = _asked(table, C.buckets_for(docs.sparkSession))
    answers = stored(asked.groupBy("bucket").applyInArrow(_answer, "chunk long, bucket int, " + ", ".join(f"{k} binary" for k in BACK) + ", tokens long, known long"), "lm-answers")
    total, distinct = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    types = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def run(batches):
        for b in batches:
            for data, got in zip(b.column(1), b.column(2)):
                it, got = Chunk(data.as_py()), sorted(got.as_py() or [], key=lambda a: a["bucket"])
                yield arrow_rows(it.scores(*(np.concatenate([C.unpack(a[k], np.uint64) for a in got]).astype(np.float64) for k in BACK), total, distinct), types)

    return C.with_answers(table, answers.select("chunk", "bucket", *BACK)).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
