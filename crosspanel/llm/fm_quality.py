"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata (operator 4).

A document becomes a sparse vector: hashed words weighted by their share, and one bin for each structure statistic and
for the length. The score is the logistic of bias + linear terms + low-rank pairwise interactions, which take linear
time: half of (sum v x)^2 - sum (v x)^2 over the factors. Labels, language, source and doc_id are no inputs.

The model is fitted on at most SAMPLE labelled documents, the first by hash among those that are not held out; the
sample is a bound of the fit, and scoring covers every document.

Defined cases: a null or empty text has the bins of the empty text and its score; equal texts have equal scores;
a very long text is one sparse vector of its different words; without labels of both kinds all scores are PRIOR; repeated labels of a document count as their largest; repeated rows
give repeated rows; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import arrow_rows, bounded_batches, map_texts, texts_of

SAMPLE = 6000
WORD_BUCKETS = 1 << 14
BINS, FACTORS, EPOCHS, BATCH = 24, 8, 12, 200
STEP, DECAY, SEED, PRIOR, LIMIT = 0.02, 1e-4, 7, 0.5, 0.3
SYMBOL = re.compile(r"[#*$%&|<>!]")
STATISTICS = 12
SIZE = WORD_BUCKETS + STATISTICS * BINS


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def statistics(text: str, words: list[str], counts: Counter) -> list[float]:
    """Numbers from 0 to 1 on the structure of a text."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, sum(map(str.isalpha, text)))
    return [
        min(1.0, math.log1p(len(words)) / 10),
        min(1.0, math.log1p(len(text)) / 12),
        min(1.0, len(text) / n / 20),
        min(1.0, 4 * len(SYMBOL.findall(text)) / n),
        sum(map(str.isupper, text)) / letters,
        min(1.0, 5 * sum(map(str.isdigit, text)) / chars),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(set(zip(words, words[1:]))) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, 4 * (text.count(".") + text.count(",")) / n),
        min(1.0, 10 * len(lines) / n),
    ]


def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the features of a text."""
    words = text.split()
    counts = Counter(words)
    bins = [WORD_BUCKETS + k * BINS + min(BINS - 1, int(x * BINS)) for k, x in enumerate(statistics(text, words, counts))]
    low = Counter()
    for w, n in counts.items():
        low[zlib.crc32(w.lower().encode()) % WORD_BUCKETS] += n
    share = np.fromiter(low.values(), np.float32, len(low))
    share = np.sqrt(share / share.sum()) if len(share) else share
    return np.concatenate((np.fromiter(low, np.int64, len(low)), bins)).astype(np.int32), np.concatenate((share, np.full(len(bins), 0.5))).astype(np.float32)


class Machine:
    def __init__(self, seed: int = SEED):
        self.bias, self.linear = 0.0, np.zeros(SIZE, np.float32)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (SIZE, FACTORS)).astype(np.float32)
        self.fitted = False

    def sums(self, index: np.ndarray, value: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.factors[index] * value[:, None]
        s = np.add.reduceat(vx, begin)
        z = self.bias + np.add.reduceat(self.linear[index] * value, begin) + 0.5 * (s**2 - np.add.reduceat(vx**2, begin)).sum(1)
        return z, s, vx

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not self.fitted or not vectors:
            return np.full(len(vectors), PRIOR)
        begin = np.cumsum([0, *(len(i) for i, _ in vectors[:-1])])
        z = self.sums(np.concatenate([i for i, _ in vectors]), np.concatenate([v for _, v in vectors]), begin)[0]
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def fit(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = SEED) -> Machine:
        """Logistic loss, minibatches, steps scaled by each weight's past gradients."""
        if len(set(labels.tolist())) < 2:
            return self
        self.fitted, rng = True, np.random.default_rng(seed)
        past_l, past_f = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(vectors))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                index, value = np.concatenate([vectors[i][0] for i in some]), np.concatenate([vectors[i][1] for i in some])
                lengths = np.array([len(vectors[i][0]) for i in some])
                z, s, vx = self.sums(index, value, np.cumsum(lengths) - lengths)
                error = (1 / (1 + np.exp(-z)) - labels[some]).astype(np.float32)
                each = np.repeat(error / len(some), lengths) * value
                self.bias -= float(error.mean()) * 0.1
                g = np.bincount(index, each, SIZE).astype(np.float32) + DECAY * self.linear / len(some)
                past_l += g**2
                self.linear -= STEP * 5 * g / np.sqrt(past_l)
                pull = each[:, None] * (np.repeat(s, lengths, axis=0) - vx)
                g = np.stack([np.bincount(index, pull[:, f], SIZE) for f in range(FACTORS)], axis=1).astype(np.float32) + DECAY * self.factors / len(some)
                past_f += g**2
                self.factors -= STEP * g / np.sqrt(past_f)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine of at most `sample` labelled documents outside the held-out part; only their sparse vectors reach the driver. An id that stands on several rows counts once, by its least text."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = texts_of(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    types = {"doc_id": pa.int64(), "quality": pa.int32(), "index": pa.list_(pa.int32()), "value": pa.list_(pa.float32())}

    def run(batches):
        for b in batches:
            made = [vector(t.as_py()) for t in b.column(1)]
            yield arrow_rows({"doc_id": b.column(0), "quality": b.column(2), "index": [i for i, _ in made], "value": [v for _, v in made]}, types)

    rows = some.mapInArrow(run, "doc_id long, quality int, index array<int>, value array<float>").toArrow().sort_by("doc_id").combine_chunks()
    vectors = [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(rows["index"], rows["value"])]
    return Machine().fit(vectors, rows["quality"].to_numpy())


def classify(docs: DataFrame, machine: Machine, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # SIZE * (FACTORS + 1) numbers
    types = {"doc_id": pa.int64(), "score": pa.float64()}

    def run(batches):
        for b in batches:
            yield arrow_rows({"doc_id": b.column(0), "score": shared.value.scores([vector(t.as_py()) for t in b.column(1)])}, types)

    bounded_batches(docs.sparkSession)
    scored = texts_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def train_and_classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return classify(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with their columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def decide(texts):
        return [t if s >= limit else None for t, s in zip(texts, shared.value.scores([vector(t) for t in texts]))]

    return map_texts(docs, decide)
