"""Models, calibration, odds and books against plain versions of their rules."""

import datetime as dt
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from crosspanel.functions import factors as f
from crosspanel.operators import books as b
from crosspanel.operators import models as m
from crosspanel.operators import trees


def test_platt_is_the_most_likely_fit(spark):
    """At the most likely constant and slope, what the label has above its probability is zero on average, and has nothing to do with the score."""
    rng = np.random.default_rng(2)
    x = rng.uniform(-0.5, 0.5, 800)
    y = (rng.uniform(size=800) < 1 / (1 + np.exp(-(0.3 + 2 * x)))).astype(float)
    a, slope = m.platt(spark.createDataFrame([(float(u), float(v)) for u, v in zip(x, y)], "rank double, y double"), "y")
    above = y - 1 / (1 + np.exp(-(a + slope * x)))
    assert abs(above.mean()) < 1e-5 and abs((above * x).mean()) < 1e-5


def test_isotonic_rises_and_pools(spark):
    rng = random.Random(4)
    rows = [(k / 400, float(rng.random() < k / 400)) for k in range(400)]
    model = m.isotonic(spark.createDataFrame(rows, "score double, y double"), "score", "y")
    got = [r.p for r in model.transform(spark.createDataFrame([(k / 40,) for k in range(40)], "score double")).orderBy("score").collect()]
    assert all(x <= y + 1e-12 for x, y in zip(got, got[1:])) and got[0] < 0.3 and got[-1] > 0.7


def test_capped_book_by_brute_force(spark):
    rng = random.Random(6)
    days = [dt.date(2020, 1, 1) + dt.timedelta(7 * k) for k in range(30)]
    rows, want, held = [], [], []
    for day in days:
        order = rng.sample(range(15), 12)
        rows += [("v", day, c, k) for k, c in enumerate(order, 1)]
        zone = order[:8]
        stay = [c for c in zone if c in held][:4]
        held = stay + [c for c in zone if c not in stay and c not in held][: 4 - len(stay)]
        want += [(day, c) for c in held]
    kind = "variant string, date date, code long, rank int"
    got = m.capped_book(spark.createDataFrame(rows, kind), 4, 8).collect()
    assert sorted((r.date, r.code) for r in got) == sorted(want)
    twice = spark.createDataFrame(rows, kind).withColumn("top", F.lit(4)).withColumn("zone", F.lit(8))
    both = twice.union(twice.withColumn("variant", F.lit("w")).withColumn("top", F.lit(2)))
    books = m.capped_book(both, "top", "zone").collect()
    assert sorted((r.date, r.code) for r in books if r.variant == "v") == sorted(want) and len([r for r in books if r.variant == "w"]) == 2 * len(days)
    assert m.capped_book(both.limit(0), "top", "zone").count() == 0


def market(spark, noise_after=None):
    """Names whose feature tells their return, over three years of weeks."""
    rng = random.Random(1)
    rows = []
    for k in range(160):
        day = dt.date(2017, 1, 2) + dt.timedelta(7 * k)
        for code in range(20):
            x = rng.uniform(-0.5, 0.5)
            y = float(rng.random() < 0.5 + 0.6 * x)
            if noise_after and day >= noise_after:
                x, y = rng.uniform(-0.5, 0.5), float(rng.random() < 0.5)
            rows.append((day, code, day + dt.timedelta(7), x, y))
    return spark.createDataFrame(rows, "date date, code long, known date, x double, y double")


def planted(spark, n=3000):
    """Neither of two features says anything alone; only their product does. A third is noise."""
    rng = random.Random(5)
    rows = []
    for k in range(n):
        a, b, c = (rng.uniform(-1, 1) for _ in range(3))
        rows.append((dt.date(2020, 1, 6) + dt.timedelta(7 * (k % 20)), k, a, b, c, float(rng.random() < (0.9 if a * b > 0 else 0.1))))
    return spark.createDataFrame(rows, "date date, code long, a double, b double, c double, y double")


@pytest.fixture(scope="module")
def ensemble(spark):
    x = planted(spark)
    return trees.boosted(x.where("code % 3 > 0"), x.where("code % 3 = 0"), ["a", "b", "c"], "y")


def test_trees_find_what_no_line_can(spark, ensemble):
    x = planted(spark).where("code % 3 = 0").withColumn("p", ensemble.probability())
    assert x.agg(F.corr("p", "y")).first()[0] > 0.6 and abs(x.agg(F.corr("a", "y")).first()[0]) < 0.1
    assert ensemble.rounds == trees.best_round(list(ensemble.losses)) and ensemble.losses[ensemble.rounds - 1] < ensemble.losses[0]


def test_scores_are_those_of_the_library(spark):
    x = planted(spark, 600)
    e = trees.boosted(x, x, ["a", "b", "c"], "y", rounds=6)
    vector = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(trees.in_order(x))
    model = GBTClassifier(featuresCol="f", labelCol="y", maxIter=6, maxDepth=trees.DEPTH, stepSize=trees.RATE, subsamplingRate=trees.SHARE, minInstancesPerNode=trees.LEAF, seed=trees.SEED).fit(vector)
    got = model.transform(vector).withColumn("own", e.probability()).select("own", vector_to_array("probability")[1].alias("p")).collect()
    assert e.rounds == 6 and all(abs(r.own - r.p) < 1e-9 for r in got)


def test_contributions_add_up(spark, ensemble):
    x = planted(spark).where("code < 200")
    parts = m.contributions(ensemble, x).groupBy("code").agg(F.sum("contribution").alias("s"))
    got = x.withColumn("margin", ensemble.margin()).join(parts, "code").collect()
    assert len(got) == 200 and all(abs(r.s + ensemble.base() - r.margin) < 1e-9 for r in got)
    noise = [abs(r.contribution) for r in m.contributions(ensemble, x).where("feature = 'c'").collect()]
    assert sum(noise) / len(noise) < 0.05


def test_gains_add_up(spark, ensemble):
    got = {r.feature: r for r in m.importance(ensemble, spark, {"a": "signal", "b": "signal"}).collect()}
    assert abs(sum(r.share for r in got.values()) - 1) < 1e-12 and got["c"].share < 0.1
    assert abs(got["a"].group_share + got["c"].group_share - 1) < 1e-12 and abs(got["a"].group_share - got["a"].share - got["b"].share) < 1e-12
    assert m.importance(trees.Ensemble(("a",), (), {}, ()), spark, {}).count() == 0


def test_best_round():
    assert trees.best_round([3.0, 2.0, 2.5, 2.5, 1.0], patience=2) == 2 and trees.best_round([3.0, 2.0, 2.5, 1.0], patience=5) == 4 and trees.best_round([1.0]) == 1


def test_isotonic_bins_are_even(spark):
    rows = [(k / 5000, float(k % 7 == 0)) for k in range(5000)] + [(0.5, 1.0)] * 3000
    model = m.isotonic(spark.createDataFrame(rows, "score double, y double"), "score", "y")
    assert len(model.boundaries) <= 2 * m.BINS


def test_walk_forward_finds_a_planted_effect_and_does_not_look_ahead(spark):
    plain = m.walk_forward(market(spark), ["x"], "y", [2018, 2019, 2020])
    assert {r.year for r in plain.select("year").distinct().collect()} == {2019, 2020}  # the first has no rows before its validation year
    joined = plain.join(market(spark).select("date", "code", "y"), ["date", "code"])
    assert joined.agg(F.corr("p", "y")).first()[0] > 0.2
    # what happens after the test year's start changes no prediction made from features of that year's first week
    cut = dt.date(2019, 1, 14)
    other = m.walk_forward(market(spark, cut), ["x"], "y", [2019])
    early = lambda x: sorted((r.code, round(r.p, 8)) for r in x.where((F.col("date") < F.lit(cut)) & (F.col("year") == 2019)).collect())
    assert early(plain) == early(other) and early(plain)


def test_normal_law_and_expected_best(spark):
    zs = [-5.0, -1.96, -0.3, 0.0, 0.7, 2.5]
    got = [r.p for r in spark.createDataFrame([(k, z) for k, z in enumerate(zs)], "k int, z double").select("k", b.normal_cdf(F.col("z")).alias("p")).orderBy("k").collect()]
    assert all(abs(p - NormalDist().cdf(z)) < 2e-7 for p, z in zip(got, zs))
    assert b.expected_best(1, 0.1) == 0 and b.expected_best(100, 0.01) > b.expected_best(10, 0.01) > 0


def test_probabilistic_sharpe_is_its_formula(spark):
    rng = random.Random(9)
    xs = [rng.gauss(0.01, 0.05) for _ in range(200)]
    df = spark.createDataFrame([(1, x) for x in xs], "k int, x double").groupBy("k").agg(*(e.alias(n) for n, e in b.moments("x").items()))
    got = df.select(b.probabilistic_sharpe(0.0).alias("p"), "skew", "kurt", "sharpe").first()
    n, mu = len(xs), sum(xs) / len(xs)
    m2, m3, m4 = (sum((x - mu) ** k for x in xs) / n for k in (2, 3, 4))
    sr = mu / math.sqrt(m2 * n / (n - 1))
    skew, kurt = m3 / m2**1.5, m4 / m2**2
    want = NormalDist().cdf(sr * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))
    assert abs(got.skew - skew) < 1e-9 and abs(got.kurt - kurt) < 1e-9 and abs(got.p - want) < 2e-7


def test_ema_is_pandas_over_gaps(spark):
    import pandas as pd

    rng = random.Random(3)
    xs = [None if rng.random() < 0.3 else rng.random() for _ in range(200)]
    df = spark.createDataFrame([(1, t, x) for t, x in enumerate(xs)], "code int, t int, x double")
    want = pd.Series(xs, dtype=float).ewm(span=5, adjust=False, min_periods=5).mean().tolist()
    for r in df.select("t", f.ema(F.col("x"), 5).alias("v")).collect():
        assert (r.v is None and math.isnan(want[r.t])) or abs(r.v - want[r.t]) < 1e-12


@pytest.mark.parametrize("name, least", [("TsRank", 3), ("Skew", 5), ("Kurt", 5), ("Slope", 3), ("Rsquare", 3), ("Resi", 3), ("EMA", 1), ("Mean", 2)])
def test_least_windows(name, least):
    assert f.OPERATORS[name][3] == least and len(f.OPERATORS) == 29


def test_rows_of_models_come_from_one_table_of_bars(spark, sf_dir):
    """As the features joined with the labels, which made the bars four times and joined them by name and date; ranks of scores are no windows, which held a day's rows once for each order (F2)."""
    from crosspanel.operators import models
    from crosspanel.plans import model_queries as mq

    made = mq.rows(spark, sf_dir)
    want = mq.feature_table(spark, sf_dir).join(mq.labelled(spark, sf_dir).select("date", "code", "y", "y_rank", "excess"), ["date", "code"], "left")
    assert made.columns == want.columns
    a, b = (x.toPandas().sort_values(["date", "code"], ignore_index=True) for x in (made, want))
    assert a.equals(b) and a["y_rank"].notna().any()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "SortMergeJoin" not in plan and plan.count("l_suppkey") > 0
    x = spark.createDataFrame([(1, c, v) for c, v in enumerate([0.3, 0.1, 0.3, 0.9])], "date int, code long, p_raw double")
    ranked = models.week_percentile(x)
    assert {r.code: r["rank"] for r in ranked.collect()} == {0: 2.5 / 4 - 0.5, 1: 1 / 4 - 0.5, 2: 2.5 / 4 - 0.5, 3: 0.5}
    assert "Window" not in ranked._jdf.queryExecution().executedPlan().toString()
