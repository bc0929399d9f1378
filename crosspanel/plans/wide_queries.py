"""Queries over all 158 features at once, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import features as ft
from crosspanel.operators import blocks, wide
from crosspanel.plans import book_queries as bk
from crosspanel.plans import research_queries as rq
from crosspanel.plans.book_queries import AHEAD, R6, r6
from crosspanel.plans.factor_queries import WITH
from crosspanel.plans.panel_queries import CANDLES, PREPARED, r4, rolling_exprs
from crosspanel.plans.research_queries import RANKED, corr_sql
from crosspanel.sources import panel as p

NAMES = ft.names()


def day_blocks(spark, d, more=lambda x: x, also=()) -> DataFrame:
    """The matrix in blocks of days, with the columns `also` that `more` adds to the bars of a code."""
    first, last = p.calendar(spark, d)
    return blocks.of_days(more(p.code_bars(spark, d, first)), ft.bar_features(p.weeks(first, last)), NAMES, also)


def w38_all_features(spark, d):
    return ft.matrix(p.dense_bars(spark, d)).select("date", "code", *(wide.rounded(F.col(c), 4).alias(c) for c in NAMES))


def w39_all_feature_ranks(spark, d):
    return blocks.ranks(day_blocks(spark, d), NAMES).select("date", "code", *(wide.rounded(F.col(c), 6).alias(c) for c in NAMES))


def a19_all_features(spark, d):
    """Over all features: the best by its mean coefficient, the median strength, and the mean of the ten strongest."""
    x = day_blocks(spark, d, bk.with_ahead, ["r"])
    ic = blocks.coefficients(x, NAMES, "r", rq.LEAST_NAMES).groupBy("feature").agg(F.round(F.abs(F.avg("ic")), 9).alias("ic"))
    k = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("ic"), "feature"))  # one row for each feature
    best = F.avg(F.when(F.col("k") <= 10, F.col("ic")))
    return ic.withColumn("k", k).agg(F.count("*").alias("features"), F.min_by("feature", "k").alias("best"), R6(F.max("ic")).alias("best_ic"), R6(F.percentile("ic", 0.5)).alias("median_ic"), R6(best).alias("top10_ic"))


def j13_closest_of_all(spark, d):
    """For each factor the feature among all 158 whose ranks are most like its own, by the mean correlation over dates."""
    x = day_blocks(spark, d, rq.with_factors, [*rq.FACTORS, "fwd"])
    each = blocks.correlations(x, rq.FACTORS, "fwd", NAMES, rq.LEAST_NAMES).groupBy("one", "other").agg(F.round(F.abs(F.avg("c")), 6).alias("c"))
    return each.groupBy(F.col("one").alias("factor")).agg(F.max("c").alias("max_corr"), F.max_by("other", F.struct("c", "other")).alias("closest"))


CALLS = (w38_all_features, w39_all_feature_ranks, a19_all_features, j13_closest_of_all)
QUERIES = {c.__name__: c for c in CALLS}

EXPRS = CANDLES | {f"{k}{w}": e for w in ft.WINDOWS for k, e in rolling_exprs(w).items()}
FX = f"""{WITH}, {PREPARED}, fd AS (SELECT date, code, close AS px, {', '.join(f'CAST({EXPRS[k]} AS DOUBLE) AS "{k}"' for k in NAMES)} FROM (SELECT *, value / volume AS vwap, high - low + 1e-12 AS span FROM y)),
fx AS (SELECT date, code, {', '.join(f'CAST(CASE WHEN NOT isnan("{k}") AND abs("{k}") < {chr(39)}infinity{chr(39)}::DOUBLE THEN "{k}" END AS FLOAT) AS "{k}"' for k in NAMES)} FROM fd WHERE px IS NOT NULL)"""
LONG = f"{FX}, fl AS (SELECT * FROM (SELECT date, code, unnest([{', '.join(repr(k) for k in NAMES)}]) AS feature, unnest([{', '.join(chr(34) + k + chr(34) for k in NAMES)}]) AS x FROM fx) WHERE x IS NOT NULL)"


def _rank(c: str, day: str) -> str:
    return f"(rank() OVER (PARTITION BY {day} ORDER BY {c}) + (count(*) OVER (PARTITION BY {day}, {c}) - 1) / 2.0)"


SQL = {
    "w38_all_features": f"{FX} SELECT date, code, " + ", ".join(f'{r4(chr(34) + k + chr(34))} AS "{k}"' for k in NAMES) + " FROM fx",
    "w39_all_feature_ranks": f"{LONG}, ra AS (SELECT date, code, feature, {_rank('x', 'date, feature')} / count(*) OVER (PARTITION BY date, feature) - 0.5 AS v FROM fl), pv AS (SELECT date, code, "
    + ", ".join(f"max(CASE WHEN feature = '{k}' THEN v END) AS \"{k}\"" for k in NAMES)
    + " FROM ra GROUP BY 1, 2) SELECT fx.date, fx.code, "
    + ", ".join(f'{r6(f"pv.{chr(34)}{k}{chr(34)}")} AS "{k}"' for k in NAMES)
    + " FROM fx LEFT JOIN pv ON pv.date = fx.date AND pv.code = fx.code",
    "a19_all_features": f"{LONG}, {AHEAD}, bo AS (SELECT fl.date, fl.feature, x, r FROM fl JOIN ahead a ON a.date = fl.date AND a.code = fl.code WHERE r IS NOT NULL), rr AS (SELECT date, feature, {_rank('x', 'date, feature')} AS rx, {_rank('r', 'date, feature')} AS rw, count(*) OVER (PARTITION BY date, feature) AS n FROM bo), ics AS (SELECT feature, round(abs(avg(ic)), 9) AS ic FROM (SELECT date, feature, {corr_sql('rx', 'rw')} AS ic FROM rr WHERE n >= {rq.LEAST_NAMES} GROUP BY 1, 2) WHERE ic IS NOT NULL GROUP BY 1), kk AS (SELECT *, row_number() OVER (ORDER BY ic DESC, feature) AS k FROM ics) SELECT count(*) AS features, arg_min(feature, k) AS best, {r6('max(ic)')} AS best_ic, {r6('quantile_cont(ic, 0.5)')} AS median_ic, {r6('avg(CASE WHEN k <= 10 THEN ic END)')} AS top10_ic FROM kk",
    "j13_closest_of_all": f"{RANKED}, {LONG.removeprefix(WITH + ', ')}, ry AS (SELECT date, code, feature, {_rank('x', 'date, feature')} / count(*) OVER (PARTITION BY date, feature) AS ry FROM fl), dc AS (SELECT factor, feature, r.date, {corr_sql('rx', 'ry')} AS c FROM ranked r JOIN ry ON ry.date = r.date AND ry.code = r.code GROUP BY 1, 2, 3), ec AS (SELECT factor, feature, round(abs(avg(c)), 6) AS c FROM dc WHERE c IS NOT NULL GROUP BY 1, 2) SELECT factor, max(c) AS max_corr, arg_max(feature, (c, feature)) AS closest FROM ec GROUP BY 1",
}
