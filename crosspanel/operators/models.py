"""Yearly models, their calibration, and books of fixed size: DataFrames in, DataFrames out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.operators import wide
from crosspanel.operators.trees import Ensemble, boosted
from crosspanel.sources import files

#: Rows that a fit needs at least, and bins before an isotonic fit.
LEAST_TRAIN, LEAST_VALID, BINS = 500, 100, 200


def targets(panel: DataFrame) -> DataFrame:
    """`panel` (date, code, r, bench) with excess, y (it is positive), y_rank (it beats the day's median)."""
    median = F.percentile("excess", 0.5).over(Window.partitionBy("date"))
    x = panel.withColumn("excess", F.col("r") - F.col("bench"))
    return x.withColumns({"y": (F.col("excess") > 0).cast("double"), "y_rank": (F.col("excess") > median).cast("double")})


def scored(model: Ensemble, x: DataFrame) -> DataFrame:
    return x.withColumn("p_raw", model.probability())


def years_of(x: DataFrame, before: int = 2) -> list[int]:
    """The years of `x` that can be tested: all but the first ones, which are there to fit on."""
    first, last = x.agg(F.min(F.year("date")), F.max(F.year("date"))).first()
    return list(range(first + before, last + 1)) if first is not None else []


def splits(years: list[int]) -> Iterator[tuple[int, str, str]]:
    """Each test year with the dates at which validation and test begin."""
    for year in years:
        yield year, f"{year - 1}-01-01", f"{year}-01-01"


def yearly_models(x: DataFrame, features: list[str], label: str, years: list[int]) -> Iterator[tuple[int, Ensemble, DataFrame, DataFrame]]:
    """For each test year with rows enough: the year, its model, its validation rows and its test rows.

    `x` has date, code, known (the date on which the label is known), the features and the label. A model is fitted on rows whose label was known before
    the validation year, and validation rows are those known before the test year. Missing features count as the middle. The rows are written once; the loop is
    over years, each a few Spark jobs of its own that read the columns and dates they need.
    """
    path = files.new_path(x.sparkSession, "model-rows")
    x.fillna(0.0, subset=features).write.parquet(path)
    filled = x.sparkSession.read.schema(x.schema).parquet(path)
    for year, valid, test in splits(years):
        train = filled.where((F.col("known") < valid) & F.col(label).isNotNull())
        check = filled.where((F.col("date") >= valid) & (F.col("known") < test) & F.col(label).isNotNull())
        if train.count() < LEAST_TRAIN or check.count() < LEAST_VALID:
            continue
        yield year, boosted(train, check, features, label), check, filled.where((F.col("date") >= test) & (F.col("date") < f"{year + 1}-01-01"))


def walk_forward(x: DataFrame, features: list[str], label: str, years: list[int]) -> DataFrame | None:
    """Predictions year by year: fitted, stopped and calibrated on what was known before the test year. A year without enough rows is passed over; None if all are."""
    out = None
    for year, model, check, rows in yearly_models(x, features, label, years):
        a, b = platt(week_percentile(scored(model, check).select("date", "code", label, "p_raw")), label)
        made = week_percentile(scored(model, rows).select("date", "code", "p_raw")).withColumn("p", 1 / (1 + F.exp(-(a + b * F.col("rank"))))).select("date", "code", F.lit(year).alias("year"), "p_raw", "rank", "p")
        out = made if out is None else out.union(made)
    return out


def importance(model: Ensemble, spark: SparkSession, group: dict[str, str]) -> DataFrame:
    """feature, group, share and group_share of the model's gains; no rows if it has no split."""
    gains = model.gains()
    total = sum(gains.values())
    of = {g: sum(v for k, v in gains.items() if group.get(k, k) == g) for g in {group.get(k, k) for k in gains}}
    rows = [(k, group.get(k, k), v / total, of[group.get(k, k)] / total) for k, v in gains.items()] if total else []
    return spark.createDataFrame(rows, "feature string, group string, share double, group_share double")


def week_percentile(x: DataFrame, score: str = "p_raw") -> DataFrame:
    """`x`, whose columns all move, with rank: the average rank of the score on its date over their number, less one half."""
    return wide.day_ranks(x.withColumn("rank", F.col(score)), ["rank"], keep=[c for c in x.columns if c not in ("date", "code")])


def platt(x: DataFrame, label: str, score: str = "rank") -> tuple[float, float]:
    """Constant and slope of the logistic fit of the label on one score: two numbers, so a year cannot be learnt by heart."""
    made = VectorAssembler(inputCols=[score], outputCol="one").transform(x.where(F.col(label).isNotNull()))
    model = LogisticRegression(featuresCol="one", labelCol=label, regParam=0.0, standardization=False, tol=1e-10, maxIter=100).fit(made)
    return float(model.intercept), float(model.coefficients[0])


def isotonic(x: DataFrame, score: str, label: str):
    """A rising step map from score to label, fitted on at most BINS bins of nearly equal number, whose edges come from a quantile sketch; its transform interpolates.
    Equal scores are in one bin. Few numbers are left after the bins."""
    known = x.where(F.col(label).isNotNull()).select(F.col(score).alias("s"), F.col(label).alias("y"))
    edges = known.approxQuantile("s", [k / BINS for k in range(1, BINS)], 1 / (20 * BINS))
    inner = sorted(set(edges))
    place = F.size(F.filter(F.array(*map(F.lit, inner)), lambda e: e < F.col("s"))) if inner else F.lit(0)
    bins = known.groupBy(place.alias("bin")).agg(F.avg("s").alias("score"), F.avg("y").alias("share"), F.count("*").cast("double").alias("weight"))
    return IsotonicRegression(featuresCol="score", labelCol="share", weightCol="weight", predictionCol="p").fit(bins)


def contributions(model: Ensemble, x: DataFrame) -> DataFrame:
    """date, code, feature and contribution to the margin: what the trees' questions about the feature add on the row's way down."""
    filled = x.fillna(0.0, subset=list(model.features))
    wide = filled.select("date", "code", *(model.contribution(c).alias(c) for c in model.features))
    return wide.unpivot(["date", "code"], list(model.features), "feature", "contribution")


def capped_book(ranks: DataFrame, top: str | int, keep: str | int) -> DataFrame:
    """variant, date and code of books of at most `top` names: held ones of rank `keep` or better stay, the best others fill
    them up. `ranks` has variant, date, code and rank, and `top` and `keep` are numbers or columns of it. Rows beyond `keep` play no part.

    What is held depends on all dates before, so each variant is walked in order of date. Variants are dealt to tasks by hash and sorted there, and a task
    holds one date's names and one book at a time, however long its variants are.
    """
    names = ["variant", "date", "code", "rank"]
    column = lambda v, name: (F.col(v) if isinstance(v, str) else F.lit(v)).cast("int").alias(name)
    rows = ranks.select(*names, column(top, "top"), column(keep, "keep")).where(F.col("rank") <= F.col("keep")).repartition("variant").sortWithinPartitions("variant", "date", "rank", "code")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variant, date, size, day, held = None, None, 0, [], set()

        def decided():
            nonlocal held
            stay = [c for c in day if c in held][:size]
            fill = [c for c in day if c not in held][: size - len(stay)]
            held = {*stay, *fill}
            return [(variant, date, c) for c in sorted(held)]

        for b in batches:
            out = []
            for v, d, c, n in zip(*(b.column(k).to_pylist() for k in ("variant", "date", "code", "top"))):
                if (v, d) != (variant, date):
                    out += decided() if day else []
                    if v != variant:
                        held = set()
                    variant, date, size, day = v, d, n, []
                day.append(c)
            yield rows_of(out)
        yield rows_of(decided() if day else [])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.date32()), pa.array(columns[2], pa.int64())], names=["variant", "date", "code"])

    return rows.mapInArrow(walk, "variant string, date date, code long")
