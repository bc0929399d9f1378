"""Panels from the tables: weekly bars by supplier, the dense calendar and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table that is dealt out anew, if it has fewer files than the session has cores: so few that moving them costs less than idle cores.
SMALL_TABLE = 64 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A small table in few files, whose row groups are too few for all cores, dealt to all of them; larger ones as they stand."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_TABLE
    return df.repartition(cores) if small and len(df.inputFiles()) < cores else df


COLUMNS = ("l_shipdate", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")


def _bars(lines: DataFrame) -> DataFrame:
    x = lines.withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    made = x.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.col("l_suppkey").alias("code")).agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("l_quantity").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("value")
    )
    return made.withColumn("vwap", F.col("value") / F.col("volume"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars: date, code, open, high, low, close, volume, value, vwap."""
    return _bars(dealt(read(spark, sf_dir, "lineitem").select(*COLUMNS)))


def calendar(spark: SparkSession, sf_dir: str) -> tuple:
    """The first and the last week of the raw table; None if it has no row."""
    week = lambda c: F.to_date(F.date_trunc("week", c))
    return tuple(read(spark, sf_dir, "lineitem").agg(week(F.min("l_shipdate")), week(F.max("l_shipdate"))).first())


def weeks(first, last) -> int:
    return (last - first).days // 7 + 1 if first is not None else 0


def code_bars(spark: SparkSession, sf_dir: str, first) -> DataFrame:
    """The bars with t, the number of their week from 1; weeks without a bar have no row. Raw rows of a code meet in one task, so neither the bars nor windows of a code need another shuffle."""
    lines = read(spark, sf_dir, "lineitem").select(*COLUMNS).where("l_suppkey is not null and l_shipdate is not null")
    t = F.floor(F.datediff("date", F.lit(first)) / 7).cast("int") + 1
    return _bars(lines.repartition("l_suppkey")).withColumn("t", t)


def dense(panel: DataFrame, codes: DataFrame, first, last) -> DataFrame:
    """All weeks from first to last for all codes, with t, the number of the week from 1; weeks without a bar have nulls."""
    if first is None:
        return panel.withColumn("t", F.lit(0))
    weeks = F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 7 days")))
    grid = codes.select("code", weeks.alias("date"))
    return grid.withColumn("t", F.floor(F.datediff("date", F.lit(first)) / 7).cast("int") + 1).join(panel, ["date", "code"], "left")


def dense_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel. Its calendar and its codes come from one column each of the raw table, not from the bars."""
    codes = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code")).distinct()
    return dense(bars(spark, sf_dir), codes, *calendar(spark, sf_dir))


def benchmark(panel: DataFrame) -> DataFrame:
    """By date, the value-weighted price of all codes."""
    return panel.groupBy("date").agg((F.round(F.sum("value"), 2) / F.sum("volume")).alias("level"))
