"""Scoring and table operators: DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import factors as f

LEAST_PAIRS = 30


def scored(panel: DataFrame) -> DataFrame:
    """date, code, f (a moving average over the price) and fwd (the return from the next open over five rows)."""
    fwd = f.safe_div(F.lead("open", 6).over(f.by_code()), F.lead("open", 1).over(f.by_code())) - 1
    return panel.select("date", "code", (f.mean(F.col("close"), 2) / F.col("close")).alias("f"), fwd.alias("fwd"))


def pearson_ic(s: DataFrame) -> DataFrame:
    pairs = s.where("f is not null and fwd is not null")
    return pairs.groupBy("date").agg(F.count("*").alias("n"), F.corr("f", "fwd").alias("ic")).where(F.col("n") >= LEAST_PAIRS)


def spearman_ic(s: DataFrame) -> DataFrame:
    """Average ranks on each side's own values, then the days' pairs."""
    ranked = s.select("date", f.avg_rank(F.col("f")).alias("f"), f.avg_rank(F.col("fwd")).alias("fwd"))
    return pearson_ic(ranked)


def ic_summary(ic: DataFrame) -> DataFrame:
    m, s, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    return ic.agg(n.alias("n"), m.alias("mean_ic"), (m / s).alias("ir"), (m / s * F.sqrt(n)).alias("t"), F.avg((F.col("ic") > 0).cast("double")).alias("share_up"))


def quantile_spread(s: DataFrame) -> DataFrame:
    q = s.where("f is not null").select("date", "fwd", (f.avg_rank(F.col("f")) / F.count("f").over(f.by_date())).alias("q"))
    return q.groupBy("date").agg((F.avg(F.when(F.col("q") > 0.8, F.col("fwd"))) - F.avg(F.when(F.col("q") <= 0.2, F.col("fwd")))).alias("spread"))


def drawdown(series: DataFrame, key: str = "series", order: str = "date", r: str = "r") -> DataFrame:
    """Equity from compounded returns and its fall from the highest value so far."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    equity = series.withColumn("equity", F.exp(F.sum(F.log1p(r)).over(w)))
    return equity.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def hysteresis(ranks: DataFrame, enter: int, stay: int) -> DataFrame:
    """In the book from a rank of at most `enter` until one beyond `stay`."""
    mark = F.when(F.col("rank") <= enter, 1).when(F.col("rank") > stay, 0)
    w = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return ranks.withColumn("held", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def streak(df: DataFrame, key: str, order: list[Column], win: Column) -> DataFrame:
    """The run of losses at the end of each key's rows."""
    seen = F.sum(F.when(win, 1).otherwise(0)).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("wins_since", seen).groupBy(key).agg(F.sum((F.col("wins_since") == 0).cast("long")).alias("losses"))
