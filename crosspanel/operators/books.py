"""Books of holdings week by week, what they earn, and how sure that is."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weeks of a year and the Euler number of the expected maximum.
YEAR, EULER = 52, 0.5772156649015329
#: Five coefficients and the scale of the usual rational form of the error function.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_SCALE = 0.3275911


def book_weeks(book: DataFrame, ahead: DataFrame, bench: DataFrame, slots: int, buy: float, sell: float, step: int = 7) -> DataFrame:
    """variant, date, gross, cost, net, bench, universe, n_stocks and turnover of each date of each variant's book.

    `book` has variant, date and code; `ahead` date, code and r, the return to the next date; `bench` date and bench. A
    missing return counts as none, unused slots earn the benchmark, and the first date buys everything.
    """
    before = book.select("variant", F.date_add("date", step).alias("date"), "code", F.lit(True).alias("was"))
    both = book.withColumn("held", F.lit(True)).join(before, ["variant", "date", "code"], "full")
    held, was = F.coalesce("held", F.lit(False)), F.coalesce("was", F.lit(False))
    x = both.join(ahead, ["date", "code"], "left").groupBy("variant", "date").agg(
        F.count_if(held).alias("n_stocks"), F.sum(F.when(held, F.coalesce("r", F.lit(0.0))).otherwise(0.0)).alias("earned"), F.count_if(held & ~was).alias("buys"), F.count_if(was & ~held).alias("sells")
    )
    universe = ahead.groupBy("date").agg(F.avg("r").alias("universe"))
    x = x.where("n_stocks > 0").join(universe, "date", "left").join(bench, "date", "left")
    gross = F.col("earned") / slots + (1 - F.col("n_stocks") / slots) * F.coalesce("bench", F.lit(0.0))
    cost = (F.col("buys") * buy + F.col("sells") * sell) / slots
    return x.select("variant", "date", gross.alias("gross"), cost.alias("cost"), (gross - cost).alias("net"), "bench", "universe", "n_stocks", (F.col("buys") / slots).alias("turnover"))


def yearly(total_log: Column, n: Column) -> Column:
    return F.exp(total_log * YEAR / n) - 1


def with_drawdown(weeks: DataFrame, r: str, key: str = "variant") -> DataFrame:
    """`weeks` with the fall of the compounded column `r` from its highest value so far."""
    w = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    equity = weeks.withColumn("equity", F.exp(F.sum(F.log1p(r)).over(w)))
    return equity.withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1).drop("equity")


def normal_cdf(z: Column) -> Column:
    """The distribution function of the normal law, to seven digits."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + ERF_SCALE * x)
    tail = F.lit(0.0)
    for c in reversed(ERF):
        tail = (tail + c) * t
    half = tail * F.exp(-x * x) / 2
    return F.when(z >= 0, 1 - half).otherwise(half)


def expected_best(trials: int, variance: float) -> float:
    """The Sharpe ratio that the best of so many worthless trials is expected to show."""
    if trials <= 1 or variance <= 0:
        return 0.0
    quantile = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * quantile(1 - 1 / trials) + EULER * quantile(1 - 1 / (trials * math.e)))


def moments(x: str) -> dict[str, Column]:
    """Count, mean, sample deviation, population skew and kurtosis (3 for the normal law), Sharpe ratio and t of a column."""
    n, m, s = F.count(x), F.avg(x), F.stddev_samp(x)
    flat = F.coalesce(s == 0, F.lit(True))
    return {"n": n, "mean": m, "sd": s, "skew": F.when(flat, 0.0).otherwise(F.skewness(x)), "kurt": F.when(flat, 3.0).otherwise(F.kurtosis(x) + 3), "sharpe": F.when(flat, 0.0).otherwise(m / s), "t": m / s * F.sqrt(n)}


def probabilistic_sharpe(best: Column | float) -> Column:
    """From the columns of `moments`: how likely the true ratio exceeds `best`."""
    sr = F.col("sharpe")
    spread = 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr
    return F.when((F.col("n") >= 3) & (F.col("sd") > 0) & (spread > 0), normal_cdf((sr - best) * F.sqrt(F.col("n") - 1.0) / F.sqrt(spread)))
