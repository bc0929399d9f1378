"""Membership by spells: which members there are on which dates of a calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days of a bin. A spell meets the calendar bin by bin; a bin holds as many dates as a year of weeks.
BIN_DAYS = 364


def merged(spells: DataFrame, key: str = "code", start: str = "start", end: str = "end") -> DataFrame:
    """Disjoint spells of each key: those that overlap or follow one another by a day become one. Spells without a start or an end, or that end before they start, go."""
    x = spells.where(F.col(start) <= F.col(end)).select(key, start, end)
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > F.date_add(before, 1)), 1).otherwise(0)
    x = x.withColumn("island_", opens).withColumn("island_", F.sum("island_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "island_").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island_")


def members(spells: DataFrame, calendar: DataFrame, key: str = "code", start: str = "start", end: str = "end", bin_days: int = BIN_DAYS) -> DataFrame:
    """date and key for each date of `calendar` (date, each once) that lies in a spell of the key, once however many spells hold it.

    A range join by bins: a spell goes into the bins it touches, a date into its own, and equal bins are compared. The rows between are those of the
    bins, not the spells' days, and no date meets a spell of another bin.
    """
    day = lambda c: F.unix_date(c)
    bins = F.sequence(F.floor(day(start) / bin_days), F.floor(day(end) / bin_days))
    by_bin = merged(spells, key, start, end).withColumn("bin_", F.explode(bins))
    dates = calendar.select("date", F.floor(day("date") / bin_days).alias("bin_"))
    met = by_bin.join(dates, "bin_").where(F.col("date").between(F.col(start), F.col(end)))
    return met.select("date", key)
