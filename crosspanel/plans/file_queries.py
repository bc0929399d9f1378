"""Queries that write the tables' data as files and answer from what is read back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosspanel.plans.factor_queries import WITH
from crosspanel.plans.panel_queries import R4, r4
from crosspanel.sources import files
from crosspanel.sources import panel as p

#: Rows of the log that a reader sees of each user.
LAST = 5


def s7_spells(spark, d):
    """Tab-separated spells without a header: first and last week of each code."""
    spells = p.bars(spark, d).groupBy("code").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return files.csv_table(spells, files.new_path(spark, "spells"), sep="\t", header="false")


def s9_pushed_dates(spark, d):
    """Bars in one folder a year; the question reads two of them."""
    x = files.by_year(p.bars(spark, d), files.new_path(spark, "bars"))
    some = x.where("year in (1996, 1997) and date <= date'1997-06-30'")
    return some.groupBy("code").agg(F.count("*").alias("weeks"), R4(F.avg("close")).alias("close"))


def s11_csv_sink(spark, d):
    orders = p.read(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"), F.min("o_orderpriority").alias("least"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("most"))
    return files.csv_table(orders, files.new_path(spark, "orders"))


def s12_json_summary(spark, d):
    """One JSON text for each kind of event; a mean that is no number is null."""
    e = files.without_nan(p.read(spark, d, "events").select("event_type", F.col("value").cast("double").alias("value")))
    made = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("known"))
    return made.select("event_type", F.to_json(F.struct("n", "known")).alias("summary"))


def s13_event_log(spark, d):
    """Events appended to a log of JSON lines in two parts; each user's last rows."""
    e = p.read(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "user_id", "event_type", "value")
    path = files.new_path(spark, "log")
    for part in (0, 1):
        files.append_log(e.where(F.col("event_id") % 2 == part), path)
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("event_id")))
    return files.read_log(spark, path, e.schema).withColumn("k", last).where(F.col("k") <= LAST).select("user_id", "k", "event_id", "event_type", "value")


CALLS = (s7_spells, s9_pushed_dates, s11_csv_sink, s12_json_summary, s13_event_log)
QUERIES = {c.__name__: c for c in CALLS}
SQL = {
    "s7_spells": f'{WITH} SELECT code, min(date) AS "first", max(date) AS "last" FROM bars GROUP BY 1',
    "s9_pushed_dates": f"{WITH} SELECT code, count(*) AS weeks, {r4('avg(close)')} AS close FROM bars WHERE date >= DATE '1996-01-01' AND date <= DATE '1997-06-30' GROUP BY 1",
    "s11_csv_sink": "SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS orders, min(o_orderpriority) AS least, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS most FROM orders GROUP BY 1, 2",
    "s12_json_summary": """SELECT event_type, '{"n":' || count(*) || ',"known":' || count(CASE WHEN isfinite(value) THEN 1 END) || '}' AS summary FROM events GROUP BY 1""",
    "s13_event_log": "SELECT user_id, k, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5",
}
