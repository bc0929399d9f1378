"""Sinks and sources: pruning, round trips and values that a format has no word for."""

import datetime as dt
import math

import duckdb
from pyspark.sql import functions as F

from crosspanel.sources import files


def test_years_and_dates_reach_the_scan(spark):
    rows = [(dt.date(y, m, 1), y * m) for y in (2001, 2002, 2003) for m in (1, 7)]
    back = files.by_year(spark.createDataFrame(rows, "date date, x int"), files.new_path(spark, "years"))
    some = back.where("year = 2002 and date < date'2002-03-01'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "LessThan(date,2002-03-01)" in plan
    assert [tuple(r) for r in some.select("date", "x").collect()] == [(dt.date(2002, 1, 1), 2002)]


def test_csv_round_trip(spark):
    rows = [(1, 'a,"b"', 1.5), (2, None, None), (3, "two words", -0.25)]
    df = spark.createDataFrame(rows, "id int, s string, x double")
    for options in ({}, {"sep": "\t", "header": "false"}):
        assert sorted(tuple(r) for r in files.csv_table(df, files.new_path(spark, "csv"), **options).collect()) == rows
    assert files.csv_table(df.where("id > 9"), files.new_path(spark, "csv")).count() == 0


def test_log_appends_and_has_no_nan(spark):
    path, schema = files.new_path(spark, "log"), "id int, x double"
    files.append_log(spark.createDataFrame([(1, math.nan), (2, 0.5)], schema), path)
    files.append_log(spark.createDataFrame([(3, math.inf), (4, None)], schema), path)
    assert sorted(tuple(r) for r in files.read_log(spark, path, schema).collect()) == [(1, None), (2, 0.5), (3, None), (4, None)]


def test_json_numbers_are_shortest(spark):
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 0.005123, 0.002, 0.001, 0.00095, 0.000123, -0.0001, 0.000099, 1.2e-05, -1e-05, 2e-06, -9e-06, 12345678.25, 1e7, math.nan, math.inf, None]
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(files.json_number(F.col("v")).alias("s")).collect()]
    want = [None if v is None or not math.isfinite(v) else duckdb.execute("SELECT CAST(CAST(? AS DOUBLE) + 0.0 AS VARCHAR)", [v + 0.0]).fetchone()[0] for v in values]
    assert got == want


def test_small_means_are_as_in_sql(spark, tmp_path):
    from crosspanel import registry

    closes = {0: (1000.0, 1001.0), 1: (1000.0, 1000.1), 2: (1000.0, 999.98), 3: (1.0, 2.0), 4: (7.0, 7.0), 5: (3.0, 1.0)}
    rows = [(dt.datetime(1998, 1, 5 + 7 * w), c, 10 * c + w, 1, x, 1.0) for c, both in closes.items() for w, x in enumerate(both)]
    names = "l_shipdate timestamp, l_suppkey long, l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.code, r.summary) for r in registry.QUERIES["s12_json_means"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.ORACLE_SQL["s12_json_means"]).fetchall())
    assert got[0][1] == '{"weeks":1,"mean":0.0005}' and got[1][1] == '{"weeks":1,"mean":5e-05}'


def test_zipped_days_are_packed_and_their_texts_are_not_moved(spark, sf_dir, monkeypatch):
    """The days' archives held their texts as they are, and the texts moved with the numbers they are made of (F3)."""
    import io
    import zipfile

    from crosspanel.plans import ingest_queries

    kept = []
    monkeypatch.setattr(files, "write_binary", lambda df, base, write=files.write_binary: kept.append(df) or write(df, base))
    assert ingest_queries.s1_daily_files(spark, sf_dir).count() > 0
    plan = kept[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    moved = [k for k in plan.splitlines() if "Exchange" in k]
    assert len(moved) == 2 and "l_suppkey" in moved[1] and "date" in moved[0]
    assert plan.index(" AS symbol") < plan.index(moved[0])  # above it, so later
    whole = [r.content for r in kept[0].select("content").limit(300).collect()]
    packed = [i for c in whole if zipfile.is_zipfile(io.BytesIO(c)) for i in zipfile.ZipFile(io.BytesIO(c)).infolist()]
    assert packed and all(i.compress_type == zipfile.ZIP_DEFLATED for i in packed)
