"""Queries that write the tables' data as raw files and build tables from what is read back, each with its SQL."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.plans.book_queries import R6, r6
from crosspanel.plans.factor_queries import WITH
from crosspanel.sources import files, raw
from crosspanel.sources import panel as p

CHANGE = "1998-07-01"
SERIES = ("EQ", "BE", "BZ")
BEGIN, END = "1996-01-01", "1999-12-31"
FIELDS = ["close", "volume"]


def day_numbers(spark, d) -> DataFrame:
    """date, code and the numbers of a row for each day and supplier: raw rows of a code meet in one shuffle, which its days and the day before need as well."""
    x = p.read(spark, d, "lineitem").select(*p.COLUMNS).repartition("l_suppkey").withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    x = x.groupBy(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("l_quantity").cast("long").alias("volume"), F.round(F.sum("l_extendedprice"), 2).alias("value")
    )
    return x.withColumn("prevclose", F.lag("close").over(Window.partitionBy("code").orderBy("date")))


def named(x: DataFrame) -> DataFrame:
    """The rows of `day_numbers` as an exchange would publish them."""
    series = F.when(F.col("code") % 10 == 3, "BE").when(F.col("code") % 10 == 7, "GS").otherwise("EQ")
    isin = F.concat(F.when(F.col("code") % 8 == 5, "INF").otherwise("INE"), F.lpad(F.col("code").cast("string"), 6, "0"))
    return x.select("date", F.concat(F.lit("S"), F.col("code").cast("string")).alias("symbol"), isin.alias("isin"), series.alias("series"), "open", "high", "low", "close", "prevclose", "volume", "value")


def days(spark, d) -> DataFrame:
    """A row for each day and supplier as an exchange would publish it."""
    return named(day_numbers(spark, d))


def written_days(spark, d) -> tuple[str, str]:
    """Paths of the files in the old layout, before CHANGE, and in the new one; both hold rows that a reader must leave out."""
    x, paths = days(spark, d), (files.new_path(spark, "days-old"), files.new_path(spark, "days-new"))
    old = x.where(F.col("date") < CHANGE).withColumns({"date": F.upper(F.date_format("date", "dd-MMM-yyyy")), "series": F.concat(F.lit(" "), "series", F.lit(" "))})
    old.select(*(F.col(k).alias(v) for k, v in raw.OLD.items()), F.lit("").alias("LAST")).write.option("header", "true").csv(paths[0])
    new = x.where(F.col("date") >= CHANGE).select(*(F.col(k).alias(v) for k, v in raw.NEW.items()))
    shares = new.withColumns({"Sgmt": F.lit("CM"), "FinInstrmTp": F.lit("STK")})
    others = new.withColumns({"Sgmt": F.when(F.col("SctySrs") == "BE", "FO").otherwise("CM"), "FinInstrmTp": F.when(F.col("SctySrs") == "BE", "STK").otherwise("BND")})
    shares.union(others).write.option("header", "true").csv(paths[1])
    return paths


def zipped_days(spark, d) -> DataFrame:
    """What is read back from one zipped file a day, named by its day, in both layouts. Every 97th day's archive is cut short, every 101st day lacks the column of
    closes, every 31st is no CSV inside, and every third file writes its header in capitals with blanks around; the days' own date columns say nothing."""
    import io
    import zipfile

    texts = {"series": F.concat(F.lit(" "), "series", F.lit(" ")), "prevclose": F.coalesce(F.col("prevclose").cast("string"), F.lit("-"))}
    rows = named(day_numbers(spark, d).repartition("date").sortWithinPartitions("date", "code")).withColumns(texts)  # numbers move, not the texts made of them

    def pack(key, x):
        day = key[0]
        new, n = str(day) >= CHANGE, day.timetuple().tm_yday
        names = raw.NEW if new else raw.OLD
        x = x.drop(columns="date").rename(columns=names).assign(**{names["date"]: "01-JAN-1900"})
        if new:
            others = x.assign(Sgmt="FO", FinInstrmTp="STK")
            x = pd.concat([x.assign(Sgmt="CM", FinInstrmTp="STK"), others]).sort_index(kind="stable")  # like rows side by side, as deflate looks back 32 KB
        if n % 3 == 0:
            x.columns = [f" {c.upper()} " for c in x.columns]
        if n % 101 == 5:
            x = x.drop(columns=[c for c in x.columns if c.strip().upper() == names["close"].upper()])
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            name = zipfile.ZipInfo("readme.txt" if n % 31 == 7 else "day.CSV")
            name.compress_type = z.compression  # its own default is none
            with z.open(name, "w") as f, io.TextIOWrapper(f, "utf-8", newline="") as text:
                x.to_csv(text, index=False, chunksize=10_000)
        content = out.getvalue()
        return x.__class__([(f"{day:%Y}/{day:%Y%m%d}.csv.zip", content[: len(content) // 2] if n % 97 == 13 else content)], columns=["path", "content"])

    base = files.new_path(spark, "zipped-days")
    files.write_binary(rows.groupBy("date").applyInPandas(pack, "path string, content binary"), base)  # a day has a row a name
    return raw.zipped_day_files(files.read_binary(spark, base, "*.zip"))


def s1_daily_files(spark, d):
    x = raw.good_rows(zipped_days(spark, d), SERIES)
    return x.select("date", "symbol", "isin", "series", *(R6(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "prevclose", "volume", "value")))


def s1_bad_files(spark, d):
    """The files that gave no rows, and why."""
    return raw.bad_files(zipped_days(spark, d)).select("file", "error")


def s2_series_filter(spark, d):
    """Rows by series and layout where only the main series counts, and where all do."""
    paths = written_days(spark, d)
    one = raw.day_files(spark, *paths, ("EQ",)).withColumn("kept", F.lit("main"))
    x = one.union(raw.day_files(spark, *paths, SERIES).withColumn("kept", F.lit("all")))
    return x.groupBy("kept", "series", (F.col("date") >= CHANGE).alias("new_layout")).agg(F.count("*").alias("rows"))


def u1_union_of_files(spark, d):
    """Both layouts in one table: rows and symbols by year."""
    return raw.day_files(spark, *written_days(spark, d), SERIES).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"))


def indices(spark, d) -> DataFrame:
    """Two indices by week from their files: one of all volume, in its first years on every second week only, and one of the number of bars."""
    week = p.bars(spark, d).groupBy("date").agg(F.sum("volume").cast("long").alias("v"), F.count("*").alias("n"))
    name = F.when(F.year("date") % 2 == 0, " Broad Market ").otherwise("BROAD MARKET INDEX")
    text = lambda c: F.format_number(c, 0)
    day = F.date_format("date", "dd-MM-yyyy").alias("Index Date")
    broad = week.where("year(date) > 1996 or weekofyear(date) % 2 = 0").select(name.alias("Index Name"), day, text(F.when(F.col("v") % 7 == 0, 0).otherwise(F.col("v") - 1)).alias("Open Index Value"), text(F.col("v")).alias("Closing Index Value"))
    count = week.select(F.lit("Names Traded").alias("Index Name"), day, F.lit("-").alias("Open Index Value"), text(F.col("n") * 1000).alias("Closing Index Value"))
    path = files.new_path(spark, "indices")
    broad.union(count).write.option("header", "true").csv(path)
    aliases = spark.createDataFrame([("broad market", "broad"), ("broad market index", "broad"), ("names traded", "names")], "written string, index string")
    return raw.index_files(spark, path, aliases)


def s3_index_files(spark, d):
    return indices(spark, d).select("date", "index", R6(F.col("open")).alias("open"), R6(F.col("close")).alias("close"))


def s4_benchmark_choice(spark, d):
    """The broad index if it covers nine tenths of the weeks, else the other; a missing or zero opening is the close, and a missing close the one before."""
    x, week = indices(spark, d), p.bars(spark, d).select("date").distinct()
    share = week.join(x.where("index = 'broad'").select("date", F.lit(1).alias("has")), "date", "left").agg((F.count("has") / F.count("*")).alias("share"))
    chosen = share.select(F.when(F.col("share") >= 0.9, "broad").otherwise("names").alias("index"))
    best = x.join(F.broadcast(chosen), "index", "left_semi")  # one row
    w = Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    y = week.join(best, "date", "left").withColumn("series", F.lit("all"))
    close = F.last("close", ignorenulls=True).over(w)
    opened = F.when(F.col("open") > 0, F.col("open")).otherwise(F.col("close"))
    return y.select("date", R6(opened).alias("open"), R6(close).alias("close"))


def calendar(spark, d) -> DataFrame:
    x = p.bars(spark, d).select("date").distinct().withColumn("series", F.lit("all"))
    return x.select("date", (F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1).cast("long").alias("at"))


def packed_series(spark, d) -> DataFrame:
    """path and content of one binary series for each code and field: from its first week to its last, gaps as no number."""
    import numpy as np

    def pack(x):
        out = []
        for field in FIELDS:
            v = np.full(int(x["at"].max() - x["at"].min()) + 2, np.nan, "<f4")
            v[0] = x["at"].min()
            v[1 + (x["at"] - x["at"].min()).to_numpy()] = x[field].to_numpy()
            out.append((f"features/{x['code'].iloc[0]}/{field}.day.bin", v.tobytes()))
        return x.__class__(out, columns=["path", "content"])

    # a code has one row a week at most
    return p.bars(spark, d).join(calendar(spark, d), "date").select("code", "at", *FIELDS).groupBy("code").applyInPandas(pack, "path string, content binary")


def unpacked(spark, d) -> DataFrame:
    """code, field, at and value from one binary file for each code and field."""
    base = files.new_path(spark, "series")
    files.write_binary(packed_series(spark, d), base)
    part = lambda k: F.split_part("path", F.lit("/"), F.lit(k))
    x = raw.binary_series(files.read_binary(spark, base, "*.bin"))
    return x.select(part(-2).cast("long").alias("code"), F.split_part(part(-1), F.lit("."), F.lit(1)).alias("field"), "at", "value")


def s5_binary_series(spark, d):
    return unpacked(spark, d).where("value is not null").join(calendar(spark, d), "at").groupBy("code", "field").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.round(F.max("value"), 1).alias("most"))


def s6_panel_assembly(spark, d):
    x = raw.panel_of(unpacked(spark, d), calendar(spark, d), FIELDS, BEGIN, END)
    return x.where("close is not null").select("date", "code", F.round("close", 1).alias("close"), F.round("volume", 1).alias("volume"))


def s14_overrides(spark, d):
    """Decisions with comments between them; blank ratios are null and unknown dates go."""
    s = p.read(spark, d, "supplier")
    date = F.when(F.col("s_suppkey") % 7 == 0, "unknown").otherwise(F.date_add(F.lit("1997-01-01").cast("date"), F.col("s_suppkey").cast("int")).cast("string"))
    line = F.concat_ws(",", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), date, F.when(F.col("s_suppkey") % 2 == 0, "keep").otherwise(" adjust "), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.lit("2.5")))
    path = files.new_path(spark, "overrides")
    s.select(F.concat(F.lit("symbol,date,action,ratio\n# decided by hand\n"), line).alias("value")).repartition(1).write.text(path)
    x = raw.commented(spark, path, "symbol string, date string, action string, ratio string").where("symbol != 'symbol' and date != 'unknown'")
    return x.select("symbol", F.to_date("date").alias("date"), "action", F.col("ratio").cast("double").alias("ratio"))


def s15_flag_file(spark, d):
    """Flags by place: a stage at 6, others at 7, 9 and 10; short rows and the header go."""
    s = p.read(spark, d, "supplier")
    k = F.col("s_suppkey")
    field = lambda when, v: F.when(when, v).otherwise(raw.CLEAN)
    row = F.concat_ws(",", F.lit("1"), F.lit("x"), F.concat(F.lit(" s"), k.cast("string")), F.lit("a"), F.lit("b"), F.lit("c"), field(k % 5 == 1, (k % 4).cast("string")), field(k % 6 == 2, "1"), F.lit("z"), field(k % 7 == 3, "0"), field(k % 3 == 0, "2"))
    line = F.when(k % 11 == 5, "1,x,short").otherwise(row)
    path = files.new_path(spark, "flags")
    s.select(F.when(k == 0, F.concat(F.lit("a,b,Symbol,c,d,e,GSM,ASM,f,ESM,IRP\n"), line)).otherwise(line).alias("value")).write.text(path)
    x = raw.flag_file(spark, path, 2, {6: "stage watch", 7: "long watch", 9: "short watch", 10: "pledge"}, 6)
    return x.select("symbol", F.array_join("flags", "; ").alias("flags"))


def s16_newest_file(spark, d):
    """Of three versions of a list the one written last."""
    path = files.new_path(spark, "versions")
    for k in range(3):
        p.read(spark, d, "nation").where(F.col("n_regionkey") <= k + 1).select("n_name").repartition(1).write.mode("append").text(path)
        time.sleep(1.1)  # times of files are told in seconds
    return raw.newest(spark, f"{path}/*.txt").select(F.col("value").alias("n_name"))


def s17_sector_map(spark, d):
    """A map with an untidy header, joined to the suppliers."""
    path = files.new_path(spark, "sectors")
    n = p.read(spark, d, "nation")
    n.select(F.col("n_nationkey").alias(" Symbol "), F.concat(F.col("n_name"), F.lit(" Industry")).alias("INDUSTRY ")).write.options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    x = raw.tidy_header(spark.read.option("header", "true").csv(path)).select(F.col("symbol").cast("int").alias("s_nationkey"), F.trim("industry").alias("industry"))
    return p.read(spark, d, "supplier").join(F.broadcast(x), "s_nationkey", "left").select("s_suppkey", F.coalesce("industry", F.lit("Unknown")).alias("industry"))  # a map kept by people


def s18_reply_documents(spark, d):
    """A folder of JSON documents over several lines, one for each role, read back as rows."""
    x = p.read(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    doc = F.to_json(F.struct(F.col("role").alias("provider"), F.struct("n", "last_turn").alias("usage"), F.col("chars").alias("seconds")), {"pretty": "true"})
    path = files.new_path(spark, "replies")
    x.select("role", doc.alias("value")).repartition("role").write.partitionBy("role").text(path)
    got = spark.read.schema("provider string, usage struct<n: long, last_turn: long>, seconds long").option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return got.select("provider", "usage.n", "usage.last_turn", "seconds")


def s19_incremental_ingest(spark, d):
    """Three arrivals of events, each of which overlaps with what is there: only new keys go in, and not those of days known to be empty."""
    e = p.read(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), "event_type")
    empty = e.where("dayofmonth(day) = 7").select("day").distinct()
    path = files.new_path(spark, "ingested")
    for k in range(1, 4):
        known = spark.read.schema(e.schema).parquet(path) if k > 1 else e.limit(0)
        raw.new_rows(e.where(F.col("event_id") % 3 < k), known, ["event_id"], empty).write.mode("append").parquet(path)
    return spark.read.schema(e.schema).parquet(path).groupBy("day", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


CALLS = (
    s1_daily_files, s1_bad_files, s2_series_filter, u1_union_of_files, s3_index_files, s4_benchmark_choice, s5_binary_series, s6_panel_assembly, s14_overrides, s15_flag_file, s16_newest_file, s17_sector_map, s18_reply_documents, s19_incremental_ingest,
)
QUERIES = {c.__name__: c for c in CALLS}

DAYS = """WITH dd AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS code, arg_min(px, o) AS open, max(px) AS high, min(px) AS low, arg_max(px, o) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS value
 FROM (SELECT *, l_extendedprice / l_quantity AS px, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS o FROM lineitem) GROUP BY 1, 2),
dy AS (SELECT *, 'S' || code AS symbol, CASE WHEN code % 8 = 5 THEN 'INF' ELSE 'INE' END || lpad(CAST(code AS VARCHAR), 6, '0') AS isin, CASE code % 10 WHEN 3 THEN 'BE' WHEN 7 THEN 'GS' ELSE 'EQ' END AS series, lag(close) OVER (PARTITION BY code ORDER BY date) AS prevclose FROM dd)"""
GOOD = "dayofyear(date) % 97 != 13 AND dayofyear(date) % 101 != 5 AND dayofyear(date) % 31 != 7"
IDX = f"""{WITH}, wk AS (SELECT date, CAST(sum(volume) AS BIGINT) AS v, count(*) AS n FROM bars GROUP BY 1),
ix AS (SELECT date, 'broad' AS "index", CASE WHEN v % 7 = 0 THEN 0 ELSE v - 1 END AS open, v AS close FROM wk WHERE year(date) > 1996 OR weekofyear(date) % 2 = 0 UNION ALL SELECT date, 'names', NULL, n * 1000 FROM wk)"""
CAL = f"{WITH}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS at_ FROM (SELECT DISTINCT date FROM bars))"
SQL = {
    "s1_daily_files": f"{DAYS} SELECT date, symbol, isin, series, " + ", ".join(f"{r6(c)} AS {c}" for c in ("open", "high", "low", "close", "prevclose", "volume", "value")) + f" FROM dy WHERE series != 'GS' AND {GOOD}",
    "s1_bad_files": f"SELECT strftime(date, '%Y%m%d') || '.csv.zip' AS file, CASE WHEN dayofyear(date) % 97 = 13 THEN 'no archive' WHEN dayofyear(date) % 31 = 7 THEN 'no CSV inside' ELSE 'no column for close' END AS error FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) WHERE NOT ({GOOD})",
    "s2_series_filter": f"{DAYS}, k AS (SELECT *, unnest(CASE WHEN series = 'EQ' THEN ['main', 'all'] ELSE ['all'] END) AS kept FROM dy WHERE series != 'GS') SELECT kept, series, date >= DATE '{CHANGE}' AS new_layout, count(*) AS rows FROM k GROUP BY 1, 2, 3",
    "u1_union_of_files": f"{DAYS} SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS rows, count(DISTINCT symbol) AS symbols FROM dy WHERE series != 'GS' GROUP BY 1",
    "s3_index_files": f"{IDX} SELECT date, \"index\", {r6('open')} AS open, {r6('close')} AS close FROM ix",
    "s4_benchmark_choice": f"""{IDX}, ch AS (SELECT CASE WHEN (SELECT count(*) FROM ix WHERE "index" = 'broad') >= 0.9 * (SELECT count(*) FROM wk) THEN 'broad' ELSE 'names' END AS c),
 y AS (SELECT wk.date, open, close FROM wk LEFT JOIN (SELECT ix.* FROM ix, ch WHERE "index" = c) b ON b.date = wk.date) SELECT date, {r6('CASE WHEN open > 0 THEN open ELSE close END')} AS open, {r6('last_value(close IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS close FROM y""",
    "s5_binary_series": f"{WITH}, l AS (SELECT code, date, unnest(['close', 'volume']) AS field, unnest([close, volume]) AS v FROM bars) SELECT code, field, count(*) AS n, min(date) AS \"first\", max(date) AS \"last\", round(max(CAST(CAST(v AS FLOAT) AS DOUBLE)), 1) AS most FROM l GROUP BY 1, 2",
    "s6_panel_assembly": f"{WITH} SELECT date, code, round(CAST(CAST(close AS FLOAT) AS DOUBLE), 1) AS close, round(CAST(CAST(volume AS FLOAT) AS DOUBLE), 1) AS volume FROM bars WHERE date BETWEEN DATE '{BEGIN}' AND DATE '{END}'",
    "s14_overrides": "SELECT 'S' || s_suppkey AS symbol, CAST(DATE '1997-01-01' + CAST(s_suppkey AS INTEGER) AS DATE) AS date, CASE WHEN s_suppkey % 2 = 0 THEN 'keep' ELSE 'adjust' END AS action, CASE WHEN s_suppkey % 3 != 0 THEN 2.5::DOUBLE END AS ratio FROM supplier WHERE s_suppkey % 7 != 0",
    "s15_flag_file": "SELECT 'S' || s_suppkey AS symbol, concat_ws('; ', CASE WHEN s_suppkey % 5 = 1 THEN 'stage watch (stage ' || s_suppkey % 4 || ')' END, CASE WHEN s_suppkey % 6 = 2 THEN 'long watch' END, CASE WHEN s_suppkey % 7 = 3 THEN 'short watch' END, CASE WHEN s_suppkey % 3 = 0 THEN 'pledge' END) AS flags FROM supplier WHERE s_suppkey % 11 != 5",
    "s16_newest_file": "SELECT n_name FROM nation WHERE n_regionkey <= 3",
    "s17_sector_map": "SELECT s_suppkey, coalesce(n_name || ' Industry', 'Unknown') AS industry FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey",
    "s18_reply_documents": "SELECT role AS provider, count(*) AS n, max(turn) AS last_turn, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS seconds FROM conversations GROUP BY 1",
    "s19_incremental_ingest": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE dayofmonth(ts) != 7 GROUP BY 1, 2",
}
