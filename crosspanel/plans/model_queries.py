"""Queries of yearly models, calibration, own functions and streams; those that SQL can say have their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import factors as f
from crosspanel.operators import models as m
from crosspanel.operators import wide
from crosspanel.plans import book_queries as bk
from crosspanel.plans.book_queries import AHEAD, R6, r6
from crosspanel.plans.factor_queries import LAGS, WITH, filled, w
from crosspanel.plans.panel_queries import SQL as PANEL_SQL
from crosspanel.sources import files
from crosspanel.sources import panel as p
from crosspanel.streaming import runs

FEATURES = ["level", "size", "move", "range", "mkt_ret4"]
#: What a feature tells of: the name's price, its trade, or the whole market.
GROUPS = {"level": "price", "move": "price", "range": "price", "size": "trade", "mkt_ret4": "market"}
#: Books of several sizes and zones in which held names stay.
DESIGNS = [(top, top * zone) for top in (3, 5, 10, 20) for zone in (2, 3)]
DAY_SCHEMA = "event_id long, user_id long, event_type string, value double"


def labelled(spark, d) -> DataFrame:
    return m.targets(bk.ahead(spark, d).where("r is not null").join(bk.market(spark, d).where("bench is not null"), "date"))


def feature_table(spark, d) -> DataFrame:
    """date, code, t, known, centred ranks of four features (missing as the middle), and the market's return as it is."""
    c = F.col("close")
    x = p.dense_bars(spark, d).select("date", "code", "t", c.alias("level"), F.col("volume").alias("size"), (c / f.ref(c, 3)).alias("move"), (F.col("high") / F.col("low")).alias("range"), F.lead("date", 1).over(f.by_code()).alias("known")).where("level is not null")
    level = p.benchmark(p.bars(spark, d)).withColumn("series", F.lit("all"))
    market = level.select("date", (F.col("level") / F.lag("level", 4).over(Window.partitionBy("series").orderBy("date")) - 1).alias("mkt_ret4"))
    near = x.select("date", "code", "t", "known", *(F.round(F.col(k).cast("double"), 9).alias(k) for k in FEATURES[:4]))
    ranks = wide.day_ranks(near, FEATURES[:4], keep=("t", "known")).select("date", "code", "t", "known", *(F.coalesce(k, F.lit(0.0)).alias(k) for k in FEATURES[:4]))
    return ranks.join(F.broadcast(market), "date", "left")  # a row for each date


def rows(spark, d) -> DataFrame:
    """`feature_table` with y, y_rank and excess of `labelled` where they are known, from one table of bars of whole codes and one pass over each day."""
    first, last = p.calendar(spark, d)
    c, week = F.col("close"), Window.partitionBy("code").orderBy("t")
    x = bk.with_ahead(p.code_bars(spark, d, first)).withColumn("move", c / F.first("close").over(week.rangeBetween(-3, -3)))
    known = F.when(F.col("t") < p.weeks(first, last), F.date_add("date", 7)).alias("known")
    x = x.where("close is not null").select("date", "code", "t", known, c.alias("level"), F.col("volume").alias("size"), "move", (F.col("high") / F.col("low")).alias("range"), "r")
    level = F.col("level")
    all_dates = Window.partitionBy("series").orderBy("date")
    market = p.benchmark(p.bars(spark, d)).withColumn("series", F.lit("all")).select("date", (level / F.lag("level", 4).over(all_dates) - 1).alias("mkt_ret4"), (F.lead("level").over(all_dates) / level - 1).alias("bench"))
    near = x.join(F.broadcast(market), "date", "left")  # a row for each date
    keep = ["date", "code", "t", "known"]
    near = near.select(*keep, *(F.round(F.col(k).cast("double"), 9).alias(k) for k in FEATURES[:4]), "mkt_ret4", (F.col("r") - F.col("bench")).alias("excess"))
    made = wide.day_ranks(near, FEATURES[:4], keep=("t", "known", "mkt_ret4", "excess"), middle=["excess"])
    labels = (F.col("excess") > 0).cast("double").alias("y"), (F.col("excess") > F.col("excess_median")).cast("double").alias("y_rank")
    return made.select(*keep, *(F.coalesce(k, F.lit(0.0)).alias(k) for k in FEATURES[:4]), "mkt_ret4", *labels, "excess")


def m1_targets(spark, d):
    return labelled(spark, d).select("date", "code", R6(F.col("excess")).alias("excess"), F.col("y").cast("int").alias("y"), F.col("y_rank").cast("int").alias("y_rank"))


def m2_feature_table(spark, d):
    return feature_table(spark, d).select("date", "code", *(R6(F.col(k)).alias(k) for k in FEATURES))


def m8_baseline_scores(spark, d):
    """Scores of one feature each: change over five weeks, its inverse over sixty, low spread, and low link of price and volume."""
    c = F.col("close")
    x = p.dense_bars(spark, d).select("date", "code", (f.ref(c, 5) / c).alias("roc5"), (c / f.ref(c, 60)).alias("inv_roc60"), (-f.std(c, 20) / c).alias("low_std20"), (-f.corr(c, F.log(F.col("volume") + 1), 20)).alias("low_corr20"))
    return x.select("date", "code", *(R6(F.col(k)).alias(k) for k in ("roc5", "inv_roc60", "low_std20", "low_corr20")))


def m3_walk_forward(spark, d):
    """Predictions of all years that can be tested, each from trees that saw only labels known before; no rows where no year has enough."""
    weeks = p.read(spark, d, "lineitem").select(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"))  # those of the bars
    out = m.walk_forward(rows(spark, d), FEATURES, "y_rank", m.years_of(weeks))
    return out if out is not None else spark.createDataFrame([], "date date, code long, year int, p_raw double, rank double, p double")


def latest(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows to fit on, those of the last 365 days with a known label, and those of the last date."""
    made, path = rows(spark, d).fillna(0.0, subset=FEATURES), files.new_path(spark, "model-rows")
    made.write.parquet(path)
    x = spark.read.schema(made.schema).parquet(path)
    x = x.withColumn("now", F.lit(x.agg(F.max("date")).first()[0]))
    known = x.where("y_rank is not null")
    cut = F.date_sub("now", 365)
    return known.where(F.col("known") < cut), known.where(F.col("date") >= cut), x.where("date = now")


def m4_platt(spark, d):
    """The two numbers that map the rank of a week to a probability, on the last year."""
    train, valid, _ = latest(spark, d)
    a, b = m.platt(m.week_percentile(m.scored(m.boosted(train, valid, FEATURES, "y_rank"), valid)), "y_rank")
    return train.agg(F.count("*").alias("train_rows")).select("train_rows", F.lit(a).alias("a"), F.lit(b).alias("b"))


def m5_isotonic(spark, d):
    """Calibrated probabilities of the last year's rows by the rising step map."""
    train, valid, _ = latest(spark, d)
    x = m.week_percentile(m.scored(m.boosted(train, valid, FEATURES, "y_rank"), valid))
    model = m.isotonic(x, "rank", "y_rank")
    return model.transform(x.withColumn("score", F.col("rank"))).select("date", "code", "rank", "p", "y_rank")


def m6_latest_scores(spark, d):
    """The last date's names in order of their probability."""
    train, valid, now = latest(spark, d)
    model = m.boosted(train, valid, FEATURES, "y_rank")
    a, b = m.platt(m.week_percentile(m.scored(model, valid)), "y_rank")
    x = m.week_percentile(m.scored(model, now))
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("p"), "code"))
    return x.withColumn("p", 1 / (1 + F.exp(-(a + b * F.col("rank"))))).select("date", "code", "p", place.alias("position"))


def m7_contributions(spark, d):
    """For each of the last date's names the three features that move its score most."""
    train, valid, now = latest(spark, d)
    x = m.contributions(m.boosted(train, valid, FEATURES, "y_rank"), now)
    k = F.row_number().over(Window.partitionBy("date", "code").orderBy(F.desc(F.abs("contribution")), "feature"))
    return x.withColumn("k", k).where("k <= 3")


def a30_model_importance(spark, d):
    """Each feature's share of the gains of the latest model, and that of its group."""
    train, valid, _ = latest(spark, d)
    return m.importance(m.boosted(train, valid, FEATURES, "y_rank"), spark, GROUPS)


def a47_model_reasons(spark, d):
    """For each week of the last year what the model's book was chosen for: by feature the summed size of its contributions, names that it favours, and their return over the index."""
    train, valid, _ = latest(spark, d)
    model = m.boosted(train, valid, FEATURES, "y_rank")
    day = Window.partitionBy("date").orderBy(F.desc("p_raw"), "code")
    book = m.scored(model, valid).withColumn("place", F.row_number().over(day)).where(F.col("place") <= bk.SLOTS)
    why = m.contributions(model, book).join(book.select("date", "code", "excess"), ["date", "code"])
    favoured = F.when(F.col("contribution") > 0, F.col("excess"))
    used = why.groupBy("date", "feature").agg(F.sum(F.abs("contribution")).alias("size"), F.count_if(F.col("contribution") > 0).alias("names"), F.avg(favoured).alias("favoured_excess"))
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("size"), "feature"))
    return used.withColumn("k", k)


def d1_ema(spark, d):
    x = wide.ema(p.dense_bars(spark, d).select("date", "code", "t", "close"), "close", 6)
    return x.select("date", "code", (F.round(F.col("v") + 1e-9, 4) + 0.0).alias("v"))


def d2_window_function(spark, d):
    """An own function over a frame of five weeks: here the span of the values, for a block of windows at a time."""
    x = wide.framed(p.dense_bars(spark, d), "close", 5, lambda block: block.max(1) - block.min(1))
    return x.select("date", "code", R6(F.col("v")).alias("v"))


def d4_many_factors(spark, d):
    """Six factors in one pass; equal windows are made once."""
    mean5 = ("Mean", "close", 5)
    specs = {"mean": mean5, "gap": ("Delta", mean5, 1), "rank": ("CsRank", mean5), "low": ("TsMin", mean5, 4), "spread": ("Std", "close", 5), "score": ("CsZscore", ("Pct", mean5, 2))}
    return p.dense_bars(spark, d).select("date", "code", "t", *(f.factor(e).alias(k) for k, e in specs.items())).select("date", "code", *(R6(F.col(k)).alias(k) for k in specs))


def d5_capped_book(spark, d):
    """Books of eight designs, each of which keeps held names while they rank within its zone."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("value"), "code"))
    ranked = p.bars(spark, d).select("date", "code", rank.alias("rank"))
    designs = spark.createDataFrame([(f"{top}-{zone}", top, zone) for top, zone in DESIGNS], "variant string, top int, zone int")
    met = ranked.join(F.broadcast(designs), F.col("rank") <= F.col("zone"))  # eight designs
    return m.capped_book(met, "top", "zone")


def r3_weekly_bars(spark, d):
    x = runs.finished(runs.weekly_bars(runs.events(spark, d)), "append")
    return x.select("week", "event_type", "open", "high", "low", "close", F.round("total", 2).alias("total"), "n")


def r4_once_per_key(spark, d):
    """Of the events that are sent twice each counts once."""
    x = runs.events(spark, d)
    twice = x.withColumn("sent", F.explode(F.array(F.lit(1), F.lit(2))))
    out = runs.finished(runs.once_per_key(twice, ["event_id"]), "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


def day_rows(spark, d) -> DataFrame:
    return p.read(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.dayofmonth("ts").alias("day"))


def r1_file_ingest(spark, d):
    """Files that land in two parts; the stream runs after each and reads every file once."""
    base = runs.folder(spark)
    for part in (0, 1):
        day_rows(spark, d).where(F.col("day") % 2 == part).drop("day").write.mode("append").option("header", "true").csv(f"{base}/landed")
        runs.ingested(spark, f"{base}/landed", DAY_SCHEMA, f"{base}/table", f"{base}/checkpoint")
    return spark.read.schema(DAY_SCHEMA).parquet(f"{base}/table").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def r5_late_correction(spark, d):
    """Every fifth day comes with half its rows at first and whole later; days that fail wait, and other days stay as they are."""
    base, schema = runs.folder(spark), DAY_SCHEMA + ", day int"
    x = day_rows(spark, d)
    first = x.where((F.col("day") % 7 != 3) & ((F.col("day") % 5 != 0) | (F.col("event_id") % 2 == 0)))
    for some in (first, x.where((F.col("day") % 5 == 0) | (F.col("day") % 7 == 3))):
        some.write.mode("append").option("header", "true").csv(f"{base}/landed")
        runs.corrected(spark, f"{base}/landed", schema, f"{base}/table", f"{base}/checkpoint", "day")
    return spark.read.schema(schema).parquet(f"{base}/table").groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def s12_json_means(spark, d):
    """A JSON text for each code: weeks and mean return; a mean over nothing, which is no number, is null in it."""
    x = bk.ahead(spark, d).groupBy("code").agg(F.count("r").alias("weeks"), F.when(F.col("code") % 4 == 3, float("nan")).otherwise(R6(F.avg("r"))).alias("mean"))
    return x.select("code", F.concat(F.lit('{"weeks":'), F.col("weeks").cast("string"), F.lit(',"mean":'), F.coalesce(files.json_number(F.col("mean")), F.lit("null")), F.lit("}")).alias("summary"))


CALLS = (
    m1_targets, m2_feature_table, m8_baseline_scores, m3_walk_forward, m4_platt, m5_isotonic, m6_latest_scores, m7_contributions, a30_model_importance, a47_model_reasons, d1_ema, d2_window_function, d4_many_factors, d5_capped_book, r3_weekly_bars, r4_once_per_key, r1_file_ingest, r5_late_correction, s12_json_means,
)
QUERIES = {c.__name__: c for c in CALLS}

LABELLED = f"""{WITH}, {AHEAD}, mk AS (SELECT date, lead(level) OVER (ORDER BY date) / level - 1 AS bench FROM (SELECT date, round(sum(value), 2) / sum(volume) AS level FROM bars GROUP BY 1)), ex AS (SELECT a.date, code, r - bench AS excess FROM ahead a JOIN mk ON mk.date = a.date WHERE r IS NOT NULL AND bench IS NOT NULL)"""


def _rank(c: str) -> str:
    return f"coalesce(CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY date, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY date) - 0.5 END, 0)"


MEAN5 = filled(w("avg", "close", 5), "close", 5)
LV = "ln(volume + 1)"


def _corr20() -> str:
    a = lambda e: f"avg({e}) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    va, vb = (f"({a(f'{x} * {x}')} - {a(x)} * {a(x)})" for x in ("close", "lv"))
    return filled(f"({a('close * lv')} - {a('close')} * {a('lv')}) / sqrt(greatest({va} * {vb}, 1e-12))", "close", 20)


F4 = "OVER (PARTITION BY code ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
SQL = {
    "m1_targets": f"{LABELLED} SELECT date, code, {r6('excess')} AS excess, CAST(excess > 0 AS INTEGER) AS y, CAST(excess > quantile_cont(excess, 0.5) OVER (PARTITION BY date) AS INTEGER) AS y_rank FROM ex",
    "m2_feature_table": f"""{WITH}, fx AS (SELECT date, code, close AS level, volume AS size, round(close / lag(close, 3) {LAGS}, 9) AS move, round(high / low, 9) AS range_ FROM dense), fy AS (SELECT date, code, round(level, 9) AS level, round(size, 9) AS size, move, range_ FROM fx WHERE level IS NOT NULL),
 mk AS (SELECT date, lv / lag(lv, 4) OVER (ORDER BY date) - 1 AS mkt_ret4 FROM (SELECT date, round(sum(value), 2) / sum(volume) AS lv FROM bars GROUP BY 1))
 SELECT date, code, {r6(_rank('level'))} AS level, {r6(_rank('size'))} AS size, {r6(_rank('move'))} AS move, {r6(_rank('range_'))} AS range, {r6('mkt_ret4')} AS mkt_ret4 FROM fy LEFT JOIN mk USING (date)""",
    "m8_baseline_scores": f"{WITH}, lx AS (SELECT *, {LV} AS lv FROM dense) SELECT date, code, {r6(f'lag(close, 5) {LAGS} / close')} AS roc5, {r6(f'close / lag(close, 60) {LAGS}')} AS inv_roc60, {r6('-(' + filled(w('stddev_samp', 'close', 20), 'close', 20) + ') / close')} AS low_std20, {r6('-(' + _corr20() + ')')} AS low_corr20 FROM lx",
    "d1_ema": PANEL_SQL["w12_ema"],
    "d2_window_function": f"{WITH} SELECT date, code, {r6(filled(w('max', 'close', 5) + ' - ' + w('min', 'close', 5), 'close', 5))} AS v FROM dense",
    "d4_many_factors": f"""{WITH}, a AS (SELECT *, {MEAN5} AS m5, {filled(w('stddev_samp', 'close', 5), 'close', 5)} AS spread FROM dense), b AS (SELECT *, CASE WHEN abs(lag(m5, 2) {LAGS}) > 1e-12 THEN m5 / lag(m5, 2) {LAGS} END - 1 AS pc, CASE WHEN count(m5) {F4} = 4 THEN min(m5) {F4} END AS mlow, m5 - lag(m5) {LAGS} AS gap FROM a)
 SELECT date, code, {r6('m5')} AS mean, {r6('gap')} AS gap, {r6('CASE WHEN m5 IS NOT NULL THEN (rank() OVER (PARTITION BY date, m5 IS NULL ORDER BY m5) + (count(*) OVER (PARTITION BY date, m5) - 1) / 2.0) / count(m5) OVER (PARTITION BY date) END')} AS rank, {r6('mlow')} AS low, {r6('spread')} AS spread, {r6('(pc - avg(pc) OVER (PARTITION BY date)) / (stddev_samp(pc) OVER (PARTITION BY date) + 1e-12)')} AS score FROM b""",
    "r3_weekly_bars": "SELECT * FROM (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week, event_type, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1, 2) WHERE week + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
    "r4_once_per_key": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
    "r1_file_ingest": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "r5_late_correction": "SELECT CAST(dayofmonth(ts) AS INTEGER) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "s12_json_means": f"""{WITH}, {AHEAD} SELECT code, '{{"weeks":' || count(r) || ',"mean":' || CASE WHEN code % 4 = 3 OR avg(r) IS NULL THEN 'null' ELSE CAST({r6('avg(r)')} AS VARCHAR) END || '}}' AS summary FROM ahead GROUP BY 1""",
}
