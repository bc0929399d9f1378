"""Queries of joins, aggregations, top-k, set and text operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosspanel.operators import scoring as s
from crosspanel.operators import spells as sp
from crosspanel.plans.factor_queries import LAGS, WITH, filled, w
from crosspanel.sources import panel as p

R = lambda c: (F.round(c + 1e-9, 6) + 0.0)
SCORED = f"{WITH}, scored AS (SELECT date, code, {filled(w('avg', 'close', 2), 'close', 2)} / close AS f, lead(open, 6) {LAGS} / lead(open, 1) {LAGS} - 1 AS fwd FROM dense)"
RANKS = "ranks AS (SELECT date, code, CASE WHEN f IS NOT NULL THEN rank() OVER (PARTITION BY date, f IS NULL ORDER BY f) + (count(*) OVER (PARTITION BY date, f) - 1) / 2.0 END AS f, CASE WHEN fwd IS NOT NULL THEN rank() OVER (PARTITION BY date, fwd IS NULL ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 END AS fwd, count(f) OVER (PARTITION BY date) AS nf, fwd AS r FROM scored)"
IC = "ic AS (SELECT date, count(*) AS n, corr(f, fwd) AS ic FROM {t} WHERE f IS NOT NULL AND fwd IS NOT NULL GROUP BY 1 HAVING count(*) >= 30)"
LEVEL = "level AS (SELECT date, round(sum(value), 2) / sum(volume) AS level FROM bars GROUP BY 1), ret AS (SELECT date, level / lag(level) OVER (ORDER BY date) - 1 AS r FROM level)"


def scored(spark, d):
    return s.scored(p.dense_bars(spark, d))


def returns(spark, d):
    """Weekly benchmark returns; one series, kept under a key so that windows follow the number of series."""
    level = p.benchmark(p.bars(spark, d)).withColumn("series", F.lit("all"))
    return level.withColumn("r", F.col("level") / F.lag("level").over(Window.partitionBy("series").orderBy("date")) - 1).where("r is not null")


def slice0_factor_ic(spark, d):
    return s.spearman_ic(scored(spark, d)).select("date", "n", R(F.col("ic")).alias("ic"))


def a5_daily_pearson_ic(spark, d):
    return s.pearson_ic(scored(spark, d)).select("date", "n", R(F.col("ic")).alias("ic"))


def a7_ic_summary(spark, d):
    return s.ic_summary(s.spearman_ic(scored(spark, d))).select("n", *(R(F.col(c)).alias(c) for c in ("mean_ic", "ir", "t", "share_up")))


def a4_equal_weight(spark, d):
    return scored(spark, d).groupBy("date").agg(R(F.avg("fwd")).alias("ew"))


def a14_quantile_spread(spark, d):
    return s.quantile_spread(scored(spark, d)).select("date", R(F.col("spread")).alias("spread"))


def a1_members_per_day(spark, d):
    n = p.bars(spark, d).groupBy("date").count()
    return n.agg(F.min("count").alias("least"), F.percentile("count", 0.5).alias("median"), F.max("count").alias("most"))


def a3_events_by_kind(spark, d):
    e = p.read(spark, d, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def a10_year_return(spark, d):
    return returns(spark, d).groupBy(F.year("date").alias("year")).agg(R(F.product(F.col("r") + 1) - 1).alias("ret"))


def a31_moments(spark, d):
    return returns(spark, d).agg(F.count("r").alias("n"), R(F.avg("r")).alias("mean"), R(F.stddev_samp("r")).alias("sd"), R(F.kurtosis("r") + 3).alias("kurt"))


def w40_drawdown(spark, d):
    return s.drawdown(returns(spark, d)).select("date", R(F.col("equity")).alias("equity"), R(F.col("drawdown")).alias("drawdown"))


def w41_trailing_return(spark, d):
    win = Window.partitionBy("series").orderBy("date").rowsBetween(-13, -1)
    return returns(spark, d).select("date", R(F.when(F.count("r").over(win) == 13, F.product(F.col("r") + 1).over(win) - 1)).alias("v"))


def w49_rolling_alpha(spark, d):
    win = Window.partitionBy("code").orderBy("date").rowsBetween(-51, 0)
    x = scored(spark, d).where("f is not null and fwd is not null")
    return x.select("date", "code", R(F.when(F.count("*").over(win) == 52, F.regr_intercept("fwd", "f").over(win))).alias("v"))


def j1_interval_join(spark, d):
    """How many customers there are in each week between their first and their last order."""
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    spells = p.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.min(week).alias("start"), F.max(week).alias("end"))
    return sp.members(spells, order_weeks(spark, d)).groupBy("date").agg(F.count("*").alias("members"))


def order_weeks(spark, d):
    """The weeks from the first order to the last."""
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    ends = p.read(spark, d, "orders").agg(F.min(week).alias("a"), F.max(week).alias("z"))
    return ends.select(F.explode(F.sequence("a", "z", F.expr("interval 7 days"))).alias("date"))


def j1_members(spark, d):
    """date and customer of each week that lies in a spell: an order opens one of 15 to 55 days, spells of one customer overlap, and some end before they start."""
    day = F.to_date("o_orderdate")
    length = F.when(F.col("o_orderkey") % 13 == 0, -1).otherwise(15 + F.col("o_orderkey") % 41).cast("int")
    spells = p.read(spark, d, "orders").select(F.col("o_custkey").alias("code"), day.alias("start"), F.date_add(day, length).alias("end"))
    return sp.members(spells, order_weeks(spark, d))


def j9_asof_tolerance(spark, d):
    """For each error event the user's last purchase at most two days before."""
    e = p.read(spark, d, "events")
    win = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.struct("ts", "value")), ignorenulls=True).over(win)
    x = e.withColumn("last", last).where("event_type = 'error'")
    return x.select("event_id", F.when(F.col("last.ts") >= F.col("ts") - F.expr("interval 2 days"), F.col("last.value")).alias("value"))


def j7_semi_join(spark, d):
    big = p.read(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return p.read(spark, d, "customer").join(big, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def j8_anti_join(spark, d):
    known = p.read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return p.read(spark, d, "customer").join(known, "c_custkey", "left_anti").select("c_custkey", "c_name")


def t1_monthly_top(spark, d):
    x = p.bars(spark, d).groupBy(F.trunc("date", "MM").alias("month"), "code").agg(F.round(F.sum("value"), 2).alias("value"))
    return s.top_k(x, ["month"], [F.desc("value"), F.asc("code")], 20)


def t3_top_k(spark, d):
    return s.top_k(p.bars(spark, d).select("date", "code", R(F.col("close")).alias("close")), ["date"], [F.desc("close"), F.asc("code")], 5)


def t7_keep_first_priority(spark, d):
    x = p.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return s.top_k(x, ["o_custkey"], [F.asc("o_orderpriority"), F.asc("o_orderkey")], 1).drop("rank")


def w59_hysteresis(spark, d):
    x = p.bars(spark, d).select("date", "code", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("value"), "code")).alias("rank"))
    return s.hysteresis(x, 10, 20).select("date", "code", "rank", "held")


def w46_losing_streak(spark, d):
    x = p.read(spark, d, "orders")
    return s.streak(x, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_totalprice") > 250000)


def a56_latest_event(spark, d):
    return p.read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count("*").alias("n"))


def a46_sector_attribution(spark, d):
    """By sector of supplier: value share, mean price and names."""
    sup = p.read(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("n_nationkey"))
    sector = sup.join(p.read(spark, d, "nation"), "n_nationkey").join(p.read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("code", F.col("r_name").alias("sector"))
    x = p.bars(spark, d).join(sector, "code", "left").groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector"))
    return x.agg(F.round(F.sum("value"), 2).alias("value"), F.count_distinct("code").alias("names"), R(F.avg("close")).alias("close"))


def a27_calibration(spark, d):
    """Bins (a, b] of a length score against the labels."""
    score = F.least(F.col("n_chars") / 5000.0, F.lit(1.0))
    x = p.read(spark, d, "documents").join(p.read(spark, d, "labels"), "doc_id").select(score.alias("p"), F.col("quality").alias("y"))
    return x.groupBy(F.when(F.col("p") <= 0.1, 1).otherwise(F.ceil(F.col("p") * 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"), R(F.avg("p")).alias("mean_p"), R(F.avg("y")).alias("mean_y"))


def a40_histogram(spark, d):
    lo, hi = 1000.0, 500000.0
    x = F.greatest(F.lit(lo), F.least(F.lit(hi - 1), "o_totalprice"))
    return p.read(spark, d, "orders").groupBy((F.floor((x - lo) / ((hi - lo) / 30)) + 1).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def w60_hash_chain(spark, d):
    """Each user's events as a chain: an entry's hash and the one before it."""
    e = p.read(spark, d, "events").withColumn("h", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props"), 256))
    return e.select("event_id", "h", F.lag("h", 1, "genesis").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("prev"))


def p15_week_last_day(spark, d):
    day = F.to_date("ts")
    return p.read(spark, d, "events").groupBy(F.next_day(F.date_sub(day, 1), "FRI").alias("week")).agg(F.max(day).alias("last_day"), F.count("*").alias("n"))


def x3_text_screen(spark, d):
    low = F.lower("text")
    rules = F.array_compact(F.array(F.when(low.rlike(r"token\s*="), F.lit("secret")), F.when(low.rlike(r"@mail\d"), F.lit("mail")), F.when(low.rlike("worthless|idiot|moron|scum|clown|disgusting"), F.lit("insult"))))
    return p.read(spark, d, "documents").select("doc_id", F.array_join(rules, ",").alias("problems"))


def x7_keyword_retrieval(spark, d):
    x = p.read(spark, d, "conversations").where(F.size(F.array_intersect(F.split(F.lower("text"), " "), F.array(F.lit("with"), F.lit("from"), F.lit("this")))) > 0)
    return x.groupBy("role").agg(F.count("*").alias("n"))


def u3_book_changes(spark, d):
    """Names that enter and leave the weekly book of the ten largest."""
    book = s.top_k(p.bars(spark, d).select("date", "code", "value"), ["date"], [F.desc("value"), F.asc("code")], 10).select("date", "code")
    before = book.select(F.date_add("date", 7).alias("date"), "code", F.lit(1).alias("was"))
    both = book.withColumn("is", F.lit(1)).join(before, ["date", "code"], "full")
    return both.groupBy("date").agg(F.sum(F.when(F.col("was").isNull(), 1).otherwise(0)).alias("buys"), F.sum(F.when(F.col("is").isNull(), 1).otherwise(0)).alias("sells"))


CALLS = (slice0_factor_ic, a5_daily_pearson_ic, a7_ic_summary, a4_equal_weight, a14_quantile_spread, a1_members_per_day, a3_events_by_kind, a10_year_return, a31_moments, w40_drawdown, w41_trailing_return, w49_rolling_alpha, j1_interval_join, j1_members, j9_asof_tolerance, j7_semi_join, j8_anti_join, t1_monthly_top, t3_top_k, t7_keep_first_priority, w59_hysteresis, w46_losing_streak, a56_latest_event, a46_sector_attribution, a27_calibration, a40_histogram, w60_hash_chain, p15_week_last_day, x3_text_screen, x7_keyword_retrieval, u3_book_changes)
QUERIES = {f.__name__: f for f in CALLS}
BARS_ONLY = WITH
RET = f"{WITH}, {LEVEL}"
SQL = {
    "slice0_factor_ic": f"{SCORED}, {RANKS}, {IC.format(t='ranks')} SELECT date, n, round(ic + 1e-9, 6) AS ic FROM ic",
    "a5_daily_pearson_ic": f"{SCORED}, {IC.format(t='scored')} SELECT date, n, round(ic + 1e-9, 6) AS ic FROM ic",
    "a7_ic_summary": f"{SCORED}, {RANKS}, {IC.format(t='ranks')} SELECT count(ic) AS n, round(avg(ic) + 1e-9, 6) AS mean_ic, round(avg(ic) / stddev_samp(ic) + 1e-9, 6) AS ir, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)) + 1e-9, 6) AS t, round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) + 1e-9, 6) AS share_up FROM ic",
    "a4_equal_weight": f"{SCORED} SELECT date, round(avg(fwd) + 1e-9, 6) AS ew FROM scored GROUP BY 1",
    "a14_quantile_spread": f"{SCORED}, {RANKS} SELECT date, round(avg(r) FILTER (f / nf > 0.8) - avg(r) FILTER (f / nf <= 0.2) + 1e-9, 6) AS spread FROM ranks WHERE f IS NOT NULL GROUP BY 1",
    "a1_members_per_day": f"{WITH} SELECT min(n) AS least, quantile_cont(n, 0.5) AS median, max(n) AS most FROM (SELECT count(*) AS n FROM bars GROUP BY date)",
    "a3_events_by_kind": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "a10_year_return": f"{RET} SELECT CAST(year(date) AS INTEGER) AS year, round(product(1 + r) - 1 + 1e-9, 6) AS ret FROM ret WHERE r IS NOT NULL GROUP BY 1",
    "a31_moments": f"{RET} SELECT count(r) AS n, round(avg(r) + 1e-9, 6) AS mean, round(stddev_samp(r) + 1e-9, 6) AS sd, round(kurtosis_pop(r) + 3 + 1e-9, 6) AS kurt FROM ret",
    "w40_drawdown": f"{RET}, eq AS (SELECT date, product(1 + r) OVER (ORDER BY date) AS equity FROM ret WHERE r IS NOT NULL) SELECT date, round(equity + 1e-9, 6) AS equity, round(equity / max(equity) OVER (ORDER BY date) - 1 + 1e-9, 6) AS drawdown FROM eq",
    "w41_trailing_return": f"{RET} SELECT date, round(CASE WHEN count(r) OVER z = 13 THEN product(1 + r) OVER z - 1 END + 1e-9, 6) AS v FROM (SELECT * FROM ret WHERE r IS NOT NULL) WINDOW z AS (ORDER BY date ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)",
    "w49_rolling_alpha": f"{SCORED} SELECT date, code, round(CASE WHEN count(*) OVER z = 52 THEN regr_intercept(fwd, f) OVER z END + 1e-9, 6) AS v FROM (SELECT * FROM scored WHERE f IS NOT NULL AND fwd IS NOT NULL) WINDOW z AS (PARTITION BY code ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)",
    "j1_interval_join": "WITH s AS (SELECT o_custkey, min(CAST(date_trunc('week', o_orderdate) AS DATE)) AS a, max(CAST(date_trunc('week', o_orderdate) AS DATE)) AS z FROM orders GROUP BY 1), c AS (SELECT DISTINCT CAST(unnest(generate_series((SELECT min(a) FROM s), (SELECT max(z) FROM s), INTERVAL 7 DAY)) AS DATE) AS date) SELECT date, count(*) AS members FROM c JOIN s ON date BETWEEN a AND z GROUP BY 1",
    "j1_members": "WITH s AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE 15 + o_orderkey % 41 END AS INTEGER) AS z FROM orders), c AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('week', min(o_orderdate)) AS DATE), CAST(date_trunc('week', max(o_orderdate)) AS DATE), INTERVAL 7 DAY)) AS DATE) AS date FROM orders) SELECT DISTINCT date, code FROM c JOIN s ON date BETWEEN a AND z",
    "j9_asof_tolerance": "SELECT e.event_id, (SELECT CASE WHEN arg_max(b.ts, (b.ts, b.event_id)) >= e.ts - INTERVAL 2 DAY THEN arg_max(b.value, (b.ts, b.event_id)) END FROM events b WHERE b.user_id = e.user_id AND b.event_type = 'purchase' AND (b.ts < e.ts OR b.ts = e.ts AND b.event_id < e.event_id)) AS value FROM events e WHERE e.event_type = 'error'",
    "j7_semi_join": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY 1",
    "j8_anti_join": "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "t1_monthly_top": f"{WITH} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY month ORDER BY value DESC, code) AS INTEGER) AS rank FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, code, round(sum(value), 2) AS value FROM bars GROUP BY 1, 2)) WHERE rank <= 20",
    "t3_top_k": f"{WITH} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY close DESC, code) AS INTEGER) AS rank FROM (SELECT date, code, round(close + 1e-9, 6) AS close FROM bars)) WHERE rank <= 5",
    "t7_keep_first_priority": "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1",
    "w59_hysteresis": f"{WITH}, k AS (SELECT date, code, CAST(row_number() OVER (PARTITION BY date ORDER BY value DESC, code) AS INTEGER) AS rank FROM bars) SELECT date, code, rank, CAST(coalesce(last_value(CASE WHEN rank <= 10 THEN 1 WHEN rank > 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS held FROM k",
    "w46_losing_streak": "SELECT o_custkey, CAST(sum(CASE WHEN wins = 0 THEN 1 ELSE 0 END) AS BIGINT) AS losses FROM (SELECT o_custkey, sum(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS wins FROM orders) GROUP BY 1",
    "a56_latest_event": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n FROM events GROUP BY 1",
    "a46_sector_attribution": f"{WITH} SELECT coalesce(r_name, 'Unknown') AS sector, round(sum(value), 2) AS value, count(DISTINCT code) AS names, round(avg(close) + 1e-9, 6) AS close FROM bars LEFT JOIN supplier ON s_suppkey = code LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    "a27_calibration": "SELECT CAST(CASE WHEN p <= 0.1 THEN 1 ELSE ceil(p * 10) END AS INTEGER) AS bin, count(*) AS n, round(avg(p) + 1e-9, 6) AS mean_p, round(avg(quality) + 1e-9, 6) AS mean_y FROM (SELECT least(n_chars / CAST(5000 AS DOUBLE), 1.0) AS p, quality FROM documents JOIN labels USING (doc_id)) GROUP BY 1",
    "a40_histogram": "SELECT CAST(floor((greatest(1000.0::DOUBLE, least(499999.0::DOUBLE, o_totalprice)) - 1000) / (499000 / 30.0::DOUBLE)) + 1 AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "w60_hash_chain": "SELECT event_id, h, lag(h, 1, 'genesis') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM (SELECT *, sha256(concat_ws('|', CAST(event_id AS VARCHAR), event_type, props)) AS h FROM events)",
    "p15_week_last_day": "SELECT CAST(CAST(ts AS DATE) + CAST((5 - isodow(CAST(ts AS DATE)) + 7) % 7 AS INTEGER) AS DATE) AS week, max(CAST(ts AS DATE)) AS last_day, count(*) AS n FROM events GROUP BY 1",
    "x3_text_screen": "SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), 'token\\s*=') THEN 'secret' END, CASE WHEN regexp_matches(lower(text), '@mail\\d') THEN 'mail' END, CASE WHEN regexp_matches(lower(text), 'worthless|idiot|moron|scum|clown|disgusting') THEN 'insult' END) AS problems FROM documents",
    "x7_keyword_retrieval": "SELECT role, count(*) AS n FROM conversations WHERE len(list_intersect(string_split(lower(text), ' '), ['with', 'from', 'this'])) > 0 GROUP BY 1",
    "u3_book_changes": f"{WITH}, book AS (SELECT date, code FROM bars QUALIFY row_number() OVER (PARTITION BY date ORDER BY value DESC, code) <= 10), b AS (SELECT date + 7 AS date, code FROM book) SELECT coalesce(book.date, b.date) AS date, CAST(sum(CASE WHEN b.code IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS buys, CAST(sum(CASE WHEN book.code IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS sells FROM book FULL JOIN b ON book.date = b.date AND book.code = b.code GROUP BY 1",
}
