"""Queries of the market's health, the ledger of books, their post-mortem and paper trades, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import factors as f
from crosspanel.operators import books as b
from crosspanel.operators.expanding import average_rank, expanding_counts
from crosspanel.plans import book_queries as bk
from crosspanel.plans.book_queries import AHEAD, R6, WEEKS, r6
from crosspanel.plans.factor_queries import LAGS, WITH
from crosspanel.sources import panel as p

LOW, HIGH, HISTORY, LEAST_MEASURES = 30, 60, 52, 4
SWITCH_COST = 0.002


def expanding_rank(x: DataFrame, key: list[str], value: str, least: int) -> DataFrame:
    """`x` with rank: the share of a row's value among those of its key up to its date, ties in the middle; null before `least` values."""
    ranked = expanding_counts(x, key, "date", value)
    return ranked.withColumn("rank", F.when(F.col("n") >= least, average_rank())).drop("n", "below", "equal")


def sectors(spark, d) -> DataFrame:
    nation = p.read(spark, d, "nation").join(p.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return p.read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("code"), F.col("r_name").alias("sector"))


def breadth(spark, d) -> DataFrame:
    """date and six measures: shares above the 40- and the 10-week mean, rises less falls and highs less lows as means of ten weeks, sectors in which most names rise, and the index over its mean."""
    c, by = F.col("close"), f.by_code()
    some = lambda fn, n, least: F.when(F.count("close").over(f.by_code(n)) >= least, fn("close").over(f.by_code(n)))
    x = p.dense_bars(spark, d).select("date", "code", "close", some(F.avg, 40, 20).alias("slow"), some(F.avg, 10, 5).alias("fast"), some(F.max, 52, 26).alias("high"), some(F.min, 52, 26).alias("low"), F.lag(c).over(by).alias("c1"))
    x = x.where("close is not null")
    one = lambda e: F.count_if(e)
    n = F.count("*")
    day = x.groupBy("date").agg((one(c > F.col("slow")) / n).alias("above_slow"), (one(c > F.col("fast")) / n).alias("above_fast"), ((one(c > F.col("c1")) - one(c < F.col("c1"))) / n).alias("net_up"), ((one(c >= F.col("high")) - one(c <= F.col("low"))) / n).alias("net_high"))
    up = x.where("fast is not null").join(sectors(spark, d), "code").groupBy("date", "sector").agg(F.avg((c > F.col("fast")).cast("double")).alias("up"))
    per = up.groupBy("date").agg(F.when(F.count("*") >= 4, F.avg((F.col("up") > 0.5).cast("double"))).alias("sectors"))
    x = day.join(per, "date", "left").join(p.benchmark(p.bars(spark, d)), "date").withColumn("series", F.lit("all"))
    w = Window.partitionBy("series").orderBy("date")
    ten = lambda e: F.when(F.count(e).over(w.rowsBetween(-9, 0)) == 10, F.avg(e).over(w.rowsBetween(-9, 0)))
    trend = F.when(F.count("level").over(w.rowsBetween(-39, 0)) >= 30, F.col("level") / F.avg("level").over(w.rowsBetween(-39, 0)) - 1)
    late = lambda e: F.when(F.row_number().over(w) > HISTORY / 2, e)
    return x.select("series", "date", late(F.col("above_slow")).alias("above_slow"), "above_fast", ten("net_up").alias("adv_dec"), late(ten("net_high")).alias("highs_lows"), "sectors", late(trend).alias("index_trend"), "level")


MEASURES = ("above_slow", "above_fast", "adv_dec", "highs_lows", "sectors", "index_trend")


def zone(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score < LOW, "weak").when(score > HIGH, "strong").otherwise("middle")


def health(spark, d) -> DataFrame:
    """date, score (the mean of at least four measures against their own past, 0 to 100) and zone."""
    rounded = breadth(spark, d).select("date", *(F.round(c, 9).alias(c) for c in MEASURES))
    long = rounded.unpivot(["date"], list(MEASURES), "measure", "v")
    ranked = expanding_rank(long, ["measure"], "v", HISTORY)
    day = ranked.groupBy("date").agg(F.when(F.count("rank") >= LEAST_MEASURES, F.avg("rank") * 100).alias("score"))
    return day.withColumn("zone", zone(F.round("score", 6)))


def a41_breadth_measures(spark, d):
    return breadth(spark, d).select("date", *(R6(F.col(c)).alias(c) for c in MEASURES if c != "sectors"))


def a42_sector_uptrend(spark, d):
    return breadth(spark, d).select("date", R6(F.col("sectors")).alias("sectors"))


def w47_health_score(spark, d):
    return health(spark, d).select("date", R6(F.col("score")).alias("score"), "zone")


def f17_zone_label(spark, d):
    return health(spark, d).groupBy("zone").agg(F.count("*").alias("weeks"), R6(F.avg("score")).alias("score"))


def zoned_weeks(spark, d) -> DataFrame:
    """date, zone, next_week (the index) and fall_4w: the lowest level of the next four weeks over today's."""
    x = health(spark, d).join(p.benchmark(p.bars(spark, d)), "date").withColumn("series", F.lit("all"))
    w = Window.partitionBy("series").orderBy("date")
    fall = F.when(F.count("level").over(w.rowsBetween(1, 4)) == 4, F.min("level").over(w.rowsBetween(1, 4)) / F.col("level") - 1)
    return x.select("series", "date", "zone", (F.lead("level").over(w) / F.col("level") - 1).alias("next_week"), fall.alias("fall_4w"))


def a43_zone_table(spark, d):
    bad = F.avg((F.col("next_week") < -0.02).cast("double"))
    x = zoned_weeks(spark, d).where("next_week is not null and zone != 'unknown'")
    return x.groupBy("zone").agg(F.count("*").alias("weeks"), R6(F.avg("next_week")).alias("next_week"), R6(bad).alias("bad_weeks"), R6(F.avg("fall_4w")).alias("fall_4w"))


def weak_differences(x: DataFrame, key: str) -> DataFrame:
    """By `key` and outcome the mean in weak weeks less that in others, and its Newey-West t; null with less than eight weeks on a side."""
    long = x.where("zone != 'unknown'").unpivot([key, "date", "zone"], ["next_week", "fall_4w"], "outcome", "y").where("y is not null")
    long = long.withColumns({"weak": (F.col("zone") == "weak").cast("double"), "group": F.concat_ws("/", key, "outcome")})
    long = long.withColumn("i", F.row_number().over(Window.partitionBy("group").orderBy("date")))
    # the slope on the flag is the alpha on its complement, with the sign turned: y = a + b (weak - 1) + b
    sides = long.groupBy("group", key, "outcome").agg(F.count_if(F.col("weak") == 1).alias("w"), F.count_if(F.col("weak") == 0).alias("r"))
    means = long.groupBy("group").agg((F.avg(F.when(F.col("weak") == 1, F.col("y"))) - F.avg(F.when(F.col("weak") == 0, F.col("y")))).alias("diff"))
    n = long.groupBy("group").agg(F.count("*").alias("n"), F.avg("weak").alias("mw"), F.regr_intercept("y", "weak").alias("a"), F.regr_slope("y", "weak").alias("b"), F.regr_sxx("y", "weak").alias("sxx"))
    e = long.join(n, "group").withColumn("g", (F.col("y") - F.col("a") - F.col("b") * F.col("weak")) * (F.col("weak") - F.col("mw")) / F.col("sxx"))
    lags = F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))).cast("int"))
    by = Window.partitionBy("group").orderBy("i")
    sums = sum((F.when(lags >= k, F.coalesce(F.lag("g", k).over(by), F.lit(0.0)) * F.col("g") * 2 * (1 - k / (lags + 1))).otherwise(0.0) for k in range(1, 13)), F.col("g") * F.col("g"))
    var = e.withColumn("v", sums).groupBy("group").agg((F.sum("v") * F.max("n") / (F.max("n") - 2)).alias("var"))
    enough = (F.col("w") >= 8) & (F.col("r") >= 8)
    return sides.join(means, "group").join(var, "group").select(key, "outcome", F.col("w").alias("weak_weeks"), F.col("r").alias("other_weeks"), F.when(enough, F.col("diff")).alias("diff"), F.when(enough, F.col("diff") / F.sqrt("var")).alias("t"))


def periods(spark, d) -> DataFrame:
    return zoned_weeks(spark, d).withColumn("period", F.when(F.col("date") < "1998-07-01", "early").otherwise("late"))


def a43_weak_against_rest(spark, d):
    x = weak_differences(periods(spark, d), "period")
    return x.select("period", "outcome", "weak_weeks", "other_weeks", R6(F.col("diff")).alias("diff"), R6(F.col("t")).alias("t"))


def a45_warning_verdict(spark, d):
    """Whether weak scores came before worse weeks or deeper falls in both periods."""
    x = weak_differences(periods(spark, d), "period")
    of = lambda period, outcome, c: F.max(F.when((F.col("period") == period) & (F.col("outcome") == outcome), F.col(c)))
    one = x.agg(*(of(q, o, c).alias(f"{o[0]}{c[0]}_{q}") for q in ("early", "late") for o in ("next_week", "fall_4w") for c in ("diff", "t")))
    worse = (F.col("nd_early") < 0) & (F.col("nd_late") < 0)
    deeper = F.coalesce((F.col("fd_early") < 0) & (F.col("fd_late") < 0), F.lit(False))
    nt, ft = F.greatest("nt_early", "nt_late"), F.greatest("ft_early", "ft_late")
    word = F.when(F.col("nt_early").isNull() | F.col("nt_late").isNull(), "NOT ENOUGH WEAK WEEKS").when((worse & (nt <= -2)) | (deeper & (ft <= -2)), "USEFUL WARNING").when((worse & (nt < -1)) | (deeper & (ft < -1)), "WEAK HINT").otherwise("NO WARNING VALUE")
    return one.select(word.alias("verdict"), worse.alias("worse_weeks"), deeper.alias("deeper_falls"))


def held_share(spark, d) -> DataFrame:
    """The weeks of each variant with the newest score of at most six days before, hold (half where it is weak) and the switch."""
    weeks = bk.known_weeks(spark, d)
    scores = health(spark, d).where("score is not null").select(F.col("date").alias("as_of"), "zone")
    # a score stands for its date and the six days after it, so each day has at most one
    day = scores.select(F.explode(F.sequence(F.col("as_of"), F.date_add("as_of", 6))).alias("date"), "as_of", "zone").groupBy("date").agg(F.max_by("zone", "as_of").alias("zone"))
    x = weeks.join(day, "date").withColumn("hold", F.when(F.col("zone") == "weak", 0.5).otherwise(1.0))
    return x.withColumn("switched", F.abs(F.col("hold") - F.lag("hold", 1, 1.0).over(Window.partitionBy("variant").orderBy("date"))))


def w57_position_switches(spark, d):
    return held_share(spark, d).select("variant", "date", "zone", "hold", "switched")


def a44_half_cash_rule(spark, d):
    """The book always held, and half in cash in weak weeks, switches paid: yearly return, worst fall and Sharpe ratio with the population deviation."""
    x = held_share(spark, d).withColumn("rule", F.col("hold") * F.col("net") - F.col("switched") * SWITCH_COST)
    long = x.unpivot(["variant", "date", "zone", "switched"], [F.col("net").alias("always"), F.col("rule").alias("half_cash")], "how", "r").withColumn("key", F.concat_ws("/", "variant", "how"))
    n = F.count("*")
    made = b.with_drawdown(long, "r", "key").groupBy("variant", "how").agg(
        n.alias("weeks"), F.count_if(F.col("zone") == "weak").alias("weak_weeks"), R6(b.yearly(F.sum(F.log1p("r")), n)).alias("ann_return"), R6(F.min("drawdown")).alias("worst_fall"), R6(F.avg("r") / F.stddev_pop("r") * b.YEAR**0.5).alias("sharpe"), (F.sum("switched") * 2).cast("long").alias("switches")
    )
    return made.where("weeks >= 26")


def w58_regime_change(spark, d):
    """Weeks whose zone differs from that five known weeks before."""
    x = health(spark, d).where("score is not null").withColumn("series", F.lit("all"))
    before = F.lag("zone", 5).over(Window.partitionBy("series").orderBy("date"))
    return x.withColumn("before", before).select("date", "zone", "before", (F.col("zone") != F.col("before")).alias("changed"))


def w56_week_percentile(spark, d):
    """A score's rank of the week, centred."""
    x = bk.ahead(spark, d).where("r is not null")
    return x.select("date", "code", R6(f.cs_rank(F.col("r")) - 0.5).alias("v"))


CALLS = (
    a41_breadth_measures, a42_sector_uptrend, w47_health_score, f17_zone_label, a43_zone_table, a43_weak_against_rest, a45_warning_verdict, w57_position_switches, a44_half_cash_rule, w58_regime_change, w56_week_percentile,
)
QUERIES = {c.__name__: c for c in CALLS}


def _some(fn: str, n: int, least: int) -> str:
    fr = f"OVER (PARTITION BY code ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {fr} >= {least} THEN {fn}(close) {fr} END"


TEN = "OVER (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
FORTY = "OVER (ORDER BY date ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)"
HEALTH = f"""sec AS (SELECT s_suppkey AS code, r_name AS sector FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
bx AS (SELECT date, code, close, {_some('avg', 40, 20)} AS slow, {_some('avg', 10, 5)} AS fast, {_some('max', 52, 26)} AS high, {_some('min', 52, 26)} AS low, lag(close) {LAGS} AS c1 FROM dense),
bd AS (SELECT date, count(CASE WHEN close > slow THEN 1 END) / count(*) AS above_slow, count(CASE WHEN close > fast THEN 1 END) / count(*) AS above_fast, (count(CASE WHEN close > c1 THEN 1 END) - count(CASE WHEN close < c1 THEN 1 END)) / count(*) AS net_up, (count(CASE WHEN close >= high THEN 1 END) - count(CASE WHEN close <= low THEN 1 END)) / count(*) AS net_high FROM bx WHERE close IS NOT NULL GROUP BY 1),
su AS (SELECT date, CASE WHEN count(*) >= 4 THEN avg(CASE WHEN up > 0.5 THEN 1.0 ELSE 0.0 END) END AS sectors FROM (SELECT date, sector, avg(CASE WHEN close > fast THEN 1.0 ELSE 0.0 END) AS up FROM bx JOIN sec USING (code) WHERE close IS NOT NULL AND fast IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
lv AS (SELECT date, round(sum(value), 2) / sum(volume) AS level FROM bars GROUP BY 1),
br AS (SELECT date, level, above_fast, sectors, CASE WHEN row_number() OVER (ORDER BY date) > 26 THEN above_slow END AS above_slow, CASE WHEN count(net_up) {TEN} = 10 THEN avg(net_up) {TEN} END AS adv_dec,
 CASE WHEN row_number() OVER (ORDER BY date) > 26 AND count(net_high) {TEN} = 10 THEN avg(net_high) {TEN} END AS highs_lows, CASE WHEN row_number() OVER (ORDER BY date) > 26 AND count(level) {FORTY} >= 30 THEN level / avg(level) {FORTY} - 1 END AS index_trend FROM bd LEFT JOIN su USING (date) JOIN lv USING (date)),
ml AS (SELECT date, unnest(['above_slow', 'above_fast', 'adv_dec', 'highs_lows', 'sectors', 'index_trend']) AS measure, round(unnest([above_slow, above_fast, adv_dec, highs_lows, sectors, index_trend]), 9) AS v FROM br),
rk AS (SELECT a.measure, a.date, CASE WHEN count(*) >= 52 THEN (count(CASE WHEN b.v < a.v THEN 1 END) + (count(CASE WHEN b.v = a.v THEN 1 END) + 1) / 2.0) / count(*) END AS rank FROM ml a JOIN ml b ON b.measure = a.measure AND b.date <= a.date AND b.v IS NOT NULL WHERE a.v IS NOT NULL GROUP BY 1, 2),
hs AS (SELECT br.date, CASE WHEN count(rank) >= 4 THEN avg(rank) * 100 END AS score FROM br LEFT JOIN rk ON rk.date = br.date GROUP BY 1),
he AS (SELECT date, score, CASE WHEN score IS NULL THEN 'unknown' WHEN round(score, 6) < 30 THEN 'weak' WHEN round(score, 6) > 60 THEN 'strong' ELSE 'middle' END AS zone FROM hs)"""
H = f"{WITH}, {HEALTH}"
ZW = f"{H}, zw AS (SELECT he.date, zone, lead(level) OVER (ORDER BY he.date) / level - 1 AS next_week, CASE WHEN count(level) OVER n4 = 4 THEN min(level) OVER n4 / level - 1 END AS fall_4w FROM he JOIN lv USING (date) WINDOW n4 AS (ORDER BY he.date ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))"
WEAK = f"""{ZW}, ol AS (SELECT CASE WHEN date < DATE '1998-07-01' THEN 'early' ELSE 'late' END AS period, date, CASE WHEN zone = 'weak' THEN 1.0::DOUBLE ELSE 0.0 END AS weak, unnest(['next_week', 'fall_4w']) AS outcome, unnest([next_week, fall_4w]) AS y FROM zw WHERE zone != 'unknown'),
oi AS (SELECT *, row_number() OVER (PARTITION BY period, outcome ORDER BY date) AS i FROM ol WHERE y IS NOT NULL),
om AS (SELECT period, outcome, count(*) AS n, avg(weak) AS mw, regr_intercept(y, weak) AS a, regr_slope(y, weak) AS bb, regr_sxx(y, weak) AS sxx, count(CASE WHEN weak = 1 THEN 1 END) AS w, count(CASE WHEN weak = 0 THEN 1 END) AS r, avg(CASE WHEN weak = 1 THEN y END) - avg(CASE WHEN weak = 0 THEN y END) AS diff, CAST(greatest(1, floor(4 * pow(count(*) / 100, 2.0 / 9))) AS INTEGER) AS lags FROM oi GROUP BY 1, 2),
og AS (SELECT period, outcome, i, (y - a - bb * weak) * (weak - mw) / sxx AS g FROM oi JOIN om USING (period, outcome)),
ov AS (SELECT p.period, p.outcome, sum(p.g * q.g * CASE WHEN p.i = q.i THEN 1.0 ELSE 2 * (1 - (p.i - q.i) / (lags + 1)) END) AS v FROM og p JOIN om USING (period, outcome) JOIN og q ON q.period = p.period AND q.outcome = p.outcome AND q.i BETWEEN p.i - lags AND p.i GROUP BY 1, 2),
wd AS (SELECT period, outcome, w AS weak_weeks, r AS other_weeks, CASE WHEN w >= 8 AND r >= 8 THEN diff END AS diff, CASE WHEN w >= 8 AND r >= 8 THEN diff / sqrt(v * n / (n - 2)) END AS t FROM om JOIN ov USING (period, outcome))"""
HELD = f"""{WEEKS}, {HEALTH}, dz AS (SELECT CAST(date + CAST(k AS INTEGER) AS DATE) AS date, arg_max(zone, date) AS zone FROM (SELECT date, zone, unnest(range(0, 7)) AS k FROM he WHERE score IS NOT NULL) GROUP BY 1),
ho AS (SELECT variant, kw.date, zone, net, CASE WHEN zone = 'weak' THEN 0.5::DOUBLE ELSE 1.0 END AS hold FROM kw JOIN dz ON dz.date = kw.date),
sw AS (SELECT *, abs(hold - lag(hold, 1, 1.0) OVER (PARTITION BY variant ORDER BY date)) AS switched FROM ho)"""
SQL = {
    "a41_breadth_measures": f"{H} SELECT date, " + ", ".join(f"{r6(c)} AS {c}" for c in MEASURES if c != "sectors") + " FROM br",
    "a42_sector_uptrend": f"{H} SELECT date, {r6('sectors')} AS sectors FROM br",
    "w47_health_score": f"{H} SELECT date, {r6('score')} AS score, zone FROM he",
    "f17_zone_label": f"{H} SELECT zone, count(*) AS weeks, {r6('avg(score)')} AS score FROM he GROUP BY 1",
    "a43_zone_table": f"{ZW} SELECT zone, count(*) AS weeks, {r6('avg(next_week)')} AS next_week, {r6('avg(CASE WHEN next_week < -0.02 THEN 1.0 ELSE 0.0 END)')} AS bad_weeks, {r6('avg(fall_4w)')} AS fall_4w FROM zw WHERE next_week IS NOT NULL AND zone != 'unknown' GROUP BY 1",
    "a43_weak_against_rest": f"{WEAK} SELECT period, outcome, weak_weeks, other_weeks, {r6('diff')} AS diff, {r6('t')} AS t FROM wd",
    "a45_warning_verdict": f"""{WEAK}, o AS (SELECT """ + ", ".join(f"max(CASE WHEN period = '{q}' AND outcome = '{o}' THEN {c} END) AS {o[0]}{c[0]}_{q}" for q in ("early", "late") for o in ("next_week", "fall_4w") for c in ("diff", "t")) + """ FROM wd),
 e AS (SELECT *, nd_early < 0 AND nd_late < 0 AS worse, coalesce(fd_early < 0 AND fd_late < 0, false) AS deeper, greatest(nt_early, nt_late) AS nt, greatest(ft_early, ft_late) AS ft FROM o)
 SELECT CASE WHEN nt_early IS NULL OR nt_late IS NULL THEN 'NOT ENOUGH WEAK WEEKS' WHEN worse AND nt <= -2 OR deeper AND ft <= -2 THEN 'USEFUL WARNING' WHEN worse AND nt < -1 OR deeper AND ft < -1 THEN 'WEAK HINT' ELSE 'NO WARNING VALUE' END AS verdict, worse AS worse_weeks, deeper AS deeper_falls FROM e""",
    "w57_position_switches": f"{HELD} SELECT variant, date, zone, hold, switched FROM sw",
    "a44_half_cash_rule": f"""{HELD}, rl AS (SELECT variant, date, zone, switched, unnest(['always', 'half_cash']) AS how, unnest([net, hold * net - switched * 0.002::DOUBLE]) AS r FROM sw)
 SELECT variant, how, count(*) AS weeks, count(CASE WHEN zone = 'weak' THEN 1 END) AS weak_weeks, {r6(bk.year_sql('r'))} AS ann_return, {r6('min(drawdown)')} AS worst_fall, {r6('avg(r) / stddev_pop(r) * sqrt(52)')} AS sharpe, CAST(sum(switched) * 2 AS BIGINT) AS switches FROM {bk.falls('rl', 'r', 'variant, how')} GROUP BY 1, 2 HAVING count(*) >= 26""",
    "w58_regime_change": f"{H} SELECT date, zone, before, zone != before AS changed FROM (SELECT date, zone, lag(zone, 5) OVER (ORDER BY date) AS before FROM he WHERE score IS NOT NULL)",
    "w56_week_percentile": f"{WITH}, {AHEAD} SELECT date, code, {r6('(rank() OVER (PARTITION BY date ORDER BY r) + (count(*) OVER (PARTITION BY date, r) - 1) / 2.0) / count(*) OVER (PARTITION BY date) - 0.5')} AS v FROM ahead WHERE r IS NOT NULL",
}
