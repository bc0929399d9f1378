"""Queries that judge factors: weekly judge, novelty, verdicts, transfer, regimes, robust regression and bootstrap, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import factors as f
from crosspanel.operators import wide
from crosspanel.operators.expanding import average_rank, expanding_counts
from crosspanel.plans.factor_queries import LAGS, WITH
from crosspanel.plans.panel_queries import BOOK_RET, BUY, R4, SELL, _book_returns, r4
from crosspanel.plans.table_queries import LEVEL, RET, returns
from crosspanel.sources import panel as p

#: Thresholds of the verdicts and of the transfer.
T_SIGNAL, COPY, STABLE, STAR_T, STAR_NET, STAR_HIT, T_STRONG = 2.0, 0.7, 0.6, 3.0, 0.03, 0.55, 3.0
LEAST_WEEKS, LEAST_NAMES, TOP, WEEKS = 52, 5, 0.8, 52
REPLAYS, BLOCK, BLOCKS = 500, 4, 13
FACTORS = ["level", "size", "move", "range"]


def corr(a: str, b: str):
    """Correlation, null where one side does not vary."""
    return F.when((F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b)))


def ranked(spark, d) -> DataFrame:
    """date, code, factor, fwd, rx and rw (ranks of factor and forward return among the names that have both) and n (such names)."""
    c, ahead = F.col("close"), lambda k: F.lead("open", k).over(f.by_code())
    x = p.dense_bars(spark, d).select("date", "code", c.alias("level"), F.col("volume").cast("double").alias("size"), (c / f.ref(c, 3)).alias("move"), (F.col("high") / F.col("low")).alias("range"), (ahead(6) / ahead(1) - 1).alias("fwd"))
    return wide.paired_ranks(x, FACTORS, "fwd", LEAST_NAMES)


def with_factors(bars: DataFrame) -> DataFrame:
    """Bars with t of their week and the columns that `ranked` ranks: what other weeks had is looked up by their number, as weeks without a bar have no row."""
    c, week = F.col("close"), Window.partitionBy("code").orderBy("t")
    at = lambda name, k: F.first(name).over(week.rangeBetween(k, k))
    return bars.withColumns({"level": c, "size": F.col("volume").cast("double"), "move": c / at("close", -3), "range": F.col("high") / F.col("low"), "fwd": at("open", 6) / at("open", 1) - 1})


def judged(x: DataFrame) -> DataFrame:
    """One row for each factor: coefficients, excess of its top names before and after costs, hit rate and turnover."""
    top = x.where(F.col("rx") / F.col("n") > TOP).select("factor", "date", "code")
    before = top.select("factor", F.date_add("date", 7).alias("date"), "code", F.lit(1).alias("was"))
    change = top.join(before, ["factor", "date", "code"], "left").groupBy("factor", "date").agg((1 - F.count("was") / F.count("*")).alias("turnover"))
    weeks = x.groupBy("factor", "date").agg(corr("rx", "rw").alias("ic"), (F.avg(F.when(F.col("rx") / F.col("n") > TOP, F.col("fwd"))) - F.avg("fwd")).alias("gross"))
    weeks = weeks.join(change, ["factor", "date"], "left").withColumn("turnover", F.coalesce("turnover", F.lit(1.0)))
    weeks = weeks.withColumn("net", F.col("gross") - F.col("turnover") * (BUY + SELL))
    years = weeks.groupBy("factor", F.year("date").alias("year")).agg(F.sum("ic").alias("ic")).groupBy("factor").agg(F.avg((F.col("ic") >= 0).cast("double")).alias("plus"))
    m, s, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    total = weeks.groupBy("factor").agg(n.alias("weeks"), m.alias("ic"), F.when((n >= LEAST_WEEKS) & (s > 0), m / s * F.sqrt(n)).alias("t"), (F.avg("gross") * WEEKS).alias("gross"), (F.avg("net") * WEEKS).alias("net"), F.avg(F.when(F.col("net").isNotNull(), (F.col("net") > 0).cast("double"))).alias("hit_rate"), ((F.sum("turnover") - F.min_by("turnover", "date")) / (F.count("*") - 1)).alias("turnover"))
    return total.join(years, "factor").withColumn("stable", F.when(F.col("ic") >= 0, F.col("plus")).otherwise(1 - F.col("plus"))).drop("plus")


def closest(x: DataFrame, judge: DataFrame) -> DataFrame:
    """For each factor the stronger one (by |t|) whose ranks are most like its own, by the mean correlation over dates."""
    t = judge.select(F.col("factor").alias("one"), F.abs("t").alias("t"))
    names = sorted(r.factor for r in judge.select("factor").collect())  # a row for each factor
    days = wide.factor_correlations(x, names).where(F.col("n") >= LEAST_NAMES)
    each = days.groupBy("one", "other").agg(F.abs(F.avg("c")).alias("c"))
    stronger = t.select(F.col("one").alias("other"), F.col("t").alias("u"))
    each = each.join(t, "one").join(stronger, "other").where("u > t").select(F.col("one").alias("factor"), "other", "c")
    return each.groupBy("factor").agg(F.max("c").alias("max_corr"), F.max_by("other", F.struct("c", "other")).alias("closest"))


def a20_weekly_judge(spark, d):
    x = judged(ranked(spark, d))
    return x.select("factor", "weeks", *(R4(F.col(c)).alias(c) for c in ("ic", "t", "gross", "net", "hit_rate", "turnover", "stable")))


def j12_stronger_factor(spark, d):
    x = ranked(spark, d)
    return closest(x, judged(x)).select("factor", "closest", R4(F.col("max_corr")).alias("max_corr"))


def a21_verdict(spark, d):
    x = ranked(spark, d)
    judge = judged(x)
    star = (F.col("t") >= STAR_T) & (F.col("net") >= STAR_NET) & (F.col("hit_rate") >= STAR_HIT)
    verdict = F.when(F.col("t").isNull(), "broken").when(F.col("max_corr") >= COPY, "copy").when(F.col("t") <= -T_SIGNAL, "backwards").when(F.abs("t") < T_SIGNAL, "weak").when(F.col("stable") < STABLE, "unstable").when(F.col("net") <= 0, "costly").when(star, "star").otherwise("keep")
    return judge.join(closest(x, judge), "factor", "left").select("factor", verdict.alias("verdict"), "closest")


def a25_transfer(spark, d):
    """Coefficients of the same factors in two markets, here odd and even codes, each ranked on its own."""
    x = ranked(spark, d).withColumn("market", F.col("code") % 2)
    day = ("market", "date", "factor")
    ic = wide.ranks_within(x.select(*day, "rx", "rw"), day, ("rx", "rw")).groupBy(*day).agg(F.count("*").alias("k"), corr("rx", "rw").alias("ic")).where(F.col("k") >= LEAST_NAMES)
    m, s, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    each = ic.groupBy("factor", "market").agg(m.alias("ic"), (m / s * F.sqrt(n)).alias("t"))
    of = lambda c, k: F.max(F.when(F.col("market") == k, F.col(c)))
    both = each.groupBy("factor").agg(*(of(c, k).alias(f"{c}{k}") for c in ("ic", "t") for k in (0, 1)))
    same = F.signum("ic0") == F.signum("ic1")
    one = lambda e: F.sum(F.when(e, 1).otherwise(0))
    return both.agg(F.count("*").alias("factors"), R4(corr("ic0", "ic1")).alias("ic_corr"), one(same).alias("same_sign"), one(F.abs("t0") >= T_STRONG).alias("strong"), one((F.abs("t0") >= T_STRONG) & (F.abs("t1") >= T_STRONG) & same).alias("strong_both"))


def w45_regimes(spark, d):
    """State of the benchmark from the past alone: 4-week return, 8-week volatility, its rank so far, and a 40-week mean."""
    by = Window.partitionBy("series").orderBy("date")
    x = returns(spark, d).withColumns({"ret4": F.col("level") / F.lag("level", 4).over(by) - 1, "vol": F.when(F.count("r").over(by.rowsBetween(-7, 0)) == 8, F.round(F.stddev_samp("r").over(by.rowsBetween(-7, 0)) * 52**0.5, 9)), "ma": F.when(F.count("level").over(by.rowsBetween(-39, 0)) >= 30, F.avg("level").over(by.rowsBetween(-39, 0)))})
    x = expanding_counts(x, ["series"], "date", "vol").withColumn("vol_rank", F.when(F.col("n") >= 26, average_rank()))
    label = F.when(F.col("vol_rank") > 0.8, "turbulent").when(F.col("level") > F.col("ma"), "calm, rising").otherwise("calm, falling")
    return x.select("date", R4(F.col("ret4")).alias("ret4"), R4(F.col("vol")).alias("vol"), R4(F.col("vol_rank")).alias("vol_rank"), F.when(F.col("vol_rank").isNotNull() & F.col("ma").isNotNull(), label).alias("regime"))


def _book_and_market(spark, d) -> DataFrame:
    """series, i (the week's number from 1), y (net return of the book) and x (that of the benchmark)."""
    both = _book_returns(spark, d).join(returns(spark, d).select("date", "series", F.col("r").alias("x")), "date")
    return both.select("series", "date", F.col("net").alias("y"), "x", F.row_number().over(Window.partitionBy("series").orderBy("date")).alias("i"))


def a36_robust_regression(spark, d):
    """y on 1 and x with Newey-West errors (Bartlett weights). One row of moments goes to the driver, for the number of lags."""
    data = _book_and_market(spark, d)
    m = data.agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_sxx("y", "x").alias("sxx"), F.regr_r2("y", "x").alias("r2")).first()
    schema = "n long, lags int, a double, b double, t_a double, t_b double, r2 double"
    if m.n < 3 or not m.sxx:
        return spark.createDataFrame([], schema)
    lags = max(1, math.floor(4 * (m.n / 100) ** (2 / 9)))
    by = Window.partitionBy("series").orderBy("date")
    # weights of the errors in both coefficients
    e = data.withColumn("e", F.col("y") - m.a - m.b * F.col("x"))
    e = e.select("series", "date", (F.col("e") * (1 / m.n - m.mx * (F.col("x") - m.mx) / m.sxx)).alias("ga"), (F.col("e") * (F.col("x") - m.mx) / m.sxx).alias("gb"))
    v = lambda c: F.sum(F.col(c) * F.col(c) + sum((F.coalesce(F.col(f"{c}{k}"), F.lit(0.0)) * F.col(c) * (2 * (1 - k / (lags + 1))) for k in range(1, lags + 1)), F.lit(0.0)))
    e = e.select("ga", "gb", *(F.lag(c, k).over(by).alias(f"{c}{k}") for c in ("ga", "gb") for k in range(1, lags + 1)))
    scale = m.n / (m.n - 2)
    t = lambda value, c: R4(F.lit(value) / F.sqrt(v(c) * scale))
    r = lambda value: R4(F.lit(value))
    return e.agg(F.lit(m.n).cast("long").alias("n"), F.lit(lags).alias("lags"), r(m.a).alias("a"), r(m.b).alias("b"), t(m.a, "ga").alias("t_a"), t(m.b, "gb").alias("t_b"), r(m.r2).alias("r2"))


def a38_alpha_by_year(spark, d):
    x = _book_and_market(spark, d).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("weeks"), (F.regr_intercept("y", "x") * WEEKS).alias("alpha"))
    return x.where("weeks >= 13").select("year", "weeks", R4(F.col("alpha")).alias("alpha"))


def drawn_start(replay: Column, block: Column, n: Column) -> Column:
    """A number from 0 to n - 1, uniform and independent from draw to draw: 52 bits of the SHA-256 of replay and block, which depends on nothing else and repeats in any engine."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", replay.cast("string"), block.cast("string")), 256), 1, 13), 16, 10).cast("long")
    return bits % n


def a39_block_bootstrap(spark, d):
    """Years made of blocks of four weeks whose starts are drawn at random, by the digest of replay and block: percentiles of their log return, and how often it is a gain."""
    data = _book_and_market(spark, d)
    n = data.count()
    if n < BLOCK:
        return spark.createDataFrame([], "replays long, p5 double, p50 double, p95 double, gain double")
    k, b = F.floor(F.col("id") / BLOCKS), F.col("id") % BLOCKS
    drawn = spark.range(REPLAYS * BLOCKS).select(k.alias("replay"), F.explode(F.sequence(F.lit(1), F.lit(BLOCK))).alias("j"), drawn_start(k, b, F.lit(n - BLOCK + 1)).alias("start"))
    # the draws are of fixed number
    years = data.join(F.broadcast(drawn.select("replay", (F.col("start") + F.col("j")).alias("i"))), "i").groupBy("replay").agg(F.sum(F.log1p("y")).alias("r"))
    return years.agg(F.count("*").alias("replays"), *(R4(F.percentile("r", q / 100)).alias(f"p{q}") for q in (5, 50, 95)), R4(F.avg((F.col("r") > 0).cast("double"))).alias("gain"))


CALLS = (a20_weekly_judge, j12_stronger_factor, a21_verdict, a25_transfer, w45_regimes, a36_robust_regression, a38_alpha_by_year, a39_block_bootstrap)
QUERIES = {c.__name__: c for c in CALLS}


def corr_sql(a: str, b: str) -> str:
    return f"CASE WHEN var_pop({a}) > 0 AND var_pop({b}) > 0 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"


def rank_sql(x: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"


COST = "0.0025::DOUBLE"
RANKED = f"""{WITH}, src AS (SELECT date, code, close AS level, CAST(volume AS DOUBLE) AS size, close / lag(close, 3) {LAGS} AS move, high / low AS range, lead(open, 6) {LAGS} / lead(open, 1) {LAGS} - 1 AS fwd FROM dense),
long AS (SELECT date, code, fwd, unnest(['level', 'size', 'move', 'range']) AS factor, unnest([level, size, move, "range"]) AS x FROM src),
ranked AS (SELECT date, code, factor, fwd, {rank_sql('x', 'date, factor')} AS rx, {rank_sql('fwd', 'date, factor')} AS rw, count(*) OVER (PARTITION BY date, factor) AS n FROM long WHERE x IS NOT NULL AND fwd IS NOT NULL QUALIFY n >= 5)"""
JUDGED = f"""{RANKED}, top AS (SELECT factor, date, code FROM ranked WHERE rx / n > 0.8),
change AS (SELECT a.factor, a.date, 1 - count(b.code) / count(*) AS turnover FROM top a LEFT JOIN top b ON a.factor = b.factor AND a.code = b.code AND b.date + 7 = a.date GROUP BY 1, 2),
weeks AS (SELECT *, gross - turnover * {COST} AS net FROM (SELECT factor, date, ic, gross, coalesce(turnover, 1.0) AS turnover FROM (SELECT factor, date, {corr_sql('rx', 'rw')} AS ic, avg(CASE WHEN rx / n > 0.8 THEN fwd END) - avg(fwd) AS gross FROM ranked GROUP BY 1, 2) LEFT JOIN change USING (factor, date))),
years AS (SELECT factor, avg(CASE WHEN s >= 0 THEN 1.0 ELSE 0.0 END) AS plus FROM (SELECT factor, year(date) AS y, sum(ic) AS s FROM weeks GROUP BY 1, 2) GROUP BY 1),
judged AS (SELECT factor, weeks, ic, t, gross, net, hit_rate, turnover, CASE WHEN ic >= 0 THEN plus ELSE 1 - plus END AS stable FROM (SELECT factor, count(ic) AS weeks, avg(ic) AS ic, CASE WHEN count(ic) >= 52 AND stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) * sqrt(count(ic)) END AS t, avg(gross) * 52 AS gross, avg(net) * 52 AS net, avg(CASE WHEN net > 0 THEN 1.0 WHEN net IS NOT NULL THEN 0.0 END) AS hit_rate, (sum(turnover) - arg_min(turnover, date)) / (count(*) - 1) AS turnover FROM weeks GROUP BY 1) JOIN years USING (factor))"""
CLOSEST = f"""{JUDGED}, days AS (SELECT a.factor, b.factor AS other, a.date, {corr_sql('a.rx', 'b.rx')} AS c FROM ranked a JOIN ranked b ON a.date = b.date AND a.code = b.code JOIN judged ja ON ja.factor = a.factor JOIN judged jb ON jb.factor = b.factor WHERE abs(jb.t) > abs(ja.t) GROUP BY 1, 2, 3 HAVING count(*) >= 5),
closest AS (SELECT factor, max(c) AS max_corr, arg_max(other, (c, other)) AS closest FROM (SELECT factor, other, abs(avg(c)) AS c FROM days GROUP BY 1, 2) GROUP BY 1)"""
MARKET = f"{BOOK_RET}, {LEVEL}, bm AS (SELECT date, net AS y, r AS x, row_number() OVER (ORDER BY date) AS i FROM net JOIN (SELECT date, r FROM ret WHERE r IS NOT NULL) USING (date))"
SQL = {
    "a20_weekly_judge": f"{JUDGED} SELECT factor, weeks, " + ", ".join(f"{r4(c)} AS {c}" for c in ("ic", "t", "gross", "net", "hit_rate", "turnover", "stable")) + " FROM judged",
    "j12_stronger_factor": f"{CLOSEST} SELECT factor, closest, {r4('max_corr')} AS max_corr FROM closest",
    "a21_verdict": f"{CLOSEST} SELECT factor, CASE WHEN t IS NULL THEN 'broken' WHEN max_corr >= 0.7 THEN 'copy' WHEN t <= -2 THEN 'backwards' WHEN abs(t) < 2 THEN 'weak' WHEN stable < 0.6 THEN 'unstable' WHEN net <= 0 THEN 'costly' WHEN t >= 3 AND net >= 0.03 AND hit_rate >= 0.55 THEN 'star' ELSE 'keep' END AS verdict, closest FROM judged LEFT JOIN closest USING (factor)",
    "a25_transfer": f"""{RANKED}, mk AS (SELECT code % 2 AS market, date, factor, {rank_sql('rx', 'code % 2, date, factor')} AS rx, {rank_sql('rw', 'code % 2, date, factor')} AS rw FROM ranked),
 ic AS (SELECT market, date, factor, {corr_sql('rx', 'rw')} AS ic FROM mk GROUP BY 1, 2, 3 HAVING count(*) >= 5), each AS (SELECT factor, market, avg(ic) AS ic, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS t FROM ic GROUP BY 1, 2),
 two AS (SELECT factor, max(CASE WHEN market = 0 THEN ic END) AS ic0, max(CASE WHEN market = 1 THEN ic END) AS ic1, max(CASE WHEN market = 0 THEN t END) AS t0, max(CASE WHEN market = 1 THEN t END) AS t1 FROM each GROUP BY 1)
 SELECT count(*) AS factors, {r4(corr_sql('ic0', 'ic1'))} AS ic_corr, CAST(sum(CASE WHEN sign(ic0) = sign(ic1) THEN 1 ELSE 0 END) AS BIGINT) AS same_sign, CAST(sum(CASE WHEN abs(t0) >= 3 THEN 1 ELSE 0 END) AS BIGINT) AS strong, CAST(sum(CASE WHEN abs(t0) >= 3 AND abs(t1) >= 3 AND sign(ic0) = sign(ic1) THEN 1 ELSE 0 END) AS BIGINT) AS strong_both FROM two""",
    "w45_regimes": f"""{RET}, s AS (SELECT date, level, level / lag(level, 4) OVER (ORDER BY date) - 1 AS ret4, CASE WHEN count(r) OVER v = 8 THEN round(stddev_samp(r) OVER v * sqrt(52), 9) END AS vol, CASE WHEN count(level) OVER m >= 30 THEN avg(level) OVER m END AS ma FROM (SELECT date, r, level FROM ret JOIN level USING (date) WHERE r IS NOT NULL) WINDOW v AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), m AS (ORDER BY date ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
 k AS (SELECT a.date, CASE WHEN count(*) >= 26 THEN (sum(CASE WHEN b.vol < a.vol THEN 1 ELSE 0 END) + (sum(CASE WHEN b.vol = a.vol THEN 1 ELSE 0 END) + 1) / 2.0) / count(*) END AS vol_rank FROM s a JOIN s b ON b.date <= a.date AND b.vol IS NOT NULL WHERE a.vol IS NOT NULL GROUP BY 1)
 SELECT date, {r4('ret4')} AS ret4, {r4('vol')} AS vol, {r4('vol_rank')} AS vol_rank, CASE WHEN vol_rank IS NOT NULL AND ma IS NOT NULL THEN CASE WHEN vol_rank > 0.8 THEN 'turbulent' WHEN level > ma THEN 'calm, rising' ELSE 'calm, falling' END END AS regime FROM s LEFT JOIN k USING (date)""",
    "a36_robust_regression": f"""{MARKET}, m AS (SELECT count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, regr_r2(y, x) AS r2, CAST(greatest(1, floor(4 * pow(count(*) / 100, 2.0 / 9))) AS INTEGER) AS lags FROM bm),
 g AS (SELECT i, (y - a - b * x) * (1 / n - mx * (x - mx) / sxx) AS ga, (y - a - b * x) * (x - mx) / sxx AS gb FROM bm, m),
 s AS (SELECT sum(p.ga * q.ga * wt) AS va, sum(p.gb * q.gb * wt) AS vb FROM (SELECT i, i - k AS h, CASE WHEN k = 0 THEN 1.0 ELSE 2 * (1 - k / (lags + 1)) END AS wt FROM g, m, range(0, 50) z(k) WHERE k <= lags) w JOIN g p ON p.i = w.i JOIN g q ON q.i = w.h)
 SELECT n, lags, {r4('a')} AS a, {r4('b')} AS b, {r4('a / sqrt(va * n / (n - 2))')} AS t_a, {r4('b / sqrt(vb * n / (n - 2))')} AS t_b, {r4('r2')} AS r2 FROM m, s""",
    "a38_alpha_by_year": f"{MARKET} SELECT year(date) AS year, count(*) AS weeks, {r4('regr_intercept(y, x) * 52')} AS alpha FROM bm GROUP BY 1 HAVING count(*) >= 13",
    "a39_block_bootstrap": f"""{MARKET}, dr AS (SELECT k, CAST('0x' || sha256(k || ':' || b)[:13] AS BIGINT) % ((SELECT count(*) FROM bm) - 3) AS st FROM range(0, 500) u(k), range(0, 13) z(b)),
 yr AS (SELECT k, sum(ln(1 + y)) AS r FROM dr, range(1, 5) j(j), bm WHERE bm.i = st + j GROUP BY 1) SELECT count(*) AS replays, {r4('quantile_cont(r, 0.05)')} AS p5, {r4('quantile_cont(r, 0.5)')} AS p50, {r4('quantile_cont(r, 0.95)')} AS p95, {r4('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)')} AS gain FROM yr""",
}
