"""Queries of books: weeks, summaries, choices, odds against luck, decomposition and replays, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions import factors as f
from crosspanel.operators import books as b
from crosspanel.operators import wide
from crosspanel.operators.expanding import percentiles
from crosspanel.plans.factor_queries import LAGS, WITH
from crosspanel.plans.panel_queries import BUY, SELL, SLOTS
from crosspanel.plans.research_queries import drawn_start
from crosspanel.sources import files
from crosspanel.sources import panel as p

SURE = 0.95
REPLAYS, BLOCK, BLOCKS = 10_000, 4, 13
LEAST_GROUP = 13


def R6(c):
    return F.round(c.cast("double") + 1e-9, 6) + 0.0


def r6(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE) + 1e-9, 6) + 0.0"


def books(spark, d) -> DataFrame:
    """variant, date and code: the ten codes of the most value, and those of them whose rank of the day is sure enough."""
    x = wide.day_places(p.bars(spark, d).select("date", "code", "value"), "value").where(F.col("position") <= SLOTS)
    return x.select(F.lit("top").alias("variant"), "date", "code").union(x.where(F.col("p") >= SURE).select(F.lit("sure"), "date", "code"))


def ahead(spark, d) -> DataFrame:
    """date, code and r: the return to the next week of the close smoothed over eight weeks; weeks without a bar have none."""
    smooth = F.when(F.col("close").isNotNull(), F.avg("close").over(f.by_code(8)))
    x = p.dense_bars(spark, d).withColumn("smooth", smooth)
    return x.select("date", "code", (F.lead("smooth").over(f.by_code()) / F.col("smooth") - 1).alias("r"))


def with_ahead(bars: DataFrame) -> DataFrame:
    """Bars with t of their week and r, as `ahead`; weeks without a bar have no row."""
    week = f.by_code()
    x = bars.withColumn("smooth", F.when(F.col("close").isNotNull(), F.avg("close").over(week.rangeBetween(-7, 0))))
    following = F.when(F.lead("t").over(week) == F.col("t") + 1, F.lead("smooth").over(week))
    return x.withColumn("r", following / F.col("smooth") - 1)


def market(spark, d) -> DataFrame:
    """date and bench, the return of the benchmark to the next date; one series under a key."""
    x = p.benchmark(p.bars(spark, d)).withColumn("series", F.lit("all"))
    return x.select("date", (F.lead("level").over(Window.partitionBy("series").orderBy("date")) / F.col("level") - 1).alias("bench"))


def weeks(spark, d) -> DataFrame:
    return b.book_weeks(books(spark, d), ahead(spark, d), market(spark, d), SLOTS, BUY, SELL)


def known_weeks(spark, d) -> DataFrame:
    """The weeks whose benchmark and universe are known, with i, their number from 1 in each variant."""
    x = weeks(spark, d).where("bench is not null and universe is not null")
    return x.withColumn("i", F.row_number().over(Window.partitionBy("variant").orderBy("date")))


def a60_book_weeks(spark, d):
    numbers = ("gross", "cost", "net", "bench", "universe", "turnover")
    return weeks(spark, d).select("variant", "date", "n_stocks", *(R6(F.col(c)).alias(c) for c in numbers))


def a26_book_statistics(spark, d):
    """Yearly figures of each variant; the first week plays no part in turnover and cost."""
    x = b.with_drawdown(known_weeks(spark, d).withColumn("excess", F.col("net") - F.col("bench")), "net")
    later = lambda c: F.avg(F.when(F.col("i") > 1, F.col(c)))
    n = F.count("*")
    made = {
        "ann_return": b.yearly(F.sum(F.log1p("net")), n), "bench_ann_return": b.yearly(F.sum(F.log1p("bench")), n), "excess_ann": F.avg("excess") * b.YEAR,
        "gross_excess_ann": F.avg(F.col("gross") - F.col("bench")) * b.YEAR, "info_ratio": F.when(F.stddev_samp("excess") > 0, F.avg("excess") / F.stddev_samp("excess") * b.YEAR**0.5),
        "hit_rate": F.avg((F.col("excess") > 0).cast("double")), "max_drawdown": F.min("drawdown"), "avg_turnover": later("turnover"), "cost_ann": later("cost") * b.YEAR, "avg_stocks": F.avg("n_stocks"),
    }
    return x.groupBy("variant").agg(n.alias("weeks"), *(R6(e).alias(k) for k, e in made.items()))


def a9_backtest_summary(spark, d):
    """One row for each variant and series (net, gross, bench, excess): yearly return, volatility, Sharpe ratio and worst fall; mean turnover and what costs take in a year."""
    x = known_weeks(spark, d).withColumn("excess", F.greatest(F.col("net") - F.col("bench"), F.lit(-0.99)))  # no more than all is lost
    long = x.unpivot(["variant", "date", "turnover", "cost"], ["net", "gross", "bench", "excess"], "series", "r").withColumn("key", F.concat_ws("/", "variant", "series"))
    n, s = F.count("*"), F.stddev_samp("r")
    made = {"cagr": b.yearly(F.sum(F.log1p("r")), n), "vol": s * b.YEAR**0.5, "sharpe": F.avg("r") / s * b.YEAR**0.5, "max_drawdown": F.min("drawdown"), "turnover": F.avg("turnover"), "cost_drag": F.avg("cost") * b.YEAR}
    return b.with_drawdown(long, "r", "key").groupBy("variant", "series").agg(n.alias("weeks"), *(R6(e).alias(k) for k, e in made.items()))


def a11_window_return(spark, d):
    """Compounded return of 1997 and 1998, as its logarithm, which stays exact where returns are wild."""
    x = known_weeks(spark, d).where("date between '1997-01-01' and '1998-12-31'")
    return x.groupBy("variant").agg(F.count("*").alias("weeks"), *(R6(F.log(F.product(1 + F.col(c)))).alias(f"log_{c}") for c in ("net", "bench")))


def a62_equal_weight(spark, d):
    """Net, universe and index in compound yearly terms, the excess over the universe, and how often the book is ahead."""
    n = F.count("*")
    x = known_weeks(spark, d).groupBy("variant").agg(*(b.yearly(F.sum(F.log1p(c)), n).alias(c) for c in ("net", "universe", "bench")), F.avg((F.col("net") > F.col("universe")).cast("double")).alias("ahead"))
    return x.select("variant", *(R6(F.col(c)).alias(c) for c in ("net", "universe", "bench")), R6(F.col("net") - F.col("universe")).alias("excess"), R6(F.col("ahead")).alias("ahead"))


def designs(spark, d) -> DataFrame:
    """Info ratio and turnover of each of six designs: the variants traded each, every second and every fourth week."""
    x = known_weeks(spark, d).select("variant", "i", (F.col("net") - F.col("bench")).alias("excess"), "turnover", F.explode(F.array(*map(F.lit, (1, 2, 4)))).alias("every"))
    x = x.where((F.col("i") - 1) % F.col("every") == 0)
    ratio = F.when(F.stddev_samp("excess") > 0, F.avg("excess") / F.stddev_samp("excess") * b.YEAR**0.5)
    return x.groupBy("variant", "every").agg(ratio.alias("info_ratio"), F.avg("turnover").alias("turnover"))


def a58_design_choice(spark, d):
    """The design of the best info ratio in each variant; equal ones by the lower turnover, then the shorter step."""
    best = F.row_number().over(Window.partitionBy("variant").orderBy(F.desc_nulls_last(F.round("info_ratio", 9)), F.round("turnover", 9), "every"))
    return designs(spark, d).withColumn("k", best).where("k = 1").select("variant", "every", R6(F.col("info_ratio")).alias("info_ratio"), R6(F.col("turnover")).alias("turnover"))


def trials(spark, d) -> DataFrame:
    return designs(spark, d).agg(F.count("info_ratio").alias("trials"), F.var_samp(F.col("info_ratio") / b.YEAR**0.5).alias("variance"))


def a34_trials(spark, d):
    return trials(spark, d).select("trials", R6(F.col("variance")).alias("variance"))


def excess_moments(spark, d) -> DataFrame:
    x = known_weeks(spark, d).withColumn("excess", F.col("net") - F.col("bench"))
    return x.groupBy("variant").agg(*(e.alias(k) for k, e in b.moments("excess").items()))


def a31_sample_moments(spark, d):
    """Moments of the excess, and the paired t of net over universe."""
    pair = known_weeks(spark, d).withColumn("apart", F.col("net") - F.col("universe")).groupBy("variant").agg(*(e.alias(k) for k, e in b.moments("apart").items() if k == "t")).withColumnRenamed("t", "paired_t")
    return excess_moments(spark, d).join(pair, "variant").select("variant", "n", *(R6(F.col(c)).alias(c) for c in ("mean", "sd", "skew", "kurt", "sharpe", "t", "paired_t")))


def judged_by_luck(spark, d) -> DataFrame:
    """Moments with psr, luck (the ratio that the best of all trials would show by chance) and dsr. One row of two numbers goes to the driver."""
    of = trials(spark, d).first()
    luck = b.expected_best(of.trials, of.variance or 0.0)
    x = excess_moments(spark, d).withColumn("luck", F.lit(luck))
    return x.withColumns({"psr": b.probabilistic_sharpe(0.0), "dsr": b.probabilistic_sharpe(F.col("luck"))})


def a32_sharpe_odds(spark, d):
    return judged_by_luck(spark, d).select("variant", *(R6(F.col(c)).alias(c) for c in ("sharpe", "luck", "psr", "dsr")))


def a33_exam_verdict(spark, d):
    word = F.when((F.col("mean") > 0) & (F.col("dsr") >= 0.95), "REAL EDGE").when((F.col("mean") > 0) & (F.col("psr") >= 0.95), "PROMISING").otherwise("NO PROVEN EDGE")
    return judged_by_luck(spark, d).select("variant", word.alias("verdict"), R6(F.col("t")).alias("excess_t"), F.col("n").alias("weeks"))


def a33_excess_by_year(spark, d):
    x = known_weeks(spark, d).withColumn("excess", F.col("net") - F.col("bench"))
    return x.groupBy("variant", F.year("date").alias("year")).agg(F.count("*").alias("weeks"), R6(F.avg("excess") * b.YEAR).alias("excess_ann"))


def hac_alphas(x: DataFrame, y: str, sides: dict[str, tuple[str, str | None]], key: str) -> DataFrame:
    """For each `key` and side the alpha of `y` on one or two columns, its Newey-West t (Bartlett weights) and r2.

    All moments come from one aggregation and go back to the rows by a join on the key; the lagged products need one
    window. Nothing is collected: the number of lags is a column, too, and the sum over lags runs to the largest of MOST.
    """
    parts = []
    for side, (one, two) in sides.items():
        u, v = F.col(one), (F.col(two) if two else F.lit(0.0))
        parts.append(x.select(key, "i", F.lit(side).alias("side"), F.col(y).alias("y"), u.alias("u"), v.alias("v"), F.lit(2 if two else 1).alias("k")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    m = rows.groupBy(key, "side").agg(
        F.count("*").alias("n"), F.first("k").alias("k_"), *(F.avg(c).alias(f"m{c}") for c in "yuv"), F.var_pop("u").alias("uu"), F.var_pop("v").alias("vv"), F.var_pop("y").alias("yy"),
        F.covar_pop("u", "v").alias("uv"), F.covar_pop("u", "y").alias("uy"), F.covar_pop("v", "y").alias("vy"),
    )
    det = F.when(F.col("k_") == 2, F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")).otherwise(F.col("uu"))
    two = F.col("k_") == 2
    solve = lambda a, c: (F.when(two, (F.col("vv") * a - F.col("uv") * c) / det).otherwise(a / F.col("uu")), F.when(two, (F.col("uu") * c - F.col("uv") * a) / det).otherwise(0.0))
    bu, bv = solve(F.col("uy"), F.col("vy"))
    cu, cv = solve(F.col("mu"), F.col("mv"))
    m = m.withColumns({"bu": bu, "bv": bv, "cu": cu, "cv": cv, "lags": F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))).cast("int"))})
    m = m.withColumns({"alpha": F.col("my") - F.col("bu") * F.col("mu") - F.col("bv") * F.col("mv"), "r2": (F.col("bu") * F.col("uy") + F.col("bv") * F.col("vy")) / F.col("yy")})
    e = rows.join(m, [key, "side"])
    rest = F.col("y") - F.col("alpha") - F.col("bu") * F.col("u") - F.col("bv") * F.col("v")
    weight = (1 - F.col("cu") * (F.col("u") - F.col("mu")) - F.col("cv") * (F.col("v") - F.col("mv"))) / F.col("n")
    e = e.withColumn("g", rest * weight)
    by = Window.partitionBy(key, "side").orderBy("i")
    most = 12  # lags of some 14,000 weeks
    lagged = F.col("g") * F.col("g") + sum((F.when(F.col("lags") >= k, F.coalesce(F.lag("g", k).over(by), F.lit(0.0)) * F.col("g") * 2 * (1 - k / (F.col("lags") + 1))).otherwise(0.0) for k in range(1, most + 1)), F.lit(0.0))
    var = e.withColumn("w", lagged).groupBy(key, "side").agg(F.sum("w").alias("var"))
    se = F.sqrt(F.col("var") * F.col("n") / (F.col("n") - F.col("k_") - 1))
    return m.join(var, [key, "side"]).select(key, "side", "n", "lags", "alpha", (F.col("alpha") / se).alias("t"), "r2", F.col("my").alias("mean"))


SIDES = {"index": ("bench", None), "equal": ("universe", None), "both": ("bench", "universe")}


def a37_decomposition(spark, d):
    """The net return against three baselines: what each explains in a year, what is left as alpha, and whether that is proven."""
    x = hac_alphas(known_weeks(spark, d), "net", SIDES, "variant")
    verdict = F.when(F.col("t") >= 2, "alpha").when(F.col("t") <= -2, "negative alpha").otherwise("no proven alpha")
    return x.select("variant", "side", F.col("n").alias("weeks"), "lags", R6(F.col("alpha") * b.YEAR).alias("alpha_ann"), R6((F.col("mean") - F.col("alpha")) * b.YEAR).alias("explained_ann"), R6(F.col("t")).alias("t"), R6(F.col("r2")).alias("r2"), verdict.alias("verdict"))


def a38_alpha_by_market(spark, d):
    """Alpha on the universe by calendar year, and where the universe rose or fell over the thirteen weeks before; groups of less than thirteen weeks go."""
    x = known_weeks(spark, d)
    w = Window.partitionBy("variant").orderBy("date").rowsBetween(-13, -1)
    trend = F.when(F.count("universe").over(w) == 13, F.when(F.product(1 + F.col("universe")).over(w) > 1, "rising").otherwise("falling"))
    x = x.withColumn("trend", trend).withColumn("label", F.explode(F.array(F.year("date").cast("string"), "trend"))).where("label is not null")
    made = x.groupBy("variant", "label").agg(F.count("*").alias("weeks"), R6(F.regr_intercept("net", "universe") * b.YEAR).alias("alpha"))
    return made.where(F.col("weeks") >= LEAST_GROUP)


def a39_replays(spark, d):
    """Years of thirteen blocks of four weeks, whose starts are drawn at random, by the digest of replay and block: percentiles of return and worst fall, and how often the index is beaten."""
    x = known_weeks(spark, d)
    n = x.groupBy("variant").agg(F.max("i").alias("n")).where(F.col("n") >= BLOCK)
    k, j = F.floor(F.col("id") / BLOCKS), F.col("id") % BLOCKS
    deal = spark.range(REPLAYS * BLOCKS).select(k.alias("replay"), j.alias("block"))  # of fixed number
    start = drawn_start(F.col("replay"), F.col("block"), F.col("n") - BLOCK + 1)
    drawn = n.join(F.broadcast(deal), how="cross").select("variant", "replay", "block", start.alias("start"))
    drawn = drawn.select("variant", "replay", "block", F.explode(F.sequence(F.lit(1), F.lit(BLOCK))).alias("j"), "start")
    drawn = drawn.select("variant", "replay", (F.col("block") * BLOCK + F.col("j")).alias("place"), (F.col("start") + F.col("j")).cast("int").alias("i"))
    path = drawn.join(x.select("variant", "i", "net", "bench"), ["variant", "i"])
    w = Window.partitionBy("variant", "replay").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumn("equity", F.exp(F.sum(F.log1p("net")).over(w)))
    path = path.withColumn("fall", F.col("equity") / F.max("equity").over(w) - 1)
    years = path.groupBy("variant", "replay").agg((F.exp(F.sum(F.log1p("net"))) - 1).alias("r"), (F.exp(F.sum(F.log1p("bench"))) - 1).alias("m"), F.min("fall").alias("fall"))
    marks = [R6(F.percentile(c, q / 100)).alias(f"{c}{q}") for c in ("r", "fall") for q in (5, 25, 50, 75, 95)]
    return years.groupBy("variant").agg(F.count("*").alias("replays"), *marks, R6(F.avg((F.col("r") > F.col("m")).cast("double"))).alias("beats"))


def a40_return_histogram(spark, d):
    """Thirty bins of equal width between the 0.5th and the 99.5th percentile of the weekly returns of all codes; values beyond are clipped."""
    path = files.new_path(spark, "returns")
    made = with_ahead(p.code_bars(spark, d, p.calendar(spark, d)[0])).where("r is not null").select("r")
    made.write.parquet(path)  # one number a bar, read three times
    x = spark.read.schema(made.schema).parquet(path)
    edges = percentiles(x, "r", (0.005, 0.995)).toDF("lo", "hi")
    x = x.join(F.broadcast(edges), how="cross").where("hi > lo")  # one row
    place = F.floor((F.greatest("lo", F.least("hi", "r")) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 30))
    return x.groupBy((F.least(place, F.lit(29)) + 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def a61_holdings_accounting(spark, d):
    """Each variant's mean return of what it holds, buys over the new and sales over the old size, cost, net and benchmark."""
    book = books(spark, d)
    before = book.select("variant", F.date_add("date", 7).alias("date"), "code", F.lit(1).alias("was"))
    x = book.withColumn("is", F.lit(1)).join(before, ["variant", "date", "code"], "full").join(ahead(spark, d), ["date", "code"], "left")
    new, old = F.count("is"), F.count("was")
    sums = x.groupBy("variant", "date").agg(new.alias("new"), (F.sum(F.when(F.col("is") == 1, F.coalesce("r", F.lit(0.0)))) / new).alias("gross"), (F.count_if(F.col("was").isNull()) / new).alias("buys"), F.when(old > 0, F.count_if(F.col("is").isNull()) / old).otherwise(0.0).alias("sells"))
    cost = F.col("buys") * BUY + F.col("sells") * SELL
    made = sums.where("new > 0").join(market(spark, d), "date", "left")
    return made.select("variant", "date", *(R6(e).alias(k) for k, e in {"gross": F.col("gross"), "buys": F.col("buys"), "sells": F.col("sells"), "cost": cost, "net": F.col("gross") - cost, "bench": F.col("bench")}.items()))


CALLS = (
    a60_book_weeks, a26_book_statistics, a9_backtest_summary, a11_window_return, a62_equal_weight, a58_design_choice, a34_trials, a31_sample_moments, a32_sharpe_odds,
    a33_exam_verdict, a33_excess_by_year, a37_decomposition, a38_alpha_by_market, a39_replays, a40_return_histogram, a61_holdings_accounting,
)
QUERIES = {c.__name__: c for c in CALLS}

AHEAD = f"smooth AS (SELECT *, CASE WHEN close IS NOT NULL THEN avg(close) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) END AS smooth FROM dense), ahead AS (SELECT date, code, lead(smooth) {LAGS} / smooth - 1 AS r FROM smooth)"
WEEKS = f"""{WITH}, {AHEAD}, px AS (SELECT date, code, (rank() OVER (PARTITION BY date ORDER BY value) + (count(*) OVER (PARTITION BY date, value) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS p, row_number() OVER (PARTITION BY date ORDER BY value DESC, code) AS k FROM bars),
book AS (SELECT 'top' AS variant, date, code FROM px WHERE k <= 10 UNION ALL SELECT 'sure', date, code FROM px WHERE k <= 10 AND p >= 0.95),
was AS (SELECT variant, CAST(date + 7 AS DATE) AS date, code FROM book),
held AS (SELECT coalesce(b.variant, w.variant) AS variant, coalesce(b.date, w.date) AS date, coalesce(b.code, w.code) AS code, b.code IS NOT NULL AS is_, w.code IS NOT NULL AS was FROM book b FULL JOIN was w ON b.variant = w.variant AND b.date = w.date AND b.code = w.code),
mk AS (SELECT date, lead(level) OVER (ORDER BY date) / level - 1 AS bench FROM (SELECT date, round(sum(value), 2) / sum(volume) AS level FROM bars GROUP BY 1)),
un AS (SELECT date, avg(r) AS universe FROM ahead GROUP BY 1),
sums AS (SELECT variant, h.date, count(CASE WHEN is_ THEN 1 END) AS n_stocks, sum(CASE WHEN is_ THEN coalesce(r, 0.0) ELSE 0.0 END) AS earned, count(CASE WHEN is_ AND NOT was THEN 1 END) AS buys, count(CASE WHEN was AND NOT is_ THEN 1 END) AS sells FROM held h LEFT JOIN ahead a ON a.date = h.date AND a.code = h.code GROUP BY 1, 2),
weeks AS (SELECT variant, s.date, n_stocks, earned / 10 + (1 - n_stocks / 10.0::DOUBLE) * coalesce(bench, 0.0) AS gross, (buys * 0.001::DOUBLE + sells * 0.0015::DOUBLE) / 10 AS cost, bench, universe, buys / 10.0::DOUBLE AS turnover FROM sums s LEFT JOIN mk ON mk.date = s.date LEFT JOIN un ON un.date = s.date WHERE n_stocks > 0),
kw AS (SELECT *, gross - cost AS net, gross - cost - bench AS excess, row_number() OVER (PARTITION BY variant ORDER BY date) AS i FROM weeks WHERE bench IS NOT NULL AND universe IS NOT NULL)"""
PATH = "(PARTITION BY {key} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def falls(source: str, r: str, key: str) -> str:
    w = PATH.format(key=key)
    return f"(SELECT *, equity / max(equity) OVER {w} - 1 AS drawdown FROM (SELECT *, exp(sum(ln(1 + {r})) OVER {w}) AS equity FROM {source}))"


def year_sql(r: str) -> str:
    return f"exp(sum(ln(1 + {r})) * 52 / count(*)) - 1"


EXCESS = f"({year_sql('net')}) - ({year_sql('universe')})"
DESIGNS = f"{WEEKS}, designs AS (SELECT variant, every, CASE WHEN stddev_samp(excess) > 0 THEN avg(excess) / stddev_samp(excess) * sqrt(52) END AS info_ratio, avg(turnover) AS turnover FROM kw, (SELECT unnest([1, 2, 4]) AS every) WHERE (i - 1) % every = 0 GROUP BY 1, 2)"


def moments_sql(x: str) -> str:
    m3, m4 = f"(avg({x} * {x} * {x}) - 3 * avg({x}) * avg({x} * {x}) + 2 * avg({x}) ** 3)", f"kurtosis_pop({x})"
    return f"count({x}) AS n, avg({x}) AS mean, stddev_samp({x}) AS sd, {m3} / var_pop({x}) ** 1.5 AS skew, {m4} + 3 AS kurt, avg({x}) / stddev_samp({x}) AS sharpe, avg({x}) / stddev_samp({x}) * sqrt(count({x})) AS t"


MOMENTS = f"{DESIGNS}, mo AS (SELECT variant, {moments_sql('excess')} FROM kw GROUP BY 1)"


def cdf_sql(z: str) -> str:
    t = f"(1 / (1 + {b.ERF_SCALE} * abs({z}) / sqrt(2)))"
    tail = "0.0::DOUBLE"
    for c in reversed(b.ERF):
        tail = f"({tail} + {c}) * {t}"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} * exp(-({z}) * ({z}) / 2) / 2 ELSE {tail} * exp(-({z}) * ({z}) / 2) / 2 END"


def psr_sql(best: str) -> str:
    return cdf_sql(f"((sharpe - {best}) * sqrt(n - 1.0) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe))")


#: The oracle knows the number of trials, six, and takes the quantiles from there.
LUCK = f"{MOMENTS}, lucky AS (SELECT *, (SELECT sqrt(var_samp(info_ratio / sqrt(52))) FROM designs) * {b.expected_best(6, 1.0)!r}::DOUBLE AS luck FROM mo), odds AS (SELECT *, {psr_sql('0')} AS psr, {psr_sql('luck')} AS dsr FROM lucky)"
HAC = f"""{WEEKS}, rows_ AS (SELECT variant, i, 'index' AS side, 1 AS k, net AS y, bench AS u, 0.0::DOUBLE AS v FROM kw UNION ALL SELECT variant, i, 'equal', 1, net, universe, 0.0 FROM kw UNION ALL SELECT variant, i, 'both', 2, net, bench, universe FROM kw),
mm AS (SELECT variant, side, max(k) AS k, count(*) AS n, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(u) AS uu, CASE WHEN max(k) = 2 THEN var_pop(v) ELSE 1.0 END AS vv, var_pop(y) AS yy, CASE WHEN max(k) = 2 THEN covar_pop(u, v) ELSE 0.0 END AS uv, covar_pop(u, y) AS uy, CASE WHEN max(k) = 2 THEN covar_pop(v, y) ELSE 0.0 END AS vy FROM rows_ GROUP BY 1, 2),
cc AS (SELECT *, (vv * uy - uv * vy) / (uu * vv - uv * uv) AS bu, (uu * vy - uv * uy) / (uu * vv - uv * uv) AS bv, (vv * mu - uv * mv) / (uu * vv - uv * uv) AS cu, (uu * mv - uv * mu) / (uu * vv - uv * uv) AS cv, CAST(greatest(1, floor(4 * pow(n / 100, 2.0 / 9))) AS INTEGER) AS lags FROM mm),
gg AS (SELECT r.variant, r.side, i, (y - (my - bu * mu - bv * mv) - bu * u - bv * v) * (1 - cu * (u - mu) - cv * (v - mv)) / n AS g FROM rows_ r JOIN cc USING (variant, side)),
va AS (SELECT p.variant, p.side, sum(p.g * q.g * CASE WHEN p.i = q.i THEN 1.0 ELSE 2 * (1 - (p.i - q.i) / (lags + 1)) END) AS var FROM gg p JOIN cc ON cc.variant = p.variant AND cc.side = p.side JOIN gg q ON q.variant = p.variant AND q.side = p.side AND q.i BETWEEN p.i - lags AND p.i GROUP BY 1, 2),
al AS (SELECT variant, side, n, lags, my - bu * mu - bv * mv AS alpha, my, (bu * uy + bv * vy) / yy AS r2, (my - bu * mu - bv * mv) / sqrt(var * n / (n - k - 1)) AS t FROM cc JOIN va USING (variant, side))"""
SQL = {
    "a60_book_weeks": f"{WEEKS} SELECT variant, date, n_stocks, " + ", ".join(f"{r6(e)} AS {k}" for k, e in {"gross": "gross", "cost": "cost", "net": "gross - cost", "bench": "bench", "universe": "universe", "turnover": "turnover"}.items()) + " FROM weeks",
    "a26_book_statistics": f"""{WEEKS} SELECT variant, count(*) AS weeks, {r6(year_sql('net'))} AS ann_return, {r6(year_sql('bench'))} AS bench_ann_return, {r6('avg(excess) * 52')} AS excess_ann, {r6('avg(gross - bench) * 52')} AS gross_excess_ann,
 {r6('avg(excess) / stddev_samp(excess) * sqrt(52)')} AS info_ratio, {r6('avg(CASE WHEN excess > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate, {r6('min(drawdown)')} AS max_drawdown, {r6('avg(turnover) FILTER (i > 1)')} AS avg_turnover, {r6('avg(cost) FILTER (i > 1) * 52')} AS cost_ann, {r6('avg(n_stocks)')} AS avg_stocks FROM {falls('kw', 'net', 'variant')} GROUP BY 1""",
    "a9_backtest_summary": f"""{WEEKS}, l AS (SELECT variant, date, turnover, cost, unnest(['net', 'gross', 'bench', 'excess']) AS series, unnest([net, gross, bench, greatest(excess, -0.99::DOUBLE)]) AS r FROM kw)
 SELECT variant, series, count(*) AS weeks, {r6(year_sql('r'))} AS cagr, {r6('stddev_samp(r) * sqrt(52)')} AS vol, {r6('avg(r) / stddev_samp(r) * sqrt(52)')} AS sharpe, {r6('min(drawdown)')} AS max_drawdown, {r6('avg(turnover)')} AS turnover, {r6('avg(cost) * 52')} AS cost_drag FROM {falls('l', 'r', 'variant, series')} GROUP BY 1, 2""",
    "a11_window_return": f"{WEEKS} SELECT variant, count(*) AS weeks, {r6('ln(product(1 + net))')} AS log_net, {r6('ln(product(1 + bench))')} AS log_bench FROM kw WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 1",
    "a62_equal_weight": f"{WEEKS} SELECT variant, " + ", ".join(f"{r6(year_sql(c))} AS {c}" for c in ("net", "universe", "bench")) + f", {r6(EXCESS)} AS excess, {r6('avg(CASE WHEN net > universe THEN 1.0 ELSE 0.0 END)')} AS ahead FROM kw GROUP BY 1",
    "a58_design_choice": f"{DESIGNS} SELECT variant, every, {r6('info_ratio')} AS info_ratio, {r6('turnover')} AS turnover FROM designs QUALIFY row_number() OVER (PARTITION BY variant ORDER BY round(info_ratio, 9) DESC NULLS LAST, round(turnover, 9), every) = 1",
    "a34_trials": f"{DESIGNS} SELECT count(info_ratio) AS trials, {r6('var_samp(info_ratio / sqrt(52))')} AS variance FROM designs",
    "a31_sample_moments": f"{MOMENTS}, pt AS (SELECT variant, avg(net - universe) / stddev_samp(net - universe) * sqrt(count(*)) AS paired_t FROM kw GROUP BY 1) SELECT variant, n, " + ", ".join(f"{r6(c)} AS {c}" for c in ("mean", "sd", "skew", "kurt", "sharpe", "t", "paired_t")) + " FROM mo JOIN pt USING (variant)",
    "a32_sharpe_odds": f"{LUCK} SELECT variant, " + ", ".join(f"{r6(c)} AS {c}" for c in ("sharpe", "luck", "psr", "dsr")) + " FROM odds",
    "a33_exam_verdict": f"{LUCK} SELECT variant, CASE WHEN mean > 0 AND dsr >= 0.95 THEN 'REAL EDGE' WHEN mean > 0 AND psr >= 0.95 THEN 'PROMISING' ELSE 'NO PROVEN EDGE' END AS verdict, {r6('t')} AS excess_t, n AS weeks FROM odds",
    "a33_excess_by_year": f"{WEEKS} SELECT variant, CAST(year(date) AS INTEGER) AS year, count(*) AS weeks, {r6('avg(excess) * 52')} AS excess_ann FROM kw GROUP BY 1, 2",
    "a37_decomposition": f"{HAC} SELECT variant, side, n AS weeks, lags, {r6('alpha * 52')} AS alpha_ann, {r6('(my - alpha) * 52')} AS explained_ann, {r6('t')} AS t, {r6('r2')} AS r2, CASE WHEN t >= 2 THEN 'alpha' WHEN t <= -2 THEN 'negative alpha' ELSE 'no proven alpha' END AS verdict FROM al",
    "a38_alpha_by_market": f"""{WEEKS}, tr AS (SELECT *, CASE WHEN count(universe) OVER z = 13 THEN CASE WHEN product(1 + universe) OVER z > 1 THEN 'rising' ELSE 'falling' END END AS trend FROM kw WINDOW z AS (PARTITION BY variant ORDER BY date ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)),
 ll AS (SELECT variant, net, universe, unnest([CAST(year(date) AS VARCHAR), trend]) AS label FROM tr) SELECT variant, label, count(*) AS weeks, {r6('regr_intercept(net, universe) * 52')} AS alpha FROM ll WHERE label IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 13""",
    "a39_replays": f"""{WEEKS}, nn AS (SELECT variant, max(i) AS n FROM kw GROUP BY 1), dr AS (SELECT variant, k, bl, CAST('0x' || sha256(k || ':' || bl)[:13] AS BIGINT) % (n - 3) AS st FROM nn, range(0, 10000) u(k), range(0, 13) z(bl)),
 pa AS (SELECT d.variant, d.k, bl * 4 + j AS place, net, bench FROM dr d, range(1, 5) q(j), kw WHERE kw.variant = d.variant AND kw.i = st + j),
 eq AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY variant, k ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS equity FROM pa),
 fa AS (SELECT *, equity / max(equity) OVER (PARTITION BY variant, k ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS fall FROM eq),
 ys AS (SELECT variant, k, exp(sum(ln(1 + net))) - 1 AS r, exp(sum(ln(1 + bench))) - 1 AS m, min(fall) AS fall FROM fa GROUP BY 1, 2)
 SELECT variant, count(*) AS replays, """ + ", ".join(f"{r6(f'quantile_cont({c}, {q / 100})')} AS {c}{q}" for c in ("r", "fall") for q in (5, 25, 50, 75, 95)) + f", {r6('avg(CASE WHEN r > m THEN 1.0 ELSE 0.0 END)')} AS beats FROM ys GROUP BY 1",
    "a40_return_histogram": f"{WITH}, {AHEAD}, ed AS (SELECT quantile_cont(r, 0.005) AS lo, quantile_cont(r, 0.995) AS hi FROM ahead WHERE r IS NOT NULL) SELECT CAST(least(floor((greatest(lo, least(hi, r)) - lo) / ((hi - lo) / 30)), 29) + 1 AS INTEGER) AS bin, count(*) AS n FROM ahead, ed WHERE r IS NOT NULL AND hi > lo GROUP BY 1",
    "a61_holdings_accounting": f"""{WEEKS}, hs AS (SELECT variant, h.date, count(CASE WHEN is_ THEN 1 END) AS n, count(CASE WHEN was THEN 1 END) AS o, sum(CASE WHEN is_ THEN coalesce(r, 0.0) END) AS s, count(CASE WHEN NOT was THEN 1 END) AS bu, count(CASE WHEN NOT is_ THEN 1 END) AS se FROM held h LEFT JOIN ahead a ON a.date = h.date AND a.code = h.code GROUP BY 1, 2),
 hh AS (SELECT variant, date, s / n AS gross, bu / n AS buys, CASE WHEN o > 0 THEN se / o ELSE 0.0 END AS sells FROM hs WHERE n > 0), hc AS (SELECT *, buys * 0.001::DOUBLE + sells * 0.0015::DOUBLE AS cost FROM hh)
 SELECT variant, hc.date, {r6('gross')} AS gross, {r6('buys')} AS buys, {r6('sells')} AS sells, {r6('cost')} AS cost, {r6('gross - cost')} AS net, {r6('bench')} AS bench FROM hc LEFT JOIN mk ON mk.date = hc.date""",
}
