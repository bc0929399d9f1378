"""Queries of the feature set, recursive windows, scoring summaries, books and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crosspanel.functions import factors as f
from crosspanel.functions import features as ft
from crosspanel.operators import scoring as s
from crosspanel.operators.expanding import average_rank, expanding_counts
from crosspanel.plans.factor_queries import LAGS, RANK, WITH, filled, frame, w
from crosspanel.plans.table_queries import IC, LEVEL, RANKS, RET, SCORED, R, returns, scored
from crosspanel.sources import panel as p
from crosspanel.streaming import runs

R4 = lambda c: F.round(c.cast("double") + 1e-9, 4) + 0.0
SPAN = 6
#: Slots of a book and costs of a buy and of a sale.
SLOTS, BUY, SELL = 10, 0.001, 0.0015


def w24_candles(spark, d):
    x = p.bars(spark, d)
    return x.select("date", "code", *(R4(e).alias(k) for k, e in ft.candles().items()))


def rolling_query(d):
    def run(spark, sf_dir):
        return ft.rolled(p.dense_bars(spark, sf_dir), (d,)).select("date", "code", *(R4(F.col(f"{k}{d}")).alias(k) for k in ft.FAMILY))

    return run


def w12_ema(spark, d):
    """Exponential mean over each code's calendar; gaps let the old weight decay. One code's rows are one per week at most."""

    def one(x):
        x = x.sort_values("t")
        return x.assign(v=x["close"].ewm(span=SPAN, adjust=False, min_periods=SPAN).mean())[["date", "code", "v"]]

    made = p.dense_bars(spark, d).select("date", "code", "t", "close").groupBy("code").applyInPandas(one, "date date, code long, v double")
    return made.select("date", "code", R4(F.nanvl("v", F.lit(None).cast("double"))).alias("v"))


def w39_centred_ranks(spark, d):
    """Each feature's rank of the day less one half, by one window over all features."""
    x = p.bars(spark, d).select("date", "code", "close", "volume", "value")
    long = x.unpivot(["date", "code"], [F.col(c).cast("double") for c in ("close", "volume", "value")], "feature", "x")
    day = Window.partitionBy("date", "feature")
    place = F.rank().over(day.orderBy("x")) + (F.count("*").over(Window.partitionBy("date", "feature", "x")) - 1) / 2
    return long.select("date", "code", "feature", R4(place / F.count("*").over(day) - 0.5).alias("v"))


def w43_benchmark_forward(spark, d):
    """Return of the benchmark over this and the next four weeks, all five present; the date when the label is known."""
    by = Window.partitionBy("series").orderBy("date")
    ahead = by.rowsBetween(0, 4)
    r = returns(spark, d)
    return r.select("date", R4(F.when(F.count("r").over(ahead) == 5, F.expm1(F.sum(F.log1p("r")).over(ahead)))).alias("v"), F.lead("date", 6).over(by).alias("known"))


def w47_expanding_rank(spark, d):
    """Average rank of each benchmark return among those up to it, from the 26th on."""
    ranked = expanding_counts(returns(spark, d).where("r is not null"), ["series"], "date", "r")
    return ranked.select("date", R4(F.when(F.col("n") >= 26, average_rank())).alias("v"))


def w53_value_ratio(spark, d):
    before = f.by_code().rowsBetween(-20, -1)
    ratio = f.safe_div(F.col("value"), F.when(F.count("value").over(before) >= 5, F.percentile("value", 0.5).over(before)))
    return p.dense_bars(spark, d).select("date", "code", R4(ratio).alias("v"))


def w55_price_factor(spark, d):
    """A fall below 0.2 of the last price counts as an event; product of its inverse ratios over all later events."""
    x = p.dense_bars(spark, d)
    last = F.last("close", ignorenulls=True).over(f.by_code().rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("move", f.safe_div(F.col("close"), last))
    later = F.sum(F.when(F.col("move") < 0.2, F.round(F.log("move"), 3))).over(f.by_code().rowsBetween(1, Window.unboundedFollowing))
    return x.select("date", "code", R4(F.coalesce(later, F.lit(0.0))).alias("log_factor"))


def a8_return_summary(spark, d):
    x = s.drawdown(returns(spark, d))
    n, total = F.count("*"), F.sum(F.log1p("r"))
    return x.agg(n.alias("n"), R4(F.exp(total * 52 / n) - 1).alias("cagr"), R4(F.stddev_samp("r") * 52**0.5).alias("vol"), R4(F.avg("r") / F.stddev_samp("r") * 52**0.5).alias("sharpe"), R4(F.min("drawdown")).alias("max_drawdown"), R4(F.exp(total) - 1).alias("total"))


def a12_same_sign_years(spark, d):
    """Share of years whose mean coefficient has the sign of the whole; zero counts as plus."""
    years = s.spearman_ic(scored(spark, d)).groupBy(F.year("date").alias("year")).agg(F.sum("ic").alias("x"))
    plus = F.avg((F.col("x") >= 0).cast("double"))
    return years.agg(F.count("*").alias("years"), R4(F.when(F.sum("x") >= 0, plus).otherwise(1 - plus)).alias("share"))


def a13_autocorrelation(spark, d):
    x = scored(spark, d).withColumn("fwd", F.lag("f").over(Window.partitionBy("code").orderBy("date")))
    return s.spearman_ic(x).agg(F.count("*").alias("n"), R4(F.avg("ic")).alias("autocorr"))


def a15_coverage(spark, d):
    x = p.dense_bars(spark, d).select("date", "close", f.mean(F.col("close"), 4).alias("m")).where("close is not null")
    return x.groupBy("date").agg(F.count("*").alias("members"), R4(F.avg(F.col("m").isNotNull().cast("double"))).alias("coverage"))


def a16_similarity(spark, d):
    """Mean over days of the cosine of two factors' centred ranks; null is the middle."""
    x = p.dense_bars(spark, d).select("date", f.mean(F.col("close"), 2).alias("a"), F.col("volume").alias("b")).where("b is not null")
    x = x.select("date", *(F.coalesce(f.cs_rank(F.col(c)) - 0.5, F.lit(0.0)).alias(c) for c in "ab"))
    days = x.groupBy("date").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b"))).alias("size"))
    return days.where("size > 1e-9").agg(F.count("*").alias("days"), R4(F.avg(F.col("ab") / F.col("size"))).alias("similarity"))


def a41_breadth(spark, d):
    x = p.dense_bars(spark, d).select("date", "close", f.mean(F.col("close"), 10).alias("m"), f.ref(F.col("close"), 1).alias("c1")).where("close is not null")
    one = lambda e: F.sum(F.when(e, 1).otherwise(0))
    return x.groupBy("date").agg(R4(one(F.col("close") > F.col("m")) / F.count("*")).alias("above"), R4((one(F.col("close") > F.col("c1")) - one(F.col("close") < F.col("c1"))) / F.count("*")).alias("net_up"))


def _book(spark, d):
    return s.top_k(p.bars(spark, d).select("date", "code", "value"), ["date"], [F.desc("value"), F.asc("code")], SLOTS).select("date", "code")


def j17_book_overlap(spark, d):
    """Names that stay from the book of the week before."""
    book = _book(spark, d)
    before = book.select(F.date_add("date", 7).alias("date"), "code", F.lit(1).alias("was"))
    return book.join(before, ["date", "code"], "left").groupBy("date").agg(F.count("*").alias("names"), F.count("was").alias("stayed"))


def _book_returns(spark, d):
    book = _book(spark, d)
    ahead = p.dense_bars(spark, d).select("date", "code", (f.safe_div(F.lead("close").over(f.by_code()), F.col("close")) - 1).alias("r"))
    before = book.select(F.date_add("date", 7).alias("date"), "code", F.lit(1).alias("was"))
    buys = F.sum(F.when(F.col("was").isNull(), 1).otherwise(0))
    # what is not bought was held, and as many names as were held and not kept have gone
    made = book.join(ahead, ["date", "code"], "left").join(before, ["date", "code"], "left").groupBy("date").agg((F.sum(F.coalesce("r", F.lit(0.0))) / SLOTS).alias("gross"), (buys * (BUY + SELL) / SLOTS).alias("cost"))
    return made.select("date", "gross", (F.col("gross") - F.col("cost")).alias("net"))


def a60_book_return(spark, d):
    return _book_returns(spark, d).select("date", R4(F.col("gross")).alias("gross"), R4(F.col("net")).alias("net"))


def a29_by_regime(spark, d):
    """Weeks and mean net return of the book where the benchmark has risen or fallen over 13 weeks."""
    before = Window.partitionBy("series").orderBy("date").rowsBetween(-13, -1)
    trend = returns(spark, d).select("date", F.when(F.count("r").over(before) == 13, F.when(F.sum(F.log1p("r")).over(before) >= 0, "rising").otherwise("falling")).alias("regime"))
    return _book_returns(spark, d).join(trend, "date").where("regime is not null").groupBy("regime").agg(F.count("*").alias("weeks"), R4(F.avg("net")).alias("net"), R4(F.avg((F.col("net") > 0).cast("double"))).alias("hit_rate"))


def j10_asof_last(spark, d):
    """For each error event the user's last purchase before it."""
    win = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = p.read(spark, d, "events").withColumn("last", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(win))
    return e.where("event_type = 'error'").select("event_id", F.col("last").alias("value"))


def p17_indexed(spark, d):
    w0 = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return p.bars(spark, d).select("date", "code", R4(F.col("close") / F.first("close").over(w0) * 100).alias("v"))


def p18_trailing(spark, d):
    w0 = Window.partitionBy("code").orderBy("date")
    return p.bars(spark, d).select("date", "code", *(R4(F.col("close") / F.lag("close", n).over(w0) - 1).alias(f"r{n}") for n in (5, 21, 63)))


def r2_latest_status_stream(spark, d):
    return runs.finished(runs.latest_status(runs.events(spark, d)), "complete")


def r3_weekly_stream(spark, d):
    return runs.finished(runs.weekly_totals(runs.events(spark, d)), "append")


CALLS = (w24_candles, w12_ema, w39_centred_ranks, w43_benchmark_forward, w47_expanding_rank, w53_value_ratio, w55_price_factor, a8_return_summary, a12_same_sign_years, a13_autocorrelation, a15_coverage, a16_similarity, a41_breadth, j17_book_overlap, a60_book_return, a29_by_regime, j10_asof_last, p17_indexed, p18_trailing, r2_latest_status_stream, r3_weekly_stream)
QUERIES = {c.__name__: c for c in CALLS} | {f"w26_rolling_{d}": rolling_query(d) for d in ft.WINDOWS}


def r4(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE) + 1e-9, 4) + 0.0"


CANDLES = {
    "kmid": "(close - open) / open", "klen": "(high - low) / open", "kmid2": "(close - open) / span", "kup": "(high - greatest(open, close)) / open", "kup2": "(high - greatest(open, close)) / span", "klow": "(least(open, close) - low) / open",
    "klow2": "(least(open, close) - low) / span", "ksft": "(2 * close - high - low) / open", "ksft2": "(2 * close - high - low) / span", "open0": "open / close", "high0": "high / close", "low0": "low / close", "vwap0": "vwap / close",
}
PREPARED = f"""x AS (SELECT *, volume AS v, lag(close) {LAGS} AS c1, lag(volume) {LAGS} AS v1 FROM dense),
y AS (SELECT *, CASE WHEN c1 IS NOT NULL AND close IS NOT NULL THEN greatest(close - c1, 0) END AS up, CASE WHEN c1 IS NOT NULL AND close IS NOT NULL THEN greatest(c1 - close, 0) END AS dn, CASE WHEN v1 IS NOT NULL AND v IS NOT NULL THEN greatest(v - v1, 0) END AS vup, CASE WHEN v1 IS NOT NULL AND v IS NOT NULL THEN greatest(v1 - v, 0) END AS vdn,
 close / c1 AS rel, ln(v + 1) AS lv, ln(v / v1 + 1) AS lvc, abs(close / c1 - 1) * v AS wv, CASE WHEN coalesce(close > c1, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cup, CASE WHEN coalesce(close < c1, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cdn, coalesce(high, 'infinity'::DOUBLE) AS hx, coalesce(low, '-infinity'::DOUBLE) AS lx FROM x)"""


def rolling_exprs(d: int) -> dict[str, str]:
    fr = frame(d)
    q = lambda fn, x: f"({filled(w(fn, x, d), x, d)})"

    def corr(a, b):
        m = lambda e: f"avg({e}) {fr}"
        va, vb = (f"({m(f'{z} * {z}')} - {m(z)} * {m(z)})" for z in (a, b))
        return f"CASE WHEN count({a} * {b}) {fr} = {d} THEN ({m(f'{a} * {b}')} - {m(a)} * {m(b)}) / sqrt(greatest({va} * {vb}, 1e-12)) END"

    slope, var = f"regr_slope(close, t) {fr}", f"var_pop(close) {fr}"
    first, last = (f"CASE WHEN count(*) {fr} = {d} THEN list_position(list({x}) {fr}, {fn}({x}) {fr}) - 1 END" for x, fn in (("hx", "max"), ("lx", "min")))
    share = lambda x: f"CASE WHEN count(*) {fr} = {d} THEN avg({x}) {fr} END"
    sa, va = f"({q('sum', 'up')} + {q('sum', 'dn')} + 1e-12)", f"({q('sum', 'vup')} + {q('sum', 'vdn')} + 1e-12)"
    high, low = q("max", "high"), q("min", "low")
    return {
        "roc": f"lag(close, {d}) {LAGS} / close", "ma": q("avg", "close") + " / close", "std": q("stddev_samp", "close") + " / close", "beta": f"({filled(slope, 'close', d)}) / close",
        "rsqr": filled(f"1 - ({var} * {d} - ({slope}) * ({slope}) * {d * (d * d - 1) / 12}) / ({var} * {d} + 1e-12)", "close", d), "resi": f"({filled(f'close - (avg(close) {fr} + ({slope}) * {(d - 1) / 2})', 'close', d)}) / close",
        "max": f"{high} / close", "min": f"{low} / close", "qtlu": f"({filled(f'quantile_cont(close, 0.8) {fr}', 'close', d)}) / close", "qtld": f"({filled(f'quantile_cont(close, 0.2) {fr}', 'close', d)}) / close",
        "rank": filled(f"(len(list_filter(list(close) {fr}, lambda z: z < close)) + (len(list_filter(list(close) {fr}, lambda z: z = close)) + 1) / 2.0) / {d}", "close", d), "rsv": f"(close - {low}) / ({high} - {low} + 1e-12)",
        "imax": f"({first}) / {d}.0", "imin": f"({last}) / {d}.0", "imxd": f"(({first}) - ({last})) / {d}.0", "corr": corr("close", "lv"), "cord": corr("rel", "lvc"), "cntp": share("cup"), "cntn": share("cdn"), "cntd": f"({share('cup')}) - ({share('cdn')})",
        "sump": f"{q('sum', 'up')} / {sa}", "sumn": f"{q('sum', 'dn')} / {sa}", "sumd": f"({q('sum', 'up')} - {q('sum', 'dn')}) / {sa}", "vma": f"{q('avg', 'v')} / (v + 1e-12)", "vstd": f"{q('stddev_samp', 'v')} / (v + 1e-12)",
        "wvma": f"{q('stddev_samp', 'wv')} / ({q('avg', 'wv')} + 1e-12)", "vsump": f"{q('sum', 'vup')} / {va}", "vsumn": f"{q('sum', 'vdn')} / {va}", "vsumd": f"({q('sum', 'vup')} - {q('sum', 'vdn')}) / {va}",
    }


def rolling_sql(d: int) -> str:
    return f"{WITH}, {PREPARED} SELECT date, code, " + ", ".join(f'{r4(x)} AS "{k}"' for k, x in rolling_exprs(d).items()) + " FROM y"


BOOK = "book AS (SELECT date, code FROM bars QUALIFY row_number() OVER (PARTITION BY date ORDER BY value DESC, code) <= 10), was AS (SELECT CAST(date + 7 AS DATE) AS date, code, 1 AS was FROM book)"
BOOK_RET = f"{WITH}, {BOOK}, ahead AS (SELECT date, code, lead(close) {LAGS} / close - 1 AS r FROM dense), net AS (SELECT date, sum(coalesce(r, 0.0)) / 10 AS gross, sum(coalesce(r, 0.0)) / 10 - sum(CASE WHEN was IS NULL THEN 1 ELSE 0 END) * 0.0025::DOUBLE / 10 AS net FROM book LEFT JOIN ahead USING (date, code) LEFT JOIN was USING (date, code) GROUP BY 1)"
HISTORY = "(PARTITION BY 1 ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SQL = {f"w26_rolling_{d}": rolling_sql(d) for d in ft.WINDOWS} | {
    "w24_candles": f"{WITH} SELECT date, code, " + ", ".join(f"{r4(e)} AS {k}" for k, e in CANDLES.items()) + " FROM (SELECT *, value / volume AS vwap, high - low + 1e-12 AS span FROM bars)",
    "w12_ema": WITH.replace("WITH", "WITH RECURSIVE", 1) + f""", s AS (SELECT code, date, t, close, close AS m, 1.0::DOUBLE AS old, CASE WHEN close IS NULL THEN 0 ELSE 1 END AS n FROM dense WHERE t = 1
 UNION ALL SELECT d.code, d.date, d.t, d.close, CASE WHEN s.m IS NULL THEN d.close WHEN d.close IS NULL THEN s.m ELSE (s.old * {1 - 2 / (SPAN + 1)}::DOUBLE * s.m + {2 / (SPAN + 1)}::DOUBLE * d.close) / (s.old * {1 - 2 / (SPAN + 1)}::DOUBLE + {2 / (SPAN + 1)}::DOUBLE) END, CASE WHEN s.m IS NOT NULL AND d.close IS NULL THEN s.old * {1 - 2 / (SPAN + 1)}::DOUBLE ELSE 1.0 END, s.n + CASE WHEN d.close IS NULL THEN 0 ELSE 1 END FROM s JOIN dense d ON d.code = s.code AND d.t = s.t + 1)
 SELECT date, code, {r4(f"CASE WHEN n >= {SPAN} THEN m END")} AS v FROM s""",
    "w39_centred_ranks": f"{WITH}, l AS (SELECT date, code, unnest(['close', 'volume', 'value']) AS feature, unnest([close, volume, value]) AS x FROM bars) SELECT date, code, feature, {r4('(rank() OVER (PARTITION BY date, feature ORDER BY x) + (count(*) OVER (PARTITION BY date, feature, x) - 1) / 2.0) / count(*) OVER (PARTITION BY date, feature) - 0.5')} AS v FROM l",
    "w43_benchmark_forward": f"{RET} SELECT date, {r4('CASE WHEN count(r) OVER z = 5 THEN exp(sum(ln(1 + r)) OVER z) - 1 END')} AS v, lead(date, 6) OVER (ORDER BY date) AS known FROM (SELECT * FROM ret WHERE r IS NOT NULL) WINDOW z AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)",
    "w47_expanding_rank": f"{RET}, r0 AS (SELECT * FROM ret WHERE r IS NOT NULL) SELECT a.date, {r4('CASE WHEN count(*) >= 26 THEN (sum(CASE WHEN b.r < a.r THEN 1 ELSE 0 END) + (sum(CASE WHEN b.r = a.r THEN 1 ELSE 0 END) + 1) / 2.0) / count(*) END')} AS v FROM r0 a JOIN r0 b ON b.date <= a.date GROUP BY a.date, a.r",
    "w53_value_ratio": f"{WITH} SELECT date, code, {r4('value / CASE WHEN count(value) OVER z >= 5 THEN quantile_cont(value, 0.5) OVER z END')} AS v FROM dense WINDOW z AS (PARTITION BY code ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)",
    "w55_price_factor": f"{WITH}, m AS (SELECT *, close / last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS move FROM dense) SELECT date, code, {r4('coalesce(sum(CASE WHEN move < 0.2 THEN round(ln(move), 3) END) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)')} AS log_factor FROM m",
    "a8_return_summary": f"{RET}, eq AS (SELECT r, exp(sum(ln(1 + r)) OVER {HISTORY}) AS equity, date FROM ret WHERE r IS NOT NULL), dd AS (SELECT r, equity / max(equity) OVER {HISTORY} - 1 AS drawdown FROM eq) SELECT count(*) AS n, {r4('exp(sum(ln(1 + r)) * 52 / count(*)) - 1')} AS cagr, {r4('stddev_samp(r) * sqrt(52)')} AS vol, {r4('avg(r) / stddev_samp(r) * sqrt(52)')} AS sharpe, {r4('min(drawdown)')} AS max_drawdown, {r4('exp(sum(ln(1 + r))) - 1')} AS total FROM dd",
    "a12_same_sign_years": f"{SCORED}, {RANKS}, {IC.format(t='ranks')}, ys AS (SELECT year(date) AS y, sum(ic) AS x FROM ic GROUP BY 1) SELECT count(*) AS years, {r4('CASE WHEN sum(x) >= 0 THEN avg(CASE WHEN x >= 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - avg(CASE WHEN x >= 0 THEN 1.0 ELSE 0.0 END) END')} AS share FROM ys",
    "a13_autocorrelation": f"{SCORED.replace('scored AS', 'raw AS')}, scored AS (SELECT date, code, f, lag(f) OVER (PARTITION BY code ORDER BY date) AS fwd FROM raw), {RANKS}, {IC.format(t='ranks')} SELECT count(ic) AS n, {r4('avg(ic)')} AS autocorr FROM ic",
    "a15_coverage": f"{WITH}, m AS (SELECT date, close, {filled(w('avg', 'close', 4), 'close', 4)} AS m FROM dense) SELECT date, count(*) AS members, {r4('avg(CASE WHEN m IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS coverage FROM m WHERE close IS NOT NULL GROUP BY 1",
    "a16_similarity": f"{WITH}, m AS (SELECT date, {filled(w('avg', 'close', 2), 'close', 2)} AS a, volume AS b FROM dense), n AS (SELECT date, " + ", ".join(f"coalesce(CASE WHEN {c} IS NOT NULL THEN {RANK.replace('close', c)} / count({c}) OVER (PARTITION BY date) - 0.5 END, 0) AS {c}" for c in "ab") + f" FROM m WHERE b IS NOT NULL), q AS (SELECT date, sum(a * b) AS ab, sqrt(sum(a * a) * sum(b * b)) AS size FROM n GROUP BY 1) SELECT count(*) AS days, {r4('avg(ab / size)')} AS similarity FROM q WHERE size > 1e-9",
    "a41_breadth": f"{WITH}, m AS (SELECT date, close, {filled(w('avg', 'close', 10), 'close', 10)} AS m, lag(close) {LAGS} AS c1 FROM dense) SELECT date, {r4('sum(CASE WHEN close > m THEN 1 ELSE 0 END) / count(*)')} AS above, {r4('(sum(CASE WHEN close > c1 THEN 1 ELSE 0 END) - sum(CASE WHEN close < c1 THEN 1 ELSE 0 END)) / count(*)')} AS net_up FROM m WHERE close IS NOT NULL GROUP BY 1",
    "j17_book_overlap": f"{WITH}, {BOOK} SELECT date, count(*) AS names, count(was) AS stayed FROM book LEFT JOIN was USING (date, code) GROUP BY 1",
    "a60_book_return": f"{BOOK_RET} SELECT date, {r4('gross')} AS gross, {r4('net')} AS net FROM net",
    "a29_by_regime": f"{BOOK_RET}, {LEVEL}, g AS (SELECT date, CASE WHEN count(r) OVER z = 13 THEN CASE WHEN sum(ln(1 + r)) OVER z >= 0 THEN 'rising' ELSE 'falling' END END AS regime FROM (SELECT * FROM ret WHERE r IS NOT NULL) WINDOW z AS (ORDER BY date ROWS BETWEEN 13 PRECEDING AND 1 PRECEDING)) SELECT regime, count(*) AS weeks, {r4('avg(net)')} AS net, {r4('avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END)')} AS hit_rate FROM net JOIN g USING (date) WHERE regime IS NOT NULL GROUP BY 1",
    "j10_asof_last": "SELECT event_id, v AS value FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM events) WHERE event_type = 'error'",
    "p17_indexed": f"{WITH} SELECT date, code, {r4('close / first_value(close) OVER (PARTITION BY code ORDER BY date) * 100')} AS v FROM bars",
    "p18_trailing": f"{WITH} SELECT date, code, " + ", ".join(f"{r4(f'close / lag(close, {n}) OVER (PARTITION BY code ORDER BY date) - 1')} AS r{n}" for n in (5, 21, 63)) + " FROM bars",
    "r2_latest_status_stream": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n FROM events GROUP BY 1",
    "r3_weekly_stream": "SELECT * FROM (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week, event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2) WHERE week + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
}
