"""Queries of the factor language over weekly bars, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosspanel.functions import factors as f
from crosspanel.sources import panel as p

BARS = """bars AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_suppkey AS code, arg_min(px, o) AS open, max(px) AS high, min(px) AS low, arg_max(px, o) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS value
 FROM (SELECT *, l_extendedprice / l_quantity AS px, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS o FROM lineitem) GROUP BY 1, 2),
dense AS (SELECT g.date, g.code, CAST(date_diff('day', m.a, g.date) // 7 + 1 AS INTEGER) AS t, b.open, b.high, b.low, b.close, b.volume, b.value, b.value / b.volume AS vwap
 FROM (SELECT min(date) AS a, max(date) AS z FROM bars) m, LATERAL (SELECT c.code, CAST(u.d AS DATE) AS date FROM (SELECT DISTINCT code FROM bars) c, (SELECT unnest(generate_series(m.a, m.z, INTERVAL 7 DAY)) AS d) u) g LEFT JOIN bars b ON b.date = g.date AND b.code = g.code)"""
WITH = "WITH " + BARS


def frame(d: int) -> str:
    return f"OVER (PARTITION BY code ORDER BY t ROWS BETWEEN {d - 1} PRECEDING AND CURRENT ROW)"


LAGS = "OVER (PARTITION BY code ORDER BY t)"


def filled(e: str, x: str, d: int) -> str:
    return f"CASE WHEN count({x}) {frame(d)} = {d} THEN {e} END"


def w(fn: str, x: str, d: int) -> str:
    return f"{fn}({x}) {frame(d)}"


def _decay(x: str, d: int) -> str:
    return "(" + " + ".join(f"{d - k} * lag({x}, {k}) {LAGS}" for k in range(d)) + f") / {d * (d + 1) / 2}"


D = 10
SLOPE = f"regr_slope(close, t) {frame(D)}"


def C():
    return F.col("close")


def V():
    return F.col("volume")


COV = "({a} - {x} * {y})".format(a=w("avg", "close * volume", D), x=w("avg", "close", D), y=w("avg", "volume", D))
VA, VB = (f"({w('avg', f'{x} * {x}', D)} - {w('avg', x, D)} * {w('avg', x, D)})" for x in ("close", "volume"))
RANK = "(rank() OVER (PARTITION BY date, close IS NULL ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0)"

#: Key: the Column and its SQL, both over the dense weekly bars.
EXPRESSIONS = {
    "w1_ref": (lambda: f.ref(C(), 3), f"lag(close, 3) {LAGS}"),
    "w2_delta": (lambda: f.delta(C(), 3), f"close - lag(close, 3) {LAGS}"),
    "w3_pct": (lambda: f.pct(C(), 3), f"CASE WHEN abs(lag(close, 3) {LAGS}) > 1e-12 THEN close / lag(close, 3) {LAGS} END - 1"),
    "w4_mean": (lambda: f.mean(C(), D), filled(w("avg", "close", D), "close", D)),
    "w5_sum": (lambda: f.total(V(), D), filled(w("sum", "volume", D), "volume", D)),
    "w6_std": (lambda: f.std(C(), D), filled(w("stddev_samp", "close", D), "close", D)),
    "w7_ts_max": (lambda: f.ts_max(C(), D), filled(w("max", "close", D), "close", D)),
    "w8_ts_min": (lambda: f.ts_min(C(), D), filled(w("min", "close", D), "close", D)),
    "w9_ts_rank": (lambda: f.ts_rank(V(), D), filled(f"(len(list_filter(list(volume) {frame(D)}, lambda v: v < volume)) + (len(list_filter(list(volume) {frame(D)}, lambda v: v = volume)) + 1) / 2.0) / {D}", "volume", D)),
    "w10_skew": (lambda: f.skew(C(), D), filled(f"CASE WHEN {w('var_pop', 'close', D)} > 1e-12 THEN {w('skewness', 'close', D)} END", "close", D)),
    "w11_kurt": (lambda: f.kurt(C(), D), filled(f"CASE WHEN {w('var_pop', 'close', D)} > 1e-12 THEN {w('kurtosis', 'close', D)} END", "close", D)),
    "w13_decay": (lambda: f.decay(C(), 5), _decay("close", 5)),
    "w14_slope": (lambda: f.slope(C(), D), filled(SLOPE, "close", D)),
    "w15_rsquare": (lambda: f.rsquare(C(), D), filled(f"1 - ({w('var_pop', 'close', D)} * {D} - ({SLOPE}) * ({SLOPE}) * {D * (D * D - 1) / 12}) / ({w('var_pop', 'close', D)} * {D} + 1e-12)", "close", D)),
    "w16_resi": (lambda: f.resi(C(), D), filled(f"close - ({w('avg', 'close', D)} + ({SLOPE}) * {(D - 1) / 2})", "close", D)),
    "w17_idx_max": (lambda: f.idx_max(C(), D), filled(f"({D} - list_position(list(close) {frame(D)}, {w('max', 'close', D)})) / {D}.0", "close", D)),
    "w18_idx_min": (lambda: f.idx_min(C(), D), filled(f"({D} - list_position(list(close) {frame(D)}, {w('min', 'close', D)})) / {D}.0", "close", D)),
    "w19_corr": (lambda: f.corr(C(), V(), D), filled(f"{COV} / sqrt(greatest({VA} * {VB}, 1e-12))", "close", D)),
    "w20_cov": (lambda: f.cov(C(), V(), D), filled(COV, "close", D)),
    "w21_cs_rank": (lambda: f.cs_rank(C()), f"CASE WHEN close IS NOT NULL THEN {RANK} / count(close) OVER (PARTITION BY date) END"),
    "w22_cs_zscore": (lambda: f.cs_zscore(C()), "(close - avg(close) OVER (PARTITION BY date)) / (stddev_samp(close) OVER (PARTITION BY date) + 1e-12)"),
    "w23_cs_demean": (lambda: f.cs_demean(C()), "close - avg(close) OVER (PARTITION BY date)"),
    "w29_quantile": (lambda: f.quantile(C(), D, 0.8) / C(), filled(f"quantile_cont(close, 0.8) {frame(D)}", "close", D) + " / close"),
    "w33_up_share": (lambda: F.when(F.count("*").over(f.by_code(D)) == D, F.avg(F.coalesce((C() > f.ref(C(), 1)).cast("double"), F.lit(0.0))).over(f.by_code(D))), None),
    "w48_worst_next": (lambda: F.when(F.count("close").over(f.by_code().rowsBetween(1, 20)) == 20, F.min("close").over(f.by_code().rowsBetween(1, 20))) / C() - 1, "CASE WHEN count(close) OVER z = 20 THEN min(close) OVER z END / close - 1"),
    "w42_forward": (lambda: f.safe_div(F.lead("open", 6).over(f.by_code()), F.lead("open", 1).over(f.by_code())) - 1, f"lead(open, 6) {LAGS} / lead(open, 1) {LAGS} - 1"),
    "w51_previous_close": (lambda: F.last("close", ignorenulls=True).over(f.by_code().rowsBetween(Window_FIRST, -1)), "last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    "w50_liquidity": (lambda: F.when(F.count("value").over(f.by_code(26)) >= 15, F.percentile("value", 0.5).over(f.by_code(26))), f"CASE WHEN count(value) {frame(26)} >= 15 THEN quantile_cont(value, 0.5) {frame(26)} END"),
    "w52_centred_max": (lambda: F.max((f.pct(C(), 1) > 0.5).cast("double")).over(f.by_code().rowsBetween(-10, 10)), None),
    "f1_safe_div": (lambda: f.safe_div(C(), F.col("open") - C()), "CASE WHEN abs(open - close) > 1e-12 THEN close / (open - close) END"),
    "f3_signed_log_sqrt": (lambda: f.signed_log(C() - F.col("open")) + f.signed_sqrt(C() - F.col("open")), "sign(close - open) * ln(1 + abs(close - open)) + sign(close - open) * sqrt(abs(close - open))"),
    "f4_max_min": (lambda: f.larger(C(), f.ref(C(), 1)) - f.smaller(C(), f.ref(C(), 1)), f"CASE WHEN close IS NOT NULL AND lag(close, 1) {LAGS} IS NOT NULL THEN greatest(close, lag(close, 1) {LAGS}) - least(close, lag(close, 1) {LAGS}) END"),
    "w24_candle": (lambda: (2 * C() - F.col("high") - F.col("low")) / (F.col("high") - F.col("low") + 1e-12), "(2 * close - high - low) / (high - low + 1e-12)"),
    "w25_open_ratio": (lambda: F.col("open") / C(), "open / close"),
    "w26_roc": (lambda: f.ref(C(), 5) / C(), f"lag(close, 5) {LAGS} / close"),
    "w30_rsv": (lambda: (C() - f.ts_min(F.col("low"), D)) / (f.ts_max(F.col("high"), D) - f.ts_min(F.col("low"), D) + 1e-12), f"(close - {filled(w('min', 'low', D), 'low', D)}) / ({filled(w('max', 'high', D), 'high', D)} - {filled(w('min', 'low', D), 'low', D)} + 1e-12)"),
    "w35_vma": (lambda: f.mean(V(), D) / (V() + 1e-12), f"({filled(w('avg', 'volume', D), 'volume', D)}) / (volume + 1e-12)"),
    "p5_suspended": (lambda: (F.coalesce(V(), F.lit(0.0)) <= 0).cast("double"), "CASE WHEN coalesce(volume, 0) <= 0 THEN 1.0 ELSE 0.0 END"),
    "d3_nested": (lambda: f.factor(("Mean", ("Mean", "close", 3), 4)), None),
}
Window_FIRST = -(1 << 31)


def _sql(e: str) -> str:
    z = " WINDOW z AS (PARTITION BY code ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)" if " OVER z" in e else ""
    return f"{WITH} SELECT date, code, round(CAST(v AS DOUBLE) + 1e-9, 6) + 0.0 AS v FROM (SELECT date, code, {e} AS v FROM dense{z})"


def _query(e):
    return lambda spark, d: p.dense_bars(spark, d).select("date", "code", (F.round(e().cast("double") + 1e-9, 6) + 0.0).alias("v"))


QUERIES = {k: _query(e) for k, (e, _) in EXPRESSIONS.items()}
SQL = {k: _sql(s) for k, (_, s) in EXPRESSIONS.items() if s}
SQL["w33_up_share"] = f"""{WITH} SELECT date, code, round(CASE WHEN count(*) {frame(D)} = {D} THEN {w("avg", "up", D)} END + 1e-9, 6) AS v FROM (SELECT *, CASE WHEN coalesce(close > lag(close, 1) {LAGS}, false) THEN 1.0 ELSE 0.0 END AS up FROM dense)"""
SQL["w52_centred_max"] = f"""{WITH} SELECT date, code, round(max(CASE WHEN r IS NULL THEN NULL WHEN r > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY code ORDER BY t ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) + 1e-9, 6) AS v FROM (SELECT *, close / lag(close, 1) {LAGS} - 1 AS r FROM dense)"""
SQL["d3_nested"] = f"""{WITH} SELECT date, code, round({filled(w("avg", "m", 4), "m", 4)} + 1e-9, 6) AS v FROM (SELECT *, {filled(w("avg", "close", 3), "close", 3)} AS m FROM dense)"""
