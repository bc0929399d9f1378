"""Factor language: element-wise, per-code time-series and cross-sectional operators as Columns.

A panel is long: one row for each (date, code) with t, the number of the calendar row. Windows count calendar rows, so
the panel is dense. A missing value in a window makes the result null, and division by almost nothing is null.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TINY = 1e-12


def by_code(d: int | None = None):
    w = Window.partitionBy("code").orderBy("t")
    return w if d is None else w.rowsBetween(-(d - 1), 0)


def by_date(x: Column | None = None):
    """The rows of a day; with x, those that have it (or lack it)."""
    return Window.partitionBy("date") if x is None else Window.partitionBy("date", x.isNull())


def safe_div(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) > TINY, a / b)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_sqrt(x: Column) -> Column:
    return F.signum(x) * F.sqrt(F.abs(x))


def larger(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def smaller(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def full(e: Column, x: Column, d: int) -> Column:
    """e where the window of d rows has d values of x."""
    return F.when(F.count(x).over(by_code(d)) == d, e)


def ref(x: Column, d: int) -> Column:
    return F.lag(x, d).over(by_code())


def delta(x: Column, d: int) -> Column:
    return x - ref(x, d)


def pct(x: Column, d: int) -> Column:
    return safe_div(x, ref(x, d)) - 1


def mean(x: Column, d: int) -> Column:
    return full(F.avg(x).over(by_code(d)), x, d)


def total(x: Column, d: int) -> Column:
    return full(F.sum(x).over(by_code(d)), x, d)


def std(x: Column, d: int) -> Column:
    return full(F.stddev_samp(x).over(by_code(d)), x, d)


def ts_max(x: Column, d: int) -> Column:
    return full(F.max(x).over(by_code(d)), x, d)


def ts_min(x: Column, d: int) -> Column:
    return full(F.min(x).over(by_code(d)), x, d)


def quantile(x: Column, d: int, q: float) -> Column:
    return full(F.percentile(x, q).over(by_code(d)), x, d)


def _list(x: Column, d: int) -> Column:
    return F.collect_list(x).over(by_code(d))


def ts_rank(x: Column, d: int) -> Column:
    below, same = F.filter(_list(x, d), lambda v: v < x), F.filter(_list(x, d), lambda v: v == x)
    return full((F.size(below) + (F.size(same) + 1) / 2) / d, x, d)


def skew(x: Column, d: int) -> Column:
    g = F.skewness(x).over(by_code(d)) * ((d * (d - 1)) ** 0.5 / (d - 2))
    return full(F.when(F.var_pop(x).over(by_code(d)) > TINY, g), x, d)


def kurt(x: Column, d: int) -> Column:
    g = ((d + 1) * F.kurtosis(x).over(by_code(d)) + 6) * ((d - 1) / ((d - 2) * (d - 3)))
    return full(F.when(F.var_pop(x).over(by_code(d)) > TINY, g), x, d)


def decay(x: Column, d: int) -> Column:
    """Linear weights, the newest heaviest; any gap makes it null."""
    out = d * x
    for k in range(1, d):
        out = out + (d - k) * ref(x, k)
    return out / (d * (d + 1) / 2)


def slope(x: Column, d: int) -> Column:
    return full(F.regr_slope(x, F.col("t").cast("double")).over(by_code(d)), x, d)


def rsquare(x: Column, d: int) -> Column:
    spread = F.var_pop(x).over(by_code(d)) * d
    return 1 - (spread - F.pow(slope(x, d), 2) * (d * (d * d - 1) / 12)) / (spread + TINY)


def resi(x: Column, d: int) -> Column:
    return x - (mean(x, d) + slope(x, d) * ((d - 1) / 2))


def idx_max(x: Column, d: int) -> Column:
    return full((d - F.array_position(_list(x, d), F.max(x).over(by_code(d)))) / d, x, d)


def idx_min(x: Column, d: int) -> Column:
    return full((d - F.array_position(_list(x, d), F.min(x).over(by_code(d)))) / d, x, d)


def cov(x: Column, y: Column, d: int) -> Column:
    both = x * y
    a = lambda e: F.avg(e).over(by_code(d))
    return full(a(both) - a(x) * a(y), both, d)


def corr(x: Column, y: Column, d: int) -> Column:
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    a = lambda e: F.avg(e).over(by_code(d))
    va, vb = a(x * x) - a(x) * a(x), a(y * y) - a(y) * a(y)
    return full((a(x * y) - a(x) * a(y)) / F.sqrt(F.greatest(va * vb, F.lit(TINY))), both, d)


def avg_rank(x: Column) -> Column:
    """Average rank among the day's values; null where x is."""
    ties = F.count("*").over(Window.partitionBy("date", x))
    return F.when(x.isNotNull(), F.rank().over(by_date(x).orderBy(x)) + (ties - 1) / 2)


def cs_rank(x: Column) -> Column:
    return avg_rank(x) / F.count(x).over(by_date())


def cs_zscore(x: Column) -> Column:
    return (x - F.avg(x).over(by_date())) / (F.stddev_samp(x).over(by_date()) + TINY)


def cs_demean(x: Column) -> Column:
    return x - F.avg(x).over(by_date())


def ema(x: Column, d: int) -> Column:
    """Exponential mean of span d, from d values on. Gaps let the old weight decay. The frame of 20 d rows holds all but a share of e**-40 of the weights."""
    alpha = 2 / (d + 1)
    rows = F.collect_list(F.struct(x.alias("x"))).over(by_code(20 * d + 1))
    start = F.struct(F.lit(None).cast("double").alias("m"), F.lit(1.0).alias("w"))

    def step(a: Column, s: Column) -> Column:
        old = a["w"] * (1 - alpha)
        mixed = (old * a["m"] + alpha * s["x"]) / (old + alpha)
        m = F.when(a["m"].isNull(), s["x"]).when(s["x"].isNull(), a["m"]).otherwise(mixed)
        w = F.when(a["m"].isNotNull() & s["x"].isNull(), old).otherwise(1.0)
        return F.struct(m.alias("m"), w.alias("w"))

    seen = F.count(x).over(Window.partitionBy("code").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return F.when(seen >= d, F.aggregate(rows, start, step)["m"])


#: Name, function, number of series, whether it takes a window, and the least window.
OPERATORS = {
    "Abs": (F.abs, 1, False, 0), "Sign": (F.signum, 1, False, 0), "Log": (signed_log, 1, False, 0), "Sqrt": (signed_sqrt, 1, False, 0), "Max": (larger, 2, False, 0), "Min": (smaller, 2, False, 0),
    "Ref": (ref, 1, True, 1), "Delta": (delta, 1, True, 1), "Pct": (pct, 1, True, 1), "Mean": (mean, 1, True, 2), "Sum": (total, 1, True, 2), "Std": (std, 1, True, 2), "TsMax": (ts_max, 1, True, 2), "TsMin": (ts_min, 1, True, 2),
    "TsRank": (ts_rank, 1, True, 3), "Skew": (skew, 1, True, 5), "Kurt": (kurt, 1, True, 5), "Decay": (decay, 1, True, 2), "Slope": (slope, 1, True, 3), "Rsquare": (rsquare, 1, True, 3), "Resi": (resi, 1, True, 3),
    "IdxMax": (idx_max, 1, True, 2), "IdxMin": (idx_min, 1, True, 2), "Corr": (corr, 2, True, 3), "Cov": (cov, 2, True, 3), "EMA": (ema, 1, True, 1), "CsRank": (cs_rank, 1, False, 0), "CsZscore": (cs_zscore, 1, False, 0), "CsDemean": (cs_demean, 1, False, 0),
}
#: Bounds of a factor.
MAX_NODES, MAX_DEPTH, MAX_LOOKBACK, MAX_WINDOW = 30, 8, 120, 60


def spec_size(spec) -> tuple[int, int, int]:
    """Nodes, depth and lookback of a factor spec: a field name, a number or (operator, arguments..., window)."""
    if isinstance(spec, str | int | float):
        return 1, 1, 0
    name, *rest = spec
    _, n, windowed, least = OPERATORS[name]
    window = rest[-1] if windowed else 0
    if len(rest) != n + windowed or windowed and not max(1, least) <= window <= MAX_WINDOW:
        raise ValueError(f"bad arguments of {name}")
    parts = [spec_size(x) for x in rest[:n]]
    return 1 + sum(p[0] for p in parts), 1 + max(p[1] for p in parts), window + max(p[2] for p in parts)


def factor(spec) -> Column:
    """The Column of a nested factor spec, after a check of its bounds."""
    nodes, depth, lookback = spec_size(spec)
    if nodes > MAX_NODES or depth > MAX_DEPTH or lookback > MAX_LOOKBACK:
        raise ValueError("factor is too large")

    def build(s) -> Column:
        if isinstance(s, str):
            return F.col(s)
        if isinstance(s, int | float):
            return F.lit(float(s))
        fn, n, windowed, _ = OPERATORS[s[0]]
        return fn(*(build(x) for x in s[1 : n + 1]), *([s[-1]] if windowed else []))

    return build(spec)
