"""The fixed set of 158 features of a dense panel: candle shapes, price ratios and 29 rolling features for each window."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.functions import factors as f
from crosspanel.operators import wide

#: Windows of the feature set.
WINDOWS = (5, 10, 20, 30, 60)
INF = float("inf")


def _rise(a: Column, b: Column) -> Column:
    return F.when((a - b).isNotNull(), F.greatest(a - b, F.lit(0.0)))


def prepared(panel: DataFrame) -> DataFrame:
    """The panel with the columns that several features share. Zero volume is missing."""
    c, v = F.col("close"), F.col("v")
    x = panel.withColumn("v", F.when(F.col("volume") > 0, F.col("volume")))
    x = x.withColumns({"c1": f.ref(c, 1), "v1": f.ref(v, 1)})
    c1, v1 = F.col("c1"), F.col("v1")
    up, down = F.coalesce(c > c1, F.lit(False)), F.coalesce(c < c1, F.lit(False))
    return x.withColumns({"up": _rise(c, c1), "dn": _rise(c1, c), "vup": _rise(v, v1), "vdn": _rise(v1, v), "rel": f.safe_div(c, c1), "lv": F.log(v + 1), "lvc": F.log(f.safe_div(v, v1) + 1), "wv": F.abs(f.safe_div(c, c1) - 1) * v, "cup": up.cast("double"), "cdn": down.cast("double")})


def shapes(o, h, lo, c, vwap, greatest, least) -> dict:
    """The shapes of columns or of arrays."""
    top, bottom, span = greatest(o, c), least(o, c), h - lo + f.TINY
    return {
        "kmid": (c - o) / o, "klen": (h - lo) / o, "kmid2": (c - o) / span, "kup": (h - top) / o, "kup2": (h - top) / span, "klow": (bottom - lo) / o, "klow2": (bottom - lo) / span, "ksft": (2 * c - h - lo) / o, "ksft2": (2 * c - h - lo) / span,
        "open0": o / c, "high0": h / c, "low0": lo / c, "vwap0": vwap / c,
    }


def candles() -> dict[str, Column]:
    return shapes(*(F.col(x) for x in PRICES), F.greatest, F.least)


def _place(x: Column, d: int, gap: float, extreme) -> Column:
    """Rows from the start of the window to its first extreme; a gap counts as one."""
    seen = F.collect_list(F.coalesce(x, F.lit(gap))).over(f.by_code(d))
    return F.when(F.size(seen) == d, F.array_position(seen, extreme(seen)) - 1)


def rolling(d: int) -> dict[str, Column]:
    """The 29 features of one window over a prepared panel."""
    c, v = F.col("close"), F.col("v")
    high, low = f.ts_max(F.col("high"), d), f.ts_min(F.col("low"), d)
    first, last = _place(F.col("high"), d, INF, F.array_max), _place(F.col("low"), d, -INF, F.array_min)
    share = lambda name: F.when(F.count("*").over(f.by_code(d)) == d, F.avg(name).over(f.by_code(d)))
    su, sd, vu, vd = (f.total(F.col(k), d) for k in ("up", "dn", "vup", "vdn"))
    sa, va = su + sd + f.TINY, vu + vd + f.TINY
    return {
        "roc": f.ref(c, d) / c, "ma": f.mean(c, d) / c, "std": f.std(c, d) / c, "beta": f.slope(c, d) / c, "rsqr": f.rsquare(c, d), "resi": f.resi(c, d) / c, "max": high / c, "min": low / c,
        "qtlu": f.quantile(c, d, 0.8) / c, "qtld": f.quantile(c, d, 0.2) / c, "rank": f.ts_rank(c, d), "rsv": (c - low) / (high - low + f.TINY), "imax": first / d, "imin": last / d, "imxd": (first - last) / d,
        "corr": f.corr(c, F.col("lv"), d), "cord": f.corr(F.col("rel"), F.col("lvc"), d), "cntp": share("cup"), "cntn": share("cdn"), "cntd": share("cup") - share("cdn"), "sump": su / sa, "sumn": sd / sa, "sumd": (su - sd) / sa,
        "vma": f.mean(v, d) / (v + f.TINY), "vstd": f.std(v, d) / (v + f.TINY), "wvma": f.std(F.col("wv"), d) / (f.mean(F.col("wv"), d) + f.TINY), "vsump": vu / va, "vsumn": vd / va, "vsumd": (vu - vd) / va,
    }


def rolled(panel: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """The dense panel with the features that `rolling` defines, in numpy blocks: f"{feature}{window}"."""
    return wide.rolling(panel, windows, FAMILY, f.TINY)


def matrix(panel: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """date, code and all features as 32-bit numbers, of the rows that have a bar; none is infinite."""
    made = candles() | {k: F.col(k) for k in names(windows) if k not in SHAPES}
    out = rolled(panel, windows).where("close is not null").select("date", "code", *(e.cast("double").alias(k) for k, e in made.items()))
    return wide.finite(out, list(made))


def bar_features(weeks: int, windows: tuple[int, ...] = WINDOWS):
    """For `blocks.by_day`: the features of `matrix` as arrays, from a batch of bars of whole codes on a calendar of so many weeks."""

    def make(column, place):
        with np.errstate(all="ignore"):
            yield from shapes(*(column(x) for x in PRICES), np.fmax, np.fmin).items()
            yield from wide.rolling_bars(column, place, weeks, windows, FAMILY, f.TINY)

    return make


def names(windows: tuple[int, ...] = WINDOWS) -> list[str]:
    """The features of `matrix` in order."""
    return [*SHAPES, *(f"{k}{d}" for d in windows for k in (*(n for n in FAMILY if n not in wide.ORDERED), *wide.ORDERED))]


PRICES = ("open", "high", "low", "close", "vwap")
#: The shapes of a day, and the 29 features of a window.
SHAPES = tuple("kmid klen kmid2 kup kup2 klow klow2 ksft ksft2 open0 high0 low0 vwap0".split())
FAMILY = tuple(
    "roc ma std beta rsqr resi max min qtlu qtld rank rsv imax imin imxd corr cord cntp cntn cntd sump sumn sumd vma vstd wvma vsump vsumn vsumd".split()
)
