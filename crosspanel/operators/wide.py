"""Work on many features at once: whole windows of a code, whole days of names, as numpy blocks inside Spark's groups.

A code has a row a date and a date a row a name, so a group is never larger than the calendar or the list of names.
Codes pass through a task in batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

ORDERED = ("qtlu", "qtld", "rank", "imax", "imin", "imxd")


def column_of(t: pa.Table):
    """The numbers of a column of `t` by its name, missing ones NaN."""
    return lambda n: t[n].cast(pa.float64()).to_numpy()


def place_of(keys: np.ndarray) -> np.ndarray:
    """Each row's place in its key, whose rows stand together."""
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return np.arange(len(keys)) - np.repeat(begin, np.diff(np.append(begin, len(keys))))


def whole_keys(batches, by: str, least: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole keys, which stand together in `batches`, of `least` rows or more but for the last, and the keys of their rows."""
    rest, rows = [], 0
    for b in batches:
        rest, rows = [*rest, b], rows + b.num_rows
        if rows < least or not b.num_rows:
            continue
        t = pa.Table.from_batches(rest)
        keys = np.array(t[by].to_pylist(), object)
        cuts = np.flatnonzero(keys[1:] != keys[:-1])
        whole = int(cuts[-1]) + 1 if len(cuts) else 0
        if whole:
            yield t.slice(0, whole), keys[:whole]
        rest, rows = t.slice(whole).combine_chunks().to_batches(), len(t) - whole
    if rows:
        t = pa.Table.from_batches(rest)
        yield t, np.array(t[by].to_pylist(), object)


def _by_key(x: DataFrame, by: str, order: str, made: Sequence[str], make, keep: Sequence[str] | None = None) -> DataFrame:
    """`x` (of its columns only `keep`, if given) with the columns `made`, which `make` fills from batches of whole keys: its arguments are the columns by name, missing values NaN, and each row's place in its key. Keys are sorted in their
    partitions and pass through a task in batches, so a task holds a batch and the rest of one key."""
    names = x.columns if keep is None else list(keep)
    schema = StructType([*(x.schema[n] for n in names), *(StructField(n, DoubleType()) for n in made)])

    def filled(t: pa.Table, keys: np.ndarray) -> pa.RecordBatch:
        t = t.combine_chunks()
        out = make(column_of(t), place_of(keys))
        return pa.RecordBatch.from_arrays([*(t[n].chunk(0) for n in names), *(pa.array(out[n], pa.float64(), from_pandas=True) for n in made)], names=[*names, *made])

    def run(batches):
        for t, keys in whole_keys(batches, by):
            yield filled(t, keys)

    return x.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


def _before(v: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(v), np.nan)
    out[k:] = v[: len(v) - k] if k < len(v) else out[k:]
    out[place < k] = np.nan
    return out


def _folded(v: np.ndarray, d: int, op) -> np.ndarray:
    """op over all windows of d values, put together from windows of 1, 2, 4 ... values: no difference of large sums is taken, and a NaN reaches only the windows that hold it."""
    n, out, at, power, span = len(v) - d + 1, None, 0, v, 1
    while True:
        if d & span:
            piece = power[at : at + n]
            out, at = piece if out is None else op(out, piece), at + span
        if 2 * span > d:
            return out
        power, span = op(power[: len(power) - span], power[span:]), 2 * span


def _placed(values: np.ndarray, place: np.ndarray, d: int) -> np.ndarray:
    """Values of windows at their last rows; NaN where a window would reach into another key."""
    out = np.full(len(place), np.nan)
    out[d - 1 :] = values
    out[place < d - 1] = np.nan
    return out


def _ordered(close, high, low, place: np.ndarray, d: int) -> dict[str, np.ndarray]:
    if len(place) < d:
        return {k: np.full(len(place), np.nan) for k in ORDERED}
    put = lambda x: _placed(x, place, d)
    v, last = sliding_window_view(close, d), close[d - 1 :, None]
    ranked, out = np.sort(v, 1), {}
    gap = np.isnan(ranked[:, -1])  # NaN is last
    for k, q in (("qtlu", 0.8), ("qtld", 0.2)):
        at = q * (d - 1)
        below = int(at)
        got = ranked[:, below] + (at - below) * (ranked[:, min(below + 1, d - 1)] - ranked[:, below])
        out[k] = put(np.where(gap, np.nan, got))
    out["rank"] = put(np.where(gap, np.nan, (np.count_nonzero(v < last, 1) + (np.count_nonzero(v == last, 1) + 1) / 2) / d))
    high, low = np.where(np.isnan(high), np.inf, high), np.where(np.isnan(low), -np.inf, low)
    out["imax"] = put(sliding_window_view(high, d).argmax(1) / d)
    out["imin"] = put(sliding_window_view(low, d).argmin(1) / d)
    return out | {"imxd": out["imax"] - out["imin"]}


def order_statistics(panel: DataFrame, windows: Sequence[int], by: str = "code", order: str = "t") -> DataFrame:
    """`panel` with six features a window that depend on the order of the window's values: its 0.8 and 0.2 quantiles and the place of today's value (of closes; null unless all are there), and how
    far into the window its highest high and lowest low stand (first ones; a gap counts as one). The rows of a code are sorted once for all windows and features."""

    def make(column, place):
        close, high, low = column("close"), column("high"), column("low")
        return {f"{k}{d}": v for d in windows for k, v in _ordered(close, high, low, place, d).items()}

    return _by_key(panel, by, order, [f"{k}{d}" for d in windows for k in ORDERED], make)


def framed(panel: DataFrame, column: str, d: int, own, name: str = "v", by: str = "code", order: str = "t") -> DataFrame:
    """`panel` with `name`, an own function of the last d values of `column`: `own` gets a block of windows, one a row, and gives a value for each. Null where a window lacks a value."""

    def make(values, place):
        x = values(column)
        if len(x) < d:
            return {name: np.full(len(x), np.nan)}
        block = sliding_window_view(x, d)
        return {name: _placed(np.where(np.isnan(block).any(1), np.nan, own(block)), place, d)}

    return _by_key(panel, by, order, [name], make)


def ema(panel: DataFrame, column: str, d: int, name: str = "v", by: str = "code", order: str = "t") -> DataFrame:
    """`panel` with `name`, the exponential mean of span d of `column`, from d values on; gaps let the old weight decay. A step a row, where `factors.ema` folds 20 d rows for each."""

    def make(values, place):
        x, begin = values(column), np.flatnonzero(place == 0)
        out = [pd.Series(part).ewm(span=d, adjust=False, min_periods=d).mean().to_numpy() for part in np.split(x, begin[1:])]
        return {name: np.concatenate(out)}

    return _by_key(panel, by, order, [name], make)


def _rolling(c, high, low, v, c1, v1, t, place: np.ndarray, windows: Sequence[int], family: Sequence[str], tiny: float) -> dict[str, np.ndarray]:
    """The features of each window of rows; c1 and v1 are what the row before had, t the rows' places on the calendar (None: one after the other)."""
    ratio = lambda a, b: a / np.where(np.abs(b) > tiny, b, np.nan)
    rel, lv = ratio(c, c1), np.log(v + 1)
    lvc, wv = np.log(ratio(v, v1) + 1), np.abs(rel - 1) * v
    made = {}
    for d in windows:
        if len(place) < d:
            made |= {f"{k}{d}": np.full(len(place), np.nan) for k in family}
            continue
        put = lambda x, d=d: _placed(x, place, d)
        total = lambda x, d=d: _folded(x, d, np.add)
        mean = lambda x, d=d: _folded(x, d, np.add) / d
        off = lambda x, d=d: sliding_window_view(x, d) - mean(x, d)[:, None]
        spread = lambda a: np.einsum("ij,ij->i", a, a)
        std = lambda x, d=d: np.sqrt(spread(off(x, d)) / (d - 1))

        def corr(x, y):
            mx, my = mean(x), mean(y)
            va, vb = mean(x * x) - mx * mx, mean(y * y) - my * my
            return put((mean(x * y) - mx * my) / np.sqrt(np.maximum(va * vb, tiny)))

        def slopes(around, d=d):
            if t is None:
                steps = np.arange(d) - (d - 1) / 2
                return around @ steps / (steps @ steps)
            steps = off(t)
            return np.einsum("ij,ij->i", around, steps) / spread(steps)

        around = off(c)
        squares, slope = spread(around), slopes(around)
        ma, top, bottom = put(mean(c)), put(_folded(high, d, np.maximum)), put(_folded(low, d, np.minimum))
        su, sd, vu, vd = (put(total(np.maximum(x, 0))) for x in (c - c1, c1 - c, v - v1, v1 - v))
        sa, va = su + sd + tiny, vu + vd + tiny
        up, down = put(mean((c > c1).astype(float))), put(mean((c < c1).astype(float)))
        out = _ordered(c, high, low, place, d)
        out |= {
            "roc": _before(c, place, d) / c, "ma": ma / c, "std": put(np.sqrt(squares / (d - 1))) / c, "beta": put(slope) / c, "rsqr": put(1 - (squares - slope**2 * (d * (d * d - 1) / 12)) / (squares + tiny)),
            "resi": (c - (ma + put(slope) * ((d - 1) / 2))) / c, "max": top / c, "min": bottom / c, "qtlu": out["qtlu"] / c, "qtld": out["qtld"] / c, "rsv": (c - bottom) / (top - bottom + tiny),
            "corr": corr(c, lv), "cord": corr(rel, lvc), "cntp": up, "cntn": down, "cntd": up - down, "sump": su / sa, "sumn": sd / sa, "sumd": (su - sd) / sa,
            "vma": put(mean(v)) / (v + tiny), "vstd": put(std(v)) / (v + tiny), "wvma": put(std(wv)) / (put(mean(wv)) + tiny), "vsump": vu / va, "vsumn": vd / va, "vsumd": (vu - vd) / va,
        }
        made |= {f"{k}{d}": out[k] for k in family}
    return made


def rolling(panel: DataFrame, windows: Sequence[int], family: Sequence[str], tiny: float, by: str = "code", order: str = "t") -> DataFrame:
    """`panel` (dense: a row for each calendar row) with the features `family` of each window, as `features.rolling` defines them: f"{feature}{window}". All windows of a batch of codes are numpy blocks."""

    def make(column, place):
        c, high, low, v = (column(n) for n in ("close", "high", "low", "volume"))
        v = np.where(v > 0, v, np.nan)
        return _rolling(c, high, low, v, _before(c, place, 1), _before(v, place, 1), None, place, windows, family, tiny)

    return _by_key(panel, by, order, [f"{k}{d}" for d in windows for k in family], make)


def _nearest(v: np.ndarray, digits: int) -> np.ndarray:
    """`v` rounded, halves away from zero, by a product and a quotient."""
    y = v * 10.0**digits
    r = np.rint(y)
    with np.errstate(invalid="ignore"):
        return np.where(np.abs(y - r) == 0.5, y + np.copysign(0.5, y), r) / 10.0**digits


def rolling_bars(column, place: np.ndarray, weeks: int, windows: Sequence[int], family: Sequence[str], tiny: float, order: str = "t") -> Iterator[tuple[str, np.ndarray]]:
    """What `rolling` makes of the rows that are there, where the weeks that lack one are no rows: `order` is a row's week, from 1, of so many. One window at a time, so no more is held."""
    spot = (np.cumsum(place == 0) - 1) * weeks + column(order).astype(int) - 1
    among = np.tile(np.arange(weeks), np.count_nonzero(place == 0))

    def dense(v):
        out = np.full(len(among), np.nan)
        out[spot] = v
        return out

    c, high, low, v = (dense(column(n)) for n in ("close", "high", "low", "volume"))
    v = np.where(v > 0, v, np.nan)
    c1, v1 = _before(c, among, 1), _before(v, among, 1)
    for d in windows:
        for k, x in _rolling(c, high, low, v, c1, v1, None, among, (d,), family, tiny).items():
            yield k, x[spot]


def last_rows(windows: Sequence[int], family: Sequence[str], tiny: float, also: Sequence[str], digits: int, order: str = "t"):
    """What `rolling_rows` fills a batch of whole keys with."""
    names = [f"{k}{d}" for d in windows for k in family]

    def make(column, place):
        c, high, low, v, t = (column(n) for n in ("close", "high", "low", "volume", order))
        v = np.where(v > 0, v, np.nan)
        near = _before(t, place, 1) == t - 1
        c1, v1 = (np.where(near, _before(x, place, 1), np.nan) for x in (c, v))
        there = ~np.isnan(c)
        key = np.cumsum(place == 0)[there]
        begin = np.flatnonzero(np.diff(key, prepend=0))
        among = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
        made = _rolling(*(x[there] for x in (c, high, low, v, c1, v1, t)), among, windows, family, tiny)
        out = {k: _nearest(column(k), digits) for k in also} | {k: np.full(len(c), np.nan) for k in names}
        for k in names:
            out[k][there] = _nearest(made[k], digits)
        return out

    return make


def rolling_rows(panel: DataFrame, windows: Sequence[int], family: Sequence[str], tiny: float, keep: Sequence[str], also: Sequence[str], digits: int, by: str = "code", order: str = "t") -> DataFrame:
    """The columns `keep` of `panel` (any rows, `order` their places on the calendar), and rounded the columns `also` and the features `family` over the last rows that have a close, however far apart; a
    change is one from the calendar row before, missing where that is. As `features.rolling` over the rows of a prepared dense panel that have a close; null on others."""
    names = [f"{k}{d}" for d in windows for k in family]
    return _by_key(panel, by, order, [*also, *names], last_rows(windows, family, tiny, also, digits, order), keep)


def totals(x: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, n, mean and most of the columns `features` as 32-bit numbers, over values that are not infinite; none of a feature without values. A batch gives a row a feature, so no row is made for a
    feature and a name."""
    features = list(features)

    def run(batches):
        for b in batches:
            rows = []
            for f in features:
                v = b.column(b.schema.get_field_index(f)).cast(pa.float64()).to_numpy(zero_copy_only=False)
                v = v[~np.isnan(v)]
                some = v[np.isfinite(v)].astype(np.float32).astype(float)
                if len(v):
                    rows.append((f, len(some), some.sum() if len(some) else None, some.max() if len(some) else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.float64(), pa.float64()))], names=["feature", "n", "total", "most"])

    parts = x.select(*features).mapInArrow(run, "feature string, n long, total double, most double")
    n = F.sum("n")
    return parts.groupBy("feature").agg(n.alias("n"), F.when(n > 0, F.sum("total") / n).alias("mean"), F.max("most").alias("most"))


def _average_ranks(v: np.ndarray) -> np.ndarray:
    """The rank of each value among those that are there, ties in the middle; NaN where it is NaN."""
    order = np.argsort(v, kind="stable")  # NaN is last
    n = len(v) - np.count_nonzero(np.isnan(v))
    s = v[order[:n]]
    begin = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    size = np.diff(np.append(begin, n))
    out = np.full(len(v), np.nan)
    out[order[:n]] = np.repeat(begin + (size + 1) / 2, size)
    return out


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t[name].cast(pa.float64()).to_numpy()


def _median(v: np.ndarray) -> float:
    v = np.sort(v[~np.isnan(v)])
    return 0.5 * v[(len(v) - 1) // 2] + 0.5 * v[len(v) // 2] if len(v) else np.nan


def day_ranks(x: DataFrame, features: Sequence[str], by: str = "date", key: str = "code", keep: Sequence[str] = (), middle: Sequence[str] = ()) -> DataFrame:
    """by, key, the columns `keep` and for each feature the average rank among the day's values over their number, less one half; null where the feature is. Of each column of `keep` in `middle` the
    day's median comes along, as f"{column}_median". A day is ranked in one go, one column of numbers at a time."""
    features, kept, middle = list(features), [by, key, *keep], list(middle)

    def one(t: pa.Table) -> pa.Table:
        made = []
        for f in features:
            rank = _average_ranks(_numbers(t, f))
            made.append(pa.array(rank / np.count_nonzero(~np.isnan(rank)) - 0.5, from_pandas=True))
        made += [pa.array(np.full(len(t), _median(_numbers(t, n))), from_pandas=True) for n in middle]
        return pa.table([*(t[n] for n in kept), *made], names=names)

    x = x.select(*kept, *features)
    names = [*kept, *features, *(f"{n}_median" for n in middle)]
    return x.groupBy(by).applyInArrow(one, StructType([*(x.schema[n] for n in kept), *(StructField(n, DoubleType()) for n in names[len(kept) :])]))


def day_places(x: DataFrame, value: str, by: str = "date", key: str = "code") -> DataFrame:
    """`x` with the day's p (the average rank of `value` over their number), position (from 1, the largest value first, equal ones by key) and n (the day's rows)."""
    schema = StructType([*x.schema.fields, StructField("p", DoubleType()), StructField("position", IntegerType()), StructField("n", LongType())])

    def one(t: pa.Table) -> pa.Table:
        v = _numbers(t, value)
        rank = _average_ranks(v)
        position = np.empty(len(v), np.int32)
        position[np.lexsort((t[key].to_numpy(), -v))] = np.arange(1, len(v) + 1)
        p = pa.array(rank / np.count_nonzero(~np.isnan(rank)), from_pandas=True)
        return pa.table([*t.columns, p, pa.array(position), pa.array(np.full(len(v), len(v)))], names=schema.names)

    return x.groupBy(by).applyInArrow(one, schema)


def paired_ranks(x: DataFrame, features: Sequence[str], target: str, least: int, by: str = "date", key: str = "code") -> DataFrame:
    """by, key, factor, the target, rx and rw (average ranks of the feature and of the target among the day's names that have both) and n, the number of such names: a row for each feature and name,
    where there are `least`."""
    features = list(features)
    kept = [x.schema[n] for n in (by, key)]
    numbers = [StructField(n, DoubleType()) for n in (target, "rx", "rw")]
    schema = StructType([*kept, StructField("factor", StringType()), *numbers, StructField("n", LongType())])
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema}

    def one(t: pa.Table) -> pa.Table:
        r, parts = _numbers(t, target), []
        for f in features:
            v = _numbers(t, f)
            both = np.flatnonzero(~np.isnan(v) & ~np.isnan(r))
            n = len(both)
            if n >= least:
                made = (r[both], _average_ranks(v[both]), _average_ranks(r[both]), np.full(n, n))
                parts.append(pa.table([*(t[k.name].take(pa.array(both)) for k in kept), pa.repeat(f, n), *map(pa.array, made)], names=list(kinds)))
        return pa.concat_tables(parts) if parts else pa.schema(kinds.items()).empty_table()

    return x.select(by, key, target, *features).groupBy(by).applyInArrow(one, schema)


def ranks_within(x: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`x` with `columns` replaced by their average ranks among the rows of `by`."""
    schema = StructType([StructField(f.name, DoubleType()) if f.name in set(columns) else f for f in x.schema])

    def one(t: pa.Table) -> pa.Table:
        for c in columns:
            t = t.set_column(t.schema.get_field_index(c), c, pa.array(_average_ranks(_numbers(t, c)), from_pandas=True))
        return t

    return x.groupBy(*by).applyInArrow(one, schema)


def rounded(c: Column, digits: int) -> Column:
    """`c` and a billionth, rounded as SQL's round does, by a product and a quotient: Spark's own goes by the decimal text of each number. For numbers that are finite, and no tie once the billionth is added."""
    scale = 10.0**digits
    return F.rint((c.cast("double") + 1e-9) * scale) / scale + 0.0


def day_coefficients(x: DataFrame, features: Sequence[str], target: str, least: int, by: str = "date") -> DataFrame:
    """by, feature, n and ic: on each day the correlation of the ranks of feature and target among the n names that have both, where there are `least` and neither is constant. Features that the same
    names have are ranked together."""
    features = list(features)

    def one(day: pd.DataFrame) -> pd.DataFrame:
        day = day[day[target].notna()]
        v, r = day[features].to_numpy(float), day[target].to_numpy(float)
        there, out = ~np.isnan(v), []
        kinds, which = np.unique(there, axis=1, return_inverse=True)
        for k in range(kinds.shape[1]):
            names = kinds[:, k]
            n, some = int(names.sum()), np.flatnonzero(which.ravel() == k)
            if n < least:
                continue
            b = _average_ranks(r[names])
            b -= b.mean()
            for f in some:
                a = _average_ranks(v[names, f])
                a -= a.mean()
                with np.errstate(invalid="ignore", divide="ignore"):
                    q = float((a * b).sum() / np.sqrt((a**2).sum() * (b**2).sum()))
                if np.isfinite(q):
                    out.append((features[f], n, q))
        return pd.DataFrame(out, columns=["feature", "n", "ic"]).assign(**{by: day[by].iloc[0] if len(day) else None})[[by, "feature", "n", "ic"]]

    return x.select(by, target, *features).groupBy(by).applyInPandas(one, f"{by} {dict(x.dtypes)[by]}, feature string, n long, ic double")


def _correlations(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column of `a` with each of `b` the number of rows that have both, and their correlation there; NaN where one is constant. They are six products of the matrices."""
    ma, mb = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
    a, b = np.nan_to_num(a), np.nan_to_num(b)
    n = ma.T @ mb
    with np.errstate(invalid="ignore", divide="ignore"):
        sx, sy = a.T @ mb / n, ma.T @ b / n
        cov = a.T @ b / n - sx * sy
        va, vb = (a**2).T @ mb / n - sx**2, ma.T @ b**2 / n - sy**2
        return n, np.where((va > 1e-9) & (vb > 1e-9), cov / np.sqrt(va * vb), np.nan)


def _correlated(day, by: str, left: list[str], right: list[str], n: np.ndarray, c: np.ndarray) -> pd.DataFrame:
    i, j = np.nonzero(np.isfinite(c))
    return pd.DataFrame({by: day, "one": np.array(left)[i], "other": np.array(right)[j], "n": n[i, j].astype(int), "c": c[i, j]})


def day_correlations(x: DataFrame, left: Sequence[str], right: Sequence[str], by: str = "date") -> DataFrame:
    """by, one, other, n and c: on each day the correlation of each column of `left` with each of `right` over the n names that have both; none where one is constant. No row is made for a pair and a name."""
    left, right = list(left), list(right)

    def one(day: pd.DataFrame) -> pd.DataFrame:
        return _correlated(day[by].iloc[0], by, left, right, *_correlations(day[left].to_numpy(float), day[right].to_numpy(float)))

    return x.select(by, *dict.fromkeys([*left, *right])).groupBy(by).applyInPandas(one, f"{by} {dict(x.dtypes)[by]}, one string, other string, n long, c double")


def factor_correlations(x: DataFrame, names: Sequence[str], value: str = "rx", by: str = "date", key: str = "code", factor: str = "factor") -> DataFrame:
    """`day_correlations` of all pairs of the factors `names`, where `x` has a row for each factor and name: a day's rows are laid side by side where it is, so no pivot moves them before."""
    names = list(names)

    def one(t: pa.Table) -> pa.Table:
        codes, row = np.unique(t[key].to_numpy(), return_inverse=True)
        kinds = t[factor].combine_chunks().dictionary_encode()
        place = np.array([names.index(n) for n in kinds.dictionary.to_pylist()], int)
        m = np.full((len(codes), len(names)), np.nan)
        m[row, place[kinds.indices.to_numpy()]] = _numbers(t, value)
        return pa.Table.from_pandas(_correlated(t[by][0].as_py(), by, names, names, *_correlations(m, m)), schema, preserve_index=False)

    schema = pa.schema([(by, to_arrow_type(x.schema[by].dataType)), ("one", pa.string()), ("other", pa.string()), ("n", pa.int64()), ("c", pa.float64())])
    return x.where(F.col(factor).isin(names)).select(by, key, factor, value).groupBy(by).applyInArrow(one, f"{by} {dict(x.dtypes)[by]}, one string, other string, n long, c double")


def finite(x: DataFrame, features: Sequence[str]) -> DataFrame:
    """`x` with its features as 32-bit numbers, those that are none or infinite null."""
    good = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).cast(FloatType()).alias(c)
    return x.select(*(c for c in x.columns if c not in set(features)), *(good(c) for c in features))
