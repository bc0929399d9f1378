"""Features of a day's names as blocks: a task makes them for some codes and sends each day what its names have as one compressed block, so no row of features is written, joined or sorted.

What moves is a number of four or eight bytes for a feature and a name, less what its bytes have in common. A day's task holds the day's numbers once and
works on a few features at a time, so it grows with the number of names alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from crosspanel.operators import wide

#: Rows of whole codes that are worked on at a time, names of a day that are given out at a time, features that are correlated at a time, and decimals of numbers that move as whole ones.
ROWS, PIECE, FEW, DIGITS = 50_000, 10_000, 16, 9


def _planes(v: np.ndarray) -> bytes:
    return np.ascontiguousarray(v.reshape(-1, 1).view(np.uint8).T).tobytes()


def _from_planes(content: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(content, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeezed(m: np.ndarray) -> bytes:
    """Rows of numbers in few bytes: a bit for each tells whether it is there, then come those that are, all first bytes, all second ones and so on, compressed. Rows of 64-bit numbers of at most
    DIGITS decimals are whole numbers of their last one."""
    there, whole = ~np.isnan(m), np.zeros(len(m), bool)
    if m.itemsize == 8:
        with np.errstate(invalid="ignore", over="ignore"):
            k = np.rint(m * 10.0**DIGITS)
            whole = ((np.abs(k) < 2.0**53) & (k / 10.0**DIGITS == m) | ~there).all(1)
        k = np.nan_to_num(k[whole]).astype(np.int64)
        m = m.copy()
        m.view(np.int64)[whole] = k << 1 ^ k >> 63
    content = np.packbits(whole).tobytes() + np.packbits(there).tobytes() + _planes(m[there])
    return len(content).to_bytes(8) + pa.compress(content, codec="zstd", asbytes=True)


def unsqueezed(content: bytes, m: np.ndarray) -> None:
    """Fills `m` with what `squeezed` made of it."""
    kind, k, n = m.dtype.type, len(m), m.size
    a, b = -(-k // 8), -(-k // 8) - (-n // 8)
    content = pa.decompress(content[8:], int.from_bytes(content[:8]), codec="zstd", asbytes=True)
    bits = lambda part, size: np.unpackbits(np.frombuffer(part, np.uint8), count=size).astype(bool)
    whole, there = bits(content[:a], k), bits(content[a:b], n).reshape(m.shape)
    out = np.full(m.shape, np.nan, kind)
    out[there] = _from_planes(content[b:], kind)
    if whole.any():
        z = out[whole].view(np.int64)
        out[whole] = np.where(there[whole], (z >> 1 ^ -(z & 1)) / 10.0**DIGITS, np.nan)
    m[...] = out


def of_days(x: DataFrame, make, features: Sequence[str], also: Sequence[str] = (), kind: type = np.float32, by: str = "code", order: str = "t", day: str = "date") -> DataFrame:
    """day, n, codes, also and block: blocks of the rows of `x` that have a close. All rows of a code are in one partition. `make` gives each feature's values for the rows of a batch of whole codes,
    from their columns and places in their code; as 32-bit numbers those that are infinite are missing. `also` are columns of `x` that come along."""
    features, also = list(features), list(also)
    schema = StructType([x.schema[day], StructField("n", LongType()), *(StructField(k, BinaryType()) for k in ("codes", "also", "block"))])

    def run(batches):
        for t, keys in wide.whole_keys(batches, by, ROWS):
            t = t.combine_chunks()
            column, there = wide.column_of(t), t["close"].is_valid().to_numpy()
            days = t[day].cast(pa.int32()).to_numpy()[there]
            if not len(days):
                continue
            at = np.argsort(days, kind="stable")
            m = np.full((len(features), len(days)), np.nan, kind)
            place = {f: k for k, f in enumerate(features)}
            made = make(column, wide.place_of(keys))
            for f, v in made.items() if isinstance(made, dict) else made:
                if f in place:
                    v = v[there][at]
                    m[place[f]] = np.where(np.isinf(v), np.nan, v) if kind is np.float32 else v
            side = np.array([column(a)[there][at] for a in also]).reshape(len(also), len(days))
            codes, days = t[by].cast(pa.int64()).to_numpy()[there][at], days[at]
            begin = np.flatnonzero(np.append(True, days[1:] != days[:-1]))
            steps = lambda v: pa.compress(_planes(np.diff(v, prepend=0)), codec="zstd", asbytes=True)
            rows = [(e - b, steps(codes[b:e]), squeezed(side[:, b:e]), squeezed(m[:, b:e])) for b, e in zip(begin, [*begin[1:], len(days)])]
            columns = [pa.array(days[begin]).cast(pa.date32()), *(pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), *3 * [pa.binary()])))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return x.sortWithinPartitions(by, order).mapInArrow(run, schema)


def by_day(blocks: DataFrame, one, schema: StructType, features: Sequence[str], also: Sequence[str] = (), kind: type = np.float32, day: str = "date") -> DataFrame:
    """What `one` makes of each day: record batches, from the day, its codes, a row of numbers for each of `also` and one for each of the features."""
    features, also = len(features), len(also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [r for b in batches for r in zip(*(b.column(b.schema.get_field_index(k)).to_pylist() for k in (day, "n", "codes", "also", "block")))]
        total = sum(r[1] for r in parts)
        codes, side, m = np.empty(total, np.int64), np.empty((also, total)), np.empty((features, total), kind)
        end = 0
        for _, n, names, *some in parts:
            end += n
            codes[end - n : end] = np.cumsum(_from_planes(pa.decompress(names, n * 8, codec="zstd", asbytes=True), np.int64))
            for whole, part in zip((side, m), some):
                unsqueezed(part, whole[:, end - n : end])
        yield from one(parts[0][0], codes, side, m)

    return blocks.groupBy(day).applyInArrow(run, schema)


def _twice_ranks(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the average ranks within each row of `m`, 0 where there is no number, and how many there are. They take the place of the numbers."""
    out, n = m.view(np.int32 if m.itemsize == 4 else np.int64), np.empty(len(m), int)
    for k, v in enumerate(m):
        n[k] = np.count_nonzero(~np.isnan(v))
        out[k] = np.nan_to_num(2 * wide._average_ranks(v))
    return out, n


def _centred(twice: np.ndarray, n: int) -> np.ndarray:
    return np.where(twice > 0, twice / 2 / max(n, 1) - 0.5, np.nan)


def ranks(blocks: DataFrame, features: Sequence[str], day: str = "date", key: str = "code") -> DataFrame:
    """day, code and for each feature the average rank among the day's values over their number, less one half, as `wide.day_ranks`."""
    features = list(features)
    schema = StructType([blocks.schema[day], StructField(key, LongType()), *(StructField(f, DoubleType()) for f in features)])

    def one(date, codes, side, m):
        twice, n = _twice_ranks(m)
        for b in range(0, len(codes), PIECE):
            made = [pa.array(_centred(r[b : b + PIECE], k), from_pandas=True) for r, k in zip(twice, n)]
            names = codes[b : b + PIECE]
            yield pa.RecordBatch.from_arrays([pa.array([date] * len(names), pa.date32()), pa.array(names), *made], names=schema.names)

    return by_day(blocks, one, schema, features, day=day)


def rank_totals(blocks: DataFrame, features: Sequence[str], weight, kind: type) -> DataFrame:
    """feature, n, total and most for each day: of the centred ranks their number, their sum, each times the `weight` of its code, and the largest one."""
    features = list(features)

    def one(date, codes, side, m):
        twice, n = _twice_ranks(m)
        w = weight(codes)
        rows = [(f, k, float(np.nansum(v * w)), float(np.nanmax(v))) for f, r, k in zip(features, twice, n) if k for v in (_centred(r, k),)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else 4 * [()], (pa.string(), pa.int64(), pa.float64(), pa.float64()))], names=schema.names)

    schema = StructType([StructField("feature", StringType()), StructField("n", LongType()), StructField("total", DoubleType()), StructField("most", DoubleType())])
    return by_day(blocks, one, schema, features, kind=kind)


def coefficients(blocks: DataFrame, features: Sequence[str], target: str, least: int, day: str = "date") -> DataFrame:
    """day, feature, n and ic, as `wide.day_coefficients`: the target's ranks are made once for features that the same names have."""
    features = list(features)

    def one(date, codes, side, m):
        known = ~np.isnan(side[0])
        r, kinds, rows = side[0][known], {}, []
        for k, v in enumerate(m):
            kinds.setdefault(np.packbits(~np.isnan(v[known])).tobytes(), []).append(k)
        for bits, some in kinds.items():
            names = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(r)).astype(bool)
            n = int(names.sum())
            if n < least:
                continue
            b = wide._average_ranks(r[names])
            b -= b.mean()
            for k in some:
                a = wide._average_ranks(m[k][known][names])
                a -= a.mean()
                with np.errstate(invalid="ignore", divide="ignore"):
                    q = float((a * b).sum() / np.sqrt((a**2).sum() * (b**2).sum()))
                if np.isfinite(q):
                    rows.append((date, features[k], n, q))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else 4 * [()], (pa.date32(), pa.string(), pa.int64(), pa.float64()))], names=schema.names)

    schema = StructType([blocks.schema[day], StructField("feature", StringType()), StructField("n", LongType()), StructField("ic", DoubleType())])
    return by_day(blocks, one, schema, features, [target], day=day)


def correlations(blocks: DataFrame, factors: Sequence[str], target: str, features: Sequence[str], least: int, day: str = "date") -> DataFrame:
    """day, one, other, n and c: on each day the correlation of each factor's ranks, among the names that have it and the target where there are `least`, with each feature's ranks."""
    factors, features = list(factors), list(features)

    def one(date, codes, side, m):
        r = side[-1]
        left = np.full((len(r), len(factors)), np.nan)
        for k, v in enumerate(side[:-1]):
            both = ~np.isnan(v) & ~np.isnan(r)
            if np.count_nonzero(both) >= least:
                left[both, k] = wide._average_ranks(v[both])
        twice, n = _twice_ranks(m)
        for b in range(0, len(features), FEW):
            right = np.stack([_centred(*x) for x in zip(twice[b : b + FEW], n[b : b + FEW])], 1)
            found = wide._correlated(date, day, factors, features[b : b + FEW], *wide._correlations(left, right))
            yield pa.RecordBatch.from_pandas(found, arrow, preserve_index=False)

    arrow = pa.schema([(day, pa.date32()), ("one", pa.string()), ("other", pa.string()), ("n", pa.int64()), ("c", pa.float64())])
    schema = StructType([blocks.schema[day], StructField("one", StringType()), StructField("other", StringType()), StructField("n", LongType()), StructField("c", DoubleType())])
    return by_day(blocks, one, schema, features, [*factors, target], day=day)
