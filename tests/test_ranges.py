"""Spells, expanding order statistics, random starts and files against plain versions."""

import datetime as dt
import io
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import expanding, spells
from crosspanel.plans import research_queries
from crosspanel.sources import files, raw


@pytest.mark.parametrize("bin_days", [7, 364])
def test_members_by_brute_force(spark, bin_days):
    rng, first = random.Random(3), dt.date(2019, 12, 30)
    rows = []
    for _ in range(120):
        a = first + dt.timedelta(rng.randrange(-40, 500))
        rows.append((rng.randrange(9), a, a + dt.timedelta(rng.choice([-2, 0, 1, 6, 30, 400]))))
    rows += [(1, None, first), (2, first, None), (None, first, first)]
    days = [first + dt.timedelta(7 * k) for k in range(60)]
    want = {(d, c) for c, a, z in rows if a and z for d in days if a <= d <= z and c is not None}
    x = spark.createDataFrame(rows, "code int, start date, end date")
    got = [(r.date, r.code) for r in spells.members(x, spark.createDataFrame([(d,) for d in days], "date date"), bin_days=bin_days).where("code is not null").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_touching_spells_become_one(spark):
    d = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    x = spark.createDataFrame([(1, d(0), d(9)), (1, d(2), d(3)), (1, d(10), d(12)), (1, d(14), d(15)), (2, d(5), d(5))], "code int, start date, end date")
    assert sorted(map(tuple, spells.merged(x).collect())) == [(1, d(0), d(12)), (1, d(14), d(15)), (2, d(5), d(5))]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 65, 200])
def test_expanding_counts_by_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(k, t, rng.choice([None, 1.0, 2.0, 2.5, rng.random() * 3])) for k in ("a", "b") for t in rng.sample(range(1000), n)]
    want = set()
    for k, t, v in rows:
        past = [w for i, s, w in rows if i == k and s <= t and w is not None]
        want.add((k, t, *((None,) * 3 if v is None else (len(past), sum(w < v for w in past), past.count(v)))))
    got = expanding.expanding_counts(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v")
    assert {(r.k, r.t, r.n, r.below, r.equal) for r in got.collect()} == want


def test_rows_of_expanding_counts_grow_as_n_log_n(spark):
    x = spark.range(1024).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.rand(3).alias("v"))
    got = expanding.expanding_counts(x, ["k"], "t", "v")
    assert "Join" in str(got._jdf.queryExecution().optimizedPlan())
    got.collect()
    made = []

    def walk(node):
        if node.nodeName() == "Generate":
            made.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(got._jdf.queryExecution().executedPlan())
    assert made and max(made) <= 1024 * 10


def test_random_starts_are_uniform(spark):
    x = spark.range(13 * 4000).select(research_queries.drawn_start(F.floor(F.col("id") / 13), F.col("id") % 13, F.lit(50)).alias("s"))
    seen = Counter(r.s for r in x.collect())
    assert set(seen) == set(range(50))
    mean = 13 * 4000 / 50
    assert 20 < sum((n - mean) ** 2 / mean for n in seen.values()) < 90  # chi square with 49 degrees of freedom: 0.9999 of draws
    pairs = spark.range(3000).select(*(research_queries.drawn_start(F.col("id"), F.lit(k), F.lit(1000)).alias(f"s{k}") for k in (0, 1))).agg(F.corr("s0", "s1")).first()[0]
    assert abs(pairs) < 0.08


def zipped(name, text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, text)
    return out.getvalue()


def test_zipped_days(spark):
    old = "SYMBOL,SERIES,OPEN,HIGH,LOW,CLOSE,PREVCLOSE,TOTTRDQTY,TOTTRDVAL,TIMESTAMP,ISIN,\n"
    new = " tradDt, sgmt ,FinInstrmTp,ISIN,TckrSymb,SctySrs,OpnPric,HghPric,LwPric,ClsPric,PrvsClsgPric,TtlTradgVol,TtlTrfVal\n"
    days = [
        ("2020/20200102.csv.zip", zipped("a.csv", old + "AAA, EQ ,1,2,0.5,1.5,-,\"1,000\",9,x,INE1,\nBBB,GS,1,1,1,1,1,1,1,x,INE2,\nCCC,be,1,1\n")),
        ("2024/20240709.csv.zip", zipped("b.CSV", new + "x,CM,STK,INE1,AAA,EQ,3,4,2,3.5,3,7,8\nx,FO,STK,INE1,AAA,EQ,9,9,9,9,9,9,9\nx,CM,BND,INE9,ZZZ,EQ,9,9,9,9,9,9,9\n\n")),
        ("2020/20200103.csv.zip", b"PK\x03\x04 cut"),
        ("2020/20200106.csv.zip", b""),
        ("2020/20200107.csv.zip", zipped("a.csv", old.replace("LOW", "LEAST") + "AAA,EQ,1,1,1,1,1,1,1,x,I,\n")),
        ("2020/20200108.csv.zip", zipped("a.txt", old)),
        ("2020/notes.csv.zip", zipped("a.csv", old)),
        ("2020/20200109.csv.zip", zipped("a.csv", "")),
        ("2020/20200110.csv.zip", zipped("a.csv", old)),
    ]
    base = files.new_path(spark, "days")
    assert files.write_binary(spark.createDataFrame([(p, bytearray(c)) for p, c in days], "path string, content binary"), base) == len(days)
    read = raw.zipped_day_files(files.read_binary(spark, base, "*.zip"))
    got = sorted((str(r.date), r.symbol, r.series, r.isin, r.open, r.close, r.prevclose, r.volume) for r in raw.good_rows(read, ("EQ", "BE")).collect())
    assert got == [("2020-01-02", "AAA", "EQ", "INE1", 1.0, 1.5, None, 1000.0), ("2020-01-02", "CCC", "BE", None, 1.0, None, None, None), ("2024-07-09", "AAA", "EQ", "INE1", 3.0, 3.5, 3.0, 7.0)]
    bad = {r.file.split(".")[0]: r.error for r in raw.bad_files(read).collect()}
    assert bad == {"20200103": "no archive", "20200107": "no column for low", "20200108": "no CSV inside", "notes": "no day in the name", "20200109": "no column for symbol"}


def test_binary_series_from_files(spark):
    import numpy as np

    rows = [("features/7/close.day.bin", np.array([3, 1.5, np.nan, 2.5], "<f4").tobytes()), ("features/8/close.day.bin", b""), ("features/9/close.day.bin", np.array([0], "<f4").tobytes())]
    base = files.new_path(spark, "series")
    files.write_binary(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary"), base)
    got = [(r.path.split("/")[-2], r.at, r.value) for r in raw.binary_series(files.read_binary(spark, base, "*.bin")).orderBy("at").collect()]
    assert got == [("7", 3, 1.5), ("7", 4, None), ("7", 5, 2.5)]


def test_zipped_day_is_taken_apart_in_pieces(monkeypatch):
    """Never all rows of a day at once, whose lists of texts took most of a worker's memory; empty lines go, and a bad header is told before any piece."""
    import io
    import zipfile

    from crosspanel.sources import raw

    def packed(text):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("day.csv", text)
        return out.getvalue()

    monkeypatch.setattr(raw, "PIECE", 3)
    names = [raw.OLD[k] for k in (*raw.TEXTS, *raw.NUMBERS)]
    lines = [",".join(names), *(",".join([f"S{k}", *"x" * (len(names) - 1)]) + ("\n" if k == 4 else "") for k in range(10))]
    pieces = list(raw._day_pieces(packed("\n".join(lines))))
    assert [s for p in pieces for s in p["symbol"]] == [f"S{k}" for k in range(10)]
    assert len(pieces) == 4 and all(len(p["symbol"]) <= 3 and set(map(len, p.values())) == {len(p["symbol"])} for p in pieces)
    with pytest.raises(ValueError, match="no column for close"):
        next(raw._day_pieces(packed("\n".join(lines).replace("CLOSE", "OTHER", 1))))
