"""Every panel query against its SQL in DuckDB, and the properties that windows must have."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from crosspanel import registry
from crosspanel.functions import factors as f
from crosspanel.sources import panel

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None or isinstance(v, int | bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_is_its_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key) == want


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_look_ahead(spark, sf_dir):
    """A shock to all later rows changes no window value up to that row."""
    x = panel.dense_bars(spark, sf_dir)
    shocked = x.withColumns({c: F.when(F.col("t") > 100, F.col(c) * 3.7).otherwise(F.col(c)) for c in ("close", "volume")})
    c, v = F.col("close"), F.col("volume")
    made = [f.mean(c, 3), f.std(c, 3), f.ts_rank(c, 3), f.decay(c, 3), f.slope(c, 3), f.corr(c, v, 3), f.pct(c, 2), f.idx_max(c, 3), f.skew(c, 4)]
    some = lambda df: sorted(map(str, df.select("code", "t", *(F.round(e, 6) for e in made)).where("t <= 100").collect()))
    assert some(x) == some(shocked)


def test_factor_bounds(spark):
    assert f.spec_size(("Mean", ("Pct", "close", 5), 10)) == (3, 3, 15)
    for bad in (("Mean", "close", 61), ("Mean", "close", 1), ("Corr", "close", 5)):
        with pytest.raises(ValueError):
            f.factor(bad)


def test_rank_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([3.0, 1.0, None, 3.0])], "date int, code int, x double")
    got = {r.code: r.q for r in df.select("code", f.cs_rank(F.col("x")).alias("q")).collect()}
    want = pd.Series([3.0, 1.0, None, 3.0]).rank(pct=True)
    assert all(got[i] is None if pd.isna(w) else abs(got[i] - w) < 1e-12 for i, w in want.items())
