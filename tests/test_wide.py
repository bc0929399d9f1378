"""Many features at once against one value at a time."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.functions import features as ft
from crosspanel.operators import wide


def panel(spark, codes=3, weeks=40, seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(codes):
        for t in range(1, weeks + 1):
            gap = rng.random() < 0.1
            close = None if gap else rng.choice([1.0, 2.0, 2.5, rng.random() * 3])
            rows.append((c, t, close, None if gap else close + rng.choice([0.0, 1.0]), None if gap else close - rng.choice([0.0, 0.5])))
    return spark.createDataFrame(rows, "code int, t int, close double, high double, low double"), rows


@pytest.mark.parametrize("d", [2, 5, 60])
def test_order_statistics_by_brute_force(spark, d):
    x, rows = panel(spark)
    got = {(r["code"], r["t"]): r for r in wide.order_statistics(x, [d]).collect()}
    assert len(got) == len(rows)
    for c, t, *_ in rows:
        past = sorted((r for r in rows if r[0] == c and t - d < r[1] <= t), key=lambda r: r[1])
        closes = [r[2] for r in past]
        want = dict.fromkeys(wide.ORDERED)
        if len(past) == d:
            high = [math.inf if r[3] is None else r[3] for r in past]
            low = [-math.inf if r[4] is None else r[4] for r in past]
            want |= {"imax": high.index(max(high)) / d, "imin": low.index(min(low)) / d}
            want["imxd"] = want["imax"] - want["imin"]
            if None not in closes:
                want |= {"qtlu": np.quantile(closes, 0.8), "qtld": np.quantile(closes, 0.2), "rank": (sum(v < closes[-1] for v in closes) + (closes.count(closes[-1]) + 1) / 2) / d}
        for k, v in want.items():
            v, w = got[c, t][f"{k}{d}"], v
            assert (v is None) == (w is None) and (v is None or abs(v - w) < 1e-12), (c, t, k)


def table(spark, n=40, days=4):
    rng = random.Random(7)
    value = lambda: None if rng.random() < 0.2 else rng.choice([1.0, 2.0, rng.random()])
    rows = [(k, c, value(), value(), 1.0, value()) for k in range(days) for c in range(n)]
    return spark.createDataFrame(rows, "date int, code int, a double, b double, same double, r double"), pd.DataFrame(rows, columns=["date", "code", "a", "b", "same", "r"]).astype(float)


def test_day_blocks_by_brute_force(spark):
    x, rows = table(spark)
    ranks = rows.groupby("date")[["a", "b", "same"]].rank(pct=True) - 0.5
    got = wide.day_ranks(x, ["a", "b", "same"]).orderBy("date", "code").toPandas()
    assert np.allclose(got[["a", "b", "same"]].to_numpy(float), ranks.to_numpy(), equal_nan=True)
    want, both = {}, {}
    for day, g in rows.groupby("date"):
        for f in ("a", "b"):
            s = g[[f, "r"]].dropna().rank()
            want[day, f] = (len(s), s.corr().iloc[0, 1])
        s = g[["a", "b"]].dropna()
        both[day] = (len(s), s.corr().iloc[0, 1])
    ics = {(r.date, r.feature): (r.n, r.ic) for r in wide.day_coefficients(x, ["a", "b", "same"], "r", 5).collect()}
    assert set(ics) == set(want) and all(ics[k][0] == n and abs(ics[k][1] - c) < 1e-12 for k, (n, c) in want.items())
    pairs = {r.date: (r.n, r.c) for r in wide.day_correlations(x, ["a"], ["b", "same"]).collect()}
    assert set(pairs) == set(both) and all(pairs[k][0] == n and abs(pairs[k][1] - c) < 1e-9 for k, (n, c) in both.items())
    assert wide.day_coefficients(x, ["a"], "r", 1000).count() == 0 and wide.day_ranks(x.limit(0), ["a"]).count() == 0


def test_names_are_those_of_the_matrix(spark, sf_dir):
    from crosspanel.sources import panel as p

    made = ft.matrix(p.dense_bars(spark, sf_dir))
    assert made.columns == ["date", "code", *ft.names()] and len(ft.names()) == 158
    assert all(k == "float" for n, k in made.dtypes if n in set(ft.names()))
    x = spark.createDataFrame([(1, float("inf")), (2, float("nan")), (3, 2.0), (4, None)], "code int, v double")
    assert [r.v for r in wide.finite(x, ["v"]).orderBy("code").collect()] == [None, None, 2.0, None]
    assert made.agg(F.count("*")).first()[0] > 0


def test_rolled_is_what_windows_make(spark, sf_dir):
    """Blocks of codes against Spark's windows, with gaps, days without volume and codes shorter than a window."""
    from crosspanel.sources import panel as p

    x = p.dense_bars(spark, sf_dir).where("code % 3 > 0 or t < 17")
    x = x.withColumns({"volume": F.when(F.col("t") % 41 != 0, F.col("volume")).otherwise(F.col("volume") * 0)})
    for d in (5, 30):
        want = ft.prepared(x).select("code", "t", *(F.round(e.cast("double"), 7).alias(f"{k}{d}") for k, e in ft.rolling(d).items())).orderBy("code", "t").toPandas()
        got = ft.rolled(x, (d,)).orderBy("code", "t").toPandas()
        assert [f"{k}{d}" for k in ft.FAMILY] == list(want.columns[2:])
        for c in want.columns:
            assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=2e-7, rtol=1e-7, equal_nan=True), c


def test_rolled_holds_a_batch_and_the_rest_of_a_code(spark):
    """No plan of the rolling features has a window of Spark's or a group in Python, whose cost grew with rows times window."""
    x, _ = panel(spark)
    x = x.withColumns({"open": F.col("close"), "volume": F.col("close"), "vwap": F.col("close"), "date": F.col("t")})
    plan = ft.matrix(x)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "FlatMapGroups" not in plan


def test_rows_with_a_close_are_what_windows_make(spark, sf_dir):
    """Windows of a code's last bars, with weeks missing, rows without a close and weeks without volume, against Spark's windows over the rows of the dense panel that have a close."""
    from crosspanel.functions import factors as f
    from crosspanel.sources import panel as p

    x = p.dense_bars(spark, sf_dir).where("code % 3 > 0 or t < 17")
    gap = lambda c, k: F.when(F.col("t") % k != 0, F.col(c))
    x = x.withColumns({"volume": F.coalesce(gap("volume", 41), F.col("volume") * 0), **{c: gap(c, 29) for c in ("high", "low", "close")}}).localCheckpoint()
    for d in (5, 30):
        want = ft.prepared(x).where("close is not null").select("code", "t", *(F.round(e.cast("double"), 9).alias(f"{k}{d}") for k, e in ft.rolling(d).items())).orderBy("code", "t").toPandas()
        rows = wide.rolling_rows(x.where("volume is not null"), (d,), ft.FAMILY, f.TINY, ("code", "t", "close"), ("high",), 9)
        assert rows.where(f"close is null and (ma{d} is not null or cntp{d} is not null)").count() == 0 < rows.where("close is null").count()
        got = rows.where("close is not null").orderBy("code", "t").toPandas()
        assert len(got) == len(want) > 0
        for c in want.columns:
            assert np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=2e-7, rtol=1e-7, equal_nan=True), c


def test_totals_by_feature(spark):
    inf, nan = float("inf"), float("nan")
    x = spark.createDataFrame([(1.0, inf, None, 0.1), (nan, inf, nan, -inf), (-4.0, None, None, 0.7)], "a double, b double, c double, d double")
    got = {r.feature: tuple(r)[1:] for r in wide.totals(x, ["a", "b", "c", "d"]).collect()}
    d = [float(np.float32(v)) for v in (0.1, 0.7)]
    assert got == {"a": (2, -1.5, 1.0), "b": (0, None, None), "d": (2, sum(d) / 2, d[1])}
    assert wide.totals(x.limit(0), ["a"]).count() == 0
    assert list(wide._nearest(np.array([0.5, -0.5, 1.5, 2.5, 0.49, -1.2, inf]), 0)) == [1.0, -1.0, 2.0, 3.0, 0.0, -1.0, inf]


def test_feature_matrix_makes_no_row_for_a_feature_and_a_name(spark, sf_dir):
    """Spark's windows over each feature and a row for each of them and each bar were most of the time."""
    from crosspanel.plans import judging_queries as jq

    plan = jq.w38_feature_matrix(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "Expand" not in plan
    assert "Window" not in jq.known_features(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_own_function_gets_blocks_of_windows(spark):
    x, rows = panel(spark, codes=30)
    sizes = spark.sparkContext.accumulator(0)

    def span(block):
        sizes.add(1)
        return block.max(1) - block.min(1)

    got = {(r["code"], r["t"]): r.v for r in wide.framed(x, "close", 3, span).collect()}
    calls = sizes.value
    for c, t, *_ in rows:
        past = [r[2] for r in rows if r[0] == c and t - 3 < r[1] <= t]
        want = max(past) - min(past) if len(past) == 3 and None not in past else None
        assert got[c, t] == want
    assert 0 < calls <= 8  # at most two for a partition, not one for each of 1,200 rows


def test_rounded_is_the_round_of_sql(spark, sf_dir):
    """As DuckDB rounds; the wide queries go by no decimal text of each number."""
    import duckdb

    from crosspanel.plans import wide_queries as wq

    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-7, 7) for _ in range(3000)] + [0.0, -0.0, 0.5, -0.12345, 1.00005, -2.5, 8388607.5]
    x = pd.DataFrame({"id": range(len(values)), "v": np.array(values, np.float32)})
    got = spark.createDataFrame(x).orderBy("id").select(wide.rounded(F.col("v"), 4).alias("a"), wide.rounded(F.col("v"), 6).alias("b")).toPandas()
    want = duckdb.sql("SELECT round(CAST(v AS DOUBLE) + 1e-9, 4) + 0.0 AS a, round(CAST(v AS DOUBLE) + 1e-9, 6) + 0.0 AS b FROM x ORDER BY id").df()
    assert (got == want).all().all()
    for query in (wq.w38_all_features, wq.w39_all_feature_ranks):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan()
        assert "rint(" in plan.toString().lower() and " round(" not in plan.expressions().mkString(" ").lower()
    assert "FlatMapGroupsInArrow" in wide.day_ranks(table(spark)[0], ["a"])._jdf.queryExecution().executedPlan().toString()


def test_day_ranks_of_names_by_brute_force(spark):
    """Ranks of names that have both values, places, ranks in groups and correlations of factors, against pandas; ties and gaps among them. None of them is a window of Spark's, which held its rows once for each order."""
    x, rows = table(spark)
    both = wide.paired_ranks(x, ["a", "b"], "r", 25)
    got = {(r.date, r.code, r.factor): (r.r, r.rx, r.rw, r.n) for r in both.collect()}
    want = {}
    for day, g in rows.groupby("date"):
        for f in ("a", "b"):
            s = g[["code", f, "r"]].dropna()
            if len(s) >= 25:
                want |= {(day, c, f): (r, rx, rw, len(s)) for c, r, rx, rw in zip(s["code"], s["r"], s[f].rank(), s["r"].rank())}
    assert got == want and 0 < len(want)
    again = wide.ranks_within(both.select("date", "factor", (F.col("code") % 2).alias("market"), "code", "rx"), ["market", "date", "factor"], ["rx"])
    w = pd.DataFrame([(*k, v[1]) for k, v in want.items()], columns=["date", "code", "factor", "rx"])
    w["rx"] = w.groupby([w["code"] % 2, "date", "factor"])["rx"].rank()
    assert {(r.date, r.code, r.factor): r.rx for r in again.collect()} == {(d, c, f): v for d, c, f, v in w.itertuples(index=False)}
    pairs = {(r.date, r.one, r.other): (r.n, round(r.c, 9)) for r in wide.factor_correlations(both, ["a", "b"]).collect()}
    wide_ranks = both.groupBy("date", "code").pivot("factor", ["a", "b"]).agg(F.first("rx"))
    assert pairs == {(r.date, r.one, r.other): (r.n, round(r.c, 9)) for r in wide.day_correlations(wide_ranks, ["a", "b"], ["a", "b"]).collect()} and pairs
    places = {(r.date, r.code): (r.p, r.position, r.n) for r in wide.day_places(x.select("date", "code", "a"), "a").collect()}
    for day, g in rows.groupby("date"):
        g = g.assign(p=g["a"].rank(pct=True)).sort_values(["a", "code"], ascending=[False, True])
        for k, (c, p) in enumerate(zip(g["code"], g["p"]), 1):
            assert places[day, c] == (None if pd.isna(p) else p, k, len(g))
    for made in (both, again, wide.day_places(x, "a"), wide.factor_correlations(both, ["a", "b"])):
        assert "Window" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("d", [1, 6])
def test_ema_is_what_the_window_folds(spark, d):
    """Against the fold of factors.ema, with gaps; the plan folds no frame for each row."""
    from crosspanel.functions import factors as f

    x, rows = panel(spark, codes=5, weeks=60)
    want = {(r["code"], r["t"]): r.v for r in x.select("code", "t", f.ema(F.col("close"), d).alias("v")).collect()}
    made = wide.ema(x, "close", d)
    got = {(r["code"], r["t"]): r.v for r in made.collect()}
    assert set(got) == set(want) and len(got) == len(rows)
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-12) for k, v in want.items())
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_books_and_models_hold_no_windows_of_a_day(spark, sf_dir):
    """The books' places and the model table's ranks: a window by date held a day's rows once for each order."""
    from crosspanel.plans import book_queries, model_queries

    for made in (book_queries.books(spark, sf_dir), model_queries.feature_table(spark, sf_dir)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert " rank(" not in plan and "row_number(" not in plan
