"""Blocks of a day's features against the tables of rows that they stand for."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.functions import features as ft
from crosspanel.operators import blocks, wide
from crosspanel.plans import book_queries as bk
from crosspanel.plans import judging_queries as jq
from crosspanel.plans import research_queries as rq
from crosspanel.plans import wide_queries as wq
from crosspanel.sources import panel as p


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_numbers_come_back_as_they_were(kind):
    rng, nan, inf = np.random.default_rng(5), np.nan, np.inf
    m = rng.normal(size=(6, 70)) * 10.0 ** rng.integers(-9, 9, (6, 70))
    m[1] = np.rint(m[1] * 1e9) / 1e9
    m[2] = np.rint(rng.normal(size=70) * 1e9) / 1e9
    m[2, :4], m[3, :3], m[4] = (nan, -3.25, 0.0, nan), (inf, -inf, nan), nan
    m = np.where(rng.random(m.shape) < 0.2, nan, m).astype(kind)
    for part in (m, m[:, 3:50], m[:0], m[:, :0], m[:, :1]):
        out = np.zeros_like(part)
        blocks.unsqueezed(blocks.squeezed(part), out)
        assert np.array_equal(part, out, equal_nan=True)
    assert len(blocks.squeezed(np.full((50, 1000), nan, kind))) < 500


def some(x):
    """Codes shorter than a window and weeks without volume."""
    return x.where("code % 3 > 0 or t < 17").withColumn("volume", F.when(F.col("t") % 41 != 0, F.col("volume")).otherwise(F.col("volume") * 0))


@pytest.fixture(scope="module")
def matrix(spark, sf_dir):
    return ft.matrix(some(p.dense_bars(spark, sf_dir))).localCheckpoint()


def days(spark, sf_dir, more=lambda x: x, also=()):
    first, last = p.calendar(spark, sf_dir)
    return blocks.of_days(some(more(p.code_bars(spark, sf_dir, first))), ft.bar_features(p.weeks(first, last)), ft.names(), also)


def same(got, want, keys):
    got, want = (x.toPandas().sort_values(keys, ignore_index=True) for x in (got, want))
    assert list(got.columns) == list(want.columns) and len(got) == len(want) > 0
    for c in want.columns:
        assert (got[c] == want[c]).all() if want[c].dtype == object else np.allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9, rtol=0, equal_nan=True), c


def test_bars_of_codes_are_the_bars(spark, sf_dir):
    """In one shuffle, with the returns and factors of the dense panel."""
    first, last = p.calendar(spark, sf_dir)
    x, want = p.code_bars(spark, sf_dir, first), p.dense_bars(spark, sf_dir).where("close is not null")
    assert sorted(x.select(want.columns).collect()) == sorted(want.collect()) and x.agg(F.max("t")).first()[0] == p.weeks(first, last)
    got = bk.with_ahead(x).where("r is not null").select("date", "code", "r")
    assert sorted(got.collect()) == sorted(bk.ahead(spark, sf_dir).where("r is not null").collect())
    plan = rq.with_factors(bk.with_ahead(x))._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_blocks_give_what_rows_give(spark, sf_dir, matrix):
    """Ranks and coefficients, with gaps."""
    names = ft.names()
    same(blocks.ranks(days(spark, sf_dir), names), wide.day_ranks(matrix, names), ["date", "code"])
    r = bk.ahead(spark, sf_dir).where("r is not null")
    want = wide.day_coefficients(matrix.join(r, ["date", "code"]), names, "r", rq.LEAST_NAMES)
    same(blocks.coefficients(days(spark, sf_dir, bk.with_ahead, ["r"]), names, "r", rq.LEAST_NAMES), want, ["date", "feature"])


def test_batches_of_codes_and_pieces_of_days(spark, sf_dir, monkeypatch):
    """Many small batches and pieces are one table."""
    names = ft.names()
    want = blocks.ranks(days(spark, sf_dir), names).toPandas()
    monkeypatch.setattr(wide, "whole_keys", lambda batches, by, least=1, made=wide.whole_keys: made(batches, by, 1))
    rows = days(spark, sf_dir).localCheckpoint()
    assert rows.count() >= rows.select("date").distinct().count()
    got = blocks.ranks(rows, names).toPandas()
    keys = ["date", "code"]
    pd.testing.assert_frame_equal(got.sort_values(keys, ignore_index=True), want.sort_values(keys, ignore_index=True))


def test_no_row_of_features_is_written_or_moved(spark, sf_dir, monkeypatch):
    """The matrix was written and then shuffled by row, or laid out as a row for each feature and bar (F1, F4, F5, F6)."""
    from crosspanel.sources import files

    def none(*_):
        raise AssertionError("written")

    monkeypatch.setattr(files, "new_path", none)
    for query in (wq.j13_closest_of_all, wq.a19_all_features, wq.w39_all_feature_ranks, jq.w39_all_ranks):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        lines = [k for k in plan.splitlines() if "Exchange" in k]
        assert sum("l_suppkey" in k or "(date" in k for k in lines) == 2 and "Join" not in plan and "Expand" not in plan and "Generate" not in plan, query
