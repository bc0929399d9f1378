"""Exact percentiles against F.percentile."""

import random

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import expanding


@pytest.mark.parametrize("few", [100_000, 50])
@pytest.mark.parametrize("rows", ["many", "ties", "equal", "two", "one", "none"])
def test_percentiles_are_exact(spark, monkeypatch, few, rows):
    monkeypatch.setattr(expanding, "FEW_ROWS", few)
    monkeypatch.setattr(expanding, "NEAR", 0.01 if few < 1000 else expanding.NEAR)
    rng = random.Random(2)
    v = {"many": [rng.gauss(0, 1) for _ in range(3000)] + [None], "ties": [float(rng.randint(0, 3)) for _ in range(3000)], "equal": [2.5] * 400, "two": [1.0, 4.0], "one": [7.0], "none": [None]}[rows]
    x = spark.createDataFrame([(k,) for k in v], "v double").repartition(3)
    shares = (0.005, 0.25, 0.5, 0.995, 1.0)
    got = expanding.percentiles(x, "v", shares).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in x.agg(*(F.percentile("v", s) for s in shares)).collect()]


def test_no_task_of_the_histogram_holds_all_values(spark, sf_dir):
    """F.percentile keeps each different value of the table and its number in one task (F7)."""
    from crosspanel.plans import book_queries

    plan = book_queries.a40_return_histogram(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan and "percentile_approx(" in plan and "Window [lag" not in plan
