"""Corporate actions by their rule table, and what hangs on prices as traded."""

import datetime as dt
import math

import pytest

from crosspanel.operators import actions as a

DAY = dt.date(2020, 1, 1)
#: Symbol, close move, open move, row of the id change, and the expected kind, ratio and whether prices are adjusted.
CASES = [
    ("BONUS12", 0.67, 0.665, None, "bonus", 1.5, True),
    ("BADDAY", 0.67, 0.98, None, "kept", None, False),
    ("BONUS11", 0.49, 0.50, None, "bonus", 2.0, True),
    ("SPLIT", 0.105, 0.10, 34, "split", 10.0, True),
    ("DEMERGE", 0.45, 0.45, None, "other", 1 / 0.45, True),
    ("CRASH", 0.5, 0.5, None, "bonus", 2.0, False),
    ("REALCRASH", 0.45, 0.95, None, "kept", None, False),
    ("CIRCUIT", 0.80, 0.80, None, None, None, False),
]


def panel(spark):
    rows = []
    for symbol, move, gap, changed, *_ in CASES:
        for t in range(60):
            close = 100.0 * (move if t >= 30 else 1)
            opened = 100.0 * gap if t == 30 else close
            isin = "INE1" if changed is None or t < changed else "INE2"
            rows.append((symbol, DAY + dt.timedelta(t), t, opened, max(opened, close), min(opened, close), close, 1000.0, close * 1000.0, isin))
    return spark.createDataFrame(rows, "code string, date date, t int, open double, high double, low double, close double, volume double, value double, isin string")


@pytest.fixture(scope="module")
def events(spark):
    kept = spark.createDataFrame([("CRASH", DAY + dt.timedelta(30), "keep", None)], "code string, date date, action string, ratio double")
    return a.corporate_actions(panel(spark), kept)


def test_rule_table(events):
    got = {r.code: r for r in events.collect()}
    assert len(got) == events.count()
    for symbol, move, _, _, kind, ratio, adjusted in CASES:
        if kind is None:
            assert symbol not in got
            continue
        r = got[symbol]
        assert (r.kind, r.adjusted, r.date) == (kind, adjusted, DAY + dt.timedelta(30)), symbol
        assert abs(r.move - move) < 1e-9 and (ratio is None or abs(r.ratio - ratio) < 1e-9)
    assert got["CRASH"].note == "override: real price move"


def test_factor_and_adjusted_prices(spark, events):
    x = a.adjusted(a.price_factor(panel(spark), events))
    got = {(r.code, r.t): r for r in x.collect()}
    for symbol, move, _, _, _, ratio, adjusted in CASES:
        before, after = got[symbol, 29], got[symbol, 30]
        assert after.factor == 1 and abs(before.factor - (1 / ratio if adjusted else 1)) < 1e-12
        assert abs(after.close / before.close - (move * ratio if adjusted else move)) < 1e-9
        assert before.raw_close == 100 and abs(before.vwap - before.close) < 1e-9
    back = {(r.code, r.t): r for r in a.raw_moves(x.drop("raw_close")).collect()}
    assert abs(back["SPLIT", 30].raw_chg - (0.105 - 1)) < 1e-9 and abs(back["SPLIT", 30].chg - 0.05) < 1e-9


def test_nearest_takes_the_first_of_equals(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(a.nearest(F.lit(1 / math.sqrt(2 * 8)), (8.0, 4.0, 4.0)).alias("n")).first().n
    assert r.ratio == 4.0 and r["at"] == 1


def test_locked_days_and_limits(spark):
    rows = [("600001", 1, 10.0, 10.0, 10.0, 10.0, 5.0), ("600001", 2, 11.0, 11.0, 11.0, 11.0, 5.0), ("600001", 3, 10.9, 11.0, 10.0, 10.5, 5.0), ("600001", 4, 10.5, 10.6, 10.4, 10.5, None)]
    df = spark.createDataFrame(rows, "code string, t int, open double, high double, low double, close double, volume double")
    from pyspark.sql import functions as F

    got = {r.t: (r.can_buy, r.can_sell) for r in a.tradable(df, F.lit(0.1)).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, True), 4: (False, False)}
