"""Prices as they were traded: corporate actions, price factors, limits and what could be bought."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares after to shares before, for changes of the face value, for free shares, and for few free shares.
SPLITS = (2.0, 2.5, 4.0, 5.0, 10.0, 20.0, 25.0, 50.0, 100.0, 0.5, 0.2, 0.1)
BONUSES = (2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 11.0, 20.0, 25.0, 50.0, 100.0)
FEW = (4 / 3, 1.4, 1.5)
#: Moves and opening gaps that are looked at, and the distances in logarithms within which a ratio is met.
WATCHED, RESET, NO_OPEN, JUMP, LEAST = 0.78, 0.79, 0.60, 1.6, 0.001
NEAR_SPLIT, NEAR_OPEN, NEAR_BONUS, NEAR_BIG = 0.20, 0.05, 0.06, 0.10
AROUND, MEDIAN_ROWS, MEDIAN_LEAST = 10, 20, 5
#: Daily limits of boards by the start of the code, the usual one, and what counts as reaching them.
WIDE_LIMIT, LIMIT, SLACK, LOCKED = 0.20, 0.10, 0.002, 0.019


def by_code() -> Window:
    return Window.partitionBy("code").orderBy("t")


def previous_close() -> Column:
    """The last close before this row; rows without a trade are passed over."""
    return F.last("close", ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, -1))


def id_changed_nearby(panel: DataFrame) -> DataFrame:
    """`panel` with near_change: whether the id differs from the one before it within AROUND rows on either side."""
    known = F.last("isin", ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    x = panel.withColumn("known_id", known)
    x = x.withColumn("changed", F.coalesce(F.col("known_id") != F.lag("known_id").over(by_code()), F.lit(False)))
    near = F.max(F.col("changed").cast("int")).over(by_code().rowsBetween(-AROUND, AROUND)) > 0
    return x.withColumn("near_change", near).drop("known_id", "changed")


def nearest(move: Column, ratios: tuple[float, ...]) -> Column:
    """The ratio next to the inverse of a move in logarithms, the first of equals, with its distance: a struct of dist, at and ratio."""
    far = lambda r, i: F.struct(F.abs(F.log(1 / move) - F.log(r)).alias("dist"), i.alias("at"), r.alias("ratio"))
    return F.array_min(F.transform(F.array(*map(F.lit, ratios)), far))


def corporate_actions(panel: DataFrame, overrides: DataFrame) -> DataFrame:
    """One row for each move that looks like a change of the shares: kind, ratio, whether prices are adjusted, and why.

    `panel` has date, code, t, open, close, value and isin on all dates of each code; `overrides` has code, date, action
    (keep or adjust) and ratio, and is small, as people write it. The rules go in this order: with a new id nearby a split,
    by the ratio next to the move; where the opening is far below the last close, free shares or something else; where it
    is not, a real move. Without an opening the close decides.
    """
    x = id_changed_nearby(panel.withColumn("last", previous_close()))
    before = by_code().rowsBetween(-MEDIAN_ROWS, -1)
    traded = F.when(F.col("value") > 0, F.col("value"))
    x = x.withColumns({"move": F.col("close") / F.col("last"), "gap": F.when(F.col("open") > 0, F.col("open") / F.col("last"))})
    x = x.withColumn("value_x", F.col("value") / F.when(F.count(traded).over(before) >= MEDIAN_LEAST, F.percentile(traded, 0.5).over(before)))
    x = x.join(F.broadcast(overrides.withColumnRenamed("ratio", "its_ratio")), ["code", "date"], "left")
    move, gap, near = F.col("move"), F.col("gap"), F.col("near_change")
    low = F.coalesce(gap <= RESET, F.lit(False))
    seen = (move <= WATCHED) | low | (near & (F.abs(F.log("move")) > F.log(F.lit(JUMP))))
    x = x.where(F.col("move").isNotNull() & (seen & (move > LEAST) | F.col("action").isNotNull()))
    x = x.withColumns({"split": nearest(move, SPLITS), "open_bonus": nearest(gap, BONUSES + FEW), "real": nearest(move, BONUSES + FEW), "bonus": nearest(move, BONUSES)})
    is_split = F.col("split.dist") < NEAR_SPLIT
    is_bonus = (move <= NO_OPEN) & (F.col("bonus.dist") < F.when(F.col("bonus.ratio") < 3, NEAR_BONUS).otherwise(NEAR_BIG))
    other = F.lit("other")
    rules = (
        (near & (is_split | ~low), "split", F.col("split.ratio"), is_split),
        (near, other, 1 / gap, F.lit(True)),
        (gap.isNotNull() & low & (F.col("open_bonus.dist") < NEAR_OPEN), "bonus", F.col("open_bonus.ratio"), F.lit(True)),
        (gap.isNotNull() & low, other, 1 / gap, F.lit(True)),
        (gap.isNotNull(), "kept", F.col("real.ratio"), F.lit(False)),
        (~is_bonus & (move <= NO_OPEN), other, 1 / move, F.lit(True)),
        (F.lit(True), "bonus", F.col("bonus.ratio"), is_bonus),
    )
    made = F.lit(None)
    for when, kind, ratio, adjusted in reversed(rules):
        made = F.when(when, F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), ratio.alias("ratio"), adjusted.alias("adjusted"))).otherwise(made)
    x = x.withColumn("rule", made)
    ratio = F.when(F.col("action") == "adjust", F.coalesce("its_ratio", "rule.ratio")).otherwise(F.col("rule.ratio"))
    adjusted = F.when(F.col("action") == "keep", False).when(F.col("action") == "adjust", True).otherwise(F.col("rule.adjusted"))
    note = F.when(F.col("action") == "keep", "override: real price move").when(F.col("action") == "adjust", "override: adjust").otherwise("")
    return x.select(
        "date", "code", F.col("rule.kind").alias("kind"), "move", "gap", ratio.alias("ratio"), F.abs(F.log(move * ratio)).alias("match"), "value_x", "near_change", adjusted.alias("adjusted"), note.alias("note")
    )


def price_factor(panel: DataFrame, actions: DataFrame) -> DataFrame:
    """`panel` with factor: the product of the inverse ratios of all adjusted events after the row."""
    events = actions.where("adjusted").select("code", "date", (1 / F.col("ratio")).alias("step"))
    x = panel.join(events, ["code", "date"], "left")
    later = F.product(F.coalesce("step", F.lit(1.0))).over(by_code().rowsBetween(1, Window.unboundedFollowing))
    return x.withColumn("factor", F.coalesce(later, F.lit(1.0))).drop("step")


def adjusted(panel: DataFrame) -> DataFrame:
    """Prices times the factor, volume over it, and vwap from value and adjusted volume, null where nothing was traded."""
    prices = {c: F.col(c) * F.col("factor") for c in ("open", "high", "low", "close")}
    x = panel.withColumns(prices | {"volume": F.col("volume") / F.col("factor"), "raw_close": F.col("close")})
    return x.withColumn("vwap", F.when(F.col("volume") > 0, F.col("value") / F.col("volume")))


def raw_moves(panel: DataFrame) -> DataFrame:
    """`panel` (adjusted, with factor) with raw prices and the one-row changes of the adjusted and the raw close."""
    x = panel.withColumns({"raw_close": F.col("close") / F.col("factor"), "raw_open": F.col("open") / F.col("factor")})
    change = lambda c: F.col(c) / F.lag(c).over(by_code()) - 1
    return x.withColumns({"chg": change("close"), "raw_chg": change("raw_close")})


def daily_limit(code: Column, date: Column, since: str) -> Column:
    """The largest move of a day by board: codes that start with 688, and from `since` on those that start with 300, have the wide one."""
    wide = code.startswith("688") | (code.startswith("300") & (date >= F.to_date(F.lit(since))))
    return F.when(wide, WIDE_LIMIT).otherwise(LIMIT)


def at_limit(change: Column, limit: Column) -> tuple[Column, Column]:
    """Whether a close stands at its upper and at its lower limit."""
    return change >= limit - SLACK, change <= -limit + SLACK


def tradable(panel: DataFrame, limit: Column) -> DataFrame:
    """`panel` with can_buy and can_sell at the open: no gap to the limit, and no day locked at one price away from the last close."""
    last = previous_close()
    x = panel.withColumns({"gap": F.col("open") / last - 1, "to_last": F.col("close") / last - 1})
    locked = (F.col("high") == F.col("low")) & (F.abs("to_last") >= LOCKED)
    some = F.col("volume").isNotNull() & (F.col("volume") > 0)
    yes = lambda e: F.coalesce(e, F.lit(False))
    can_buy = some & ~yes(F.col("gap") >= limit - SLACK) & ~yes(locked & (F.col("to_last") > 0))
    can_sell = some & ~yes(F.col("gap") <= -limit + SLACK) & ~yes(locked & (F.col("to_last") < 0))
    return x.withColumns({"can_buy": yes(can_buy), "can_sell": yes(can_sell)})
