"""Order statistics of each row among the rows up to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expanding_counts(x: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """`x` with n, below and equal: how many rows of `by` there are up to this one in `order`, with a smaller value, and with the same (itself included). `order`
    is unique within `by`; rows without a value have nulls and do not count.

    Places in time are cut into blocks of 1, 2, 4, 8 and so on, and the rows before a row are one left half of a block for each bit that its place has set.
    So at each size of block a row of a right half counts the smaller values of its left half, by one window that is ordered by value. A row
    takes part once for each size, so the work grows as n log n, where a join of rows with earlier ones makes n²/2.
    """
    taken = {*x.columns}
    name = lambda n: n if n not in taken else name("_" + n)
    place, size, side, le, same = map(name, ("place", "size", "side", "le", "same"))
    known = x.where(F.col(value).isNotNull()).withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    known = known.withColumn(same, F.row_number().over(Window.partitionBy(*by, value).orderBy(order)))
    bits = F.ceil(F.log2(F.max(place).over(Window.partitionBy(*by)) + 1.0)).cast("int")
    each = known.withColumn(size, F.greatest(bits, F.lit(1)))
    each = each.select(*by, order, value, place, F.explode(F.sequence(F.lit(0), F.col(size) - 1)).alias(size))
    half = F.call_function("shiftright", F.col(place), F.col(size))
    each = each.withColumn(side, half.bitwiseAND(1)).withColumn("block_", F.call_function("shiftright", half, F.lit(1)))
    block = Window.partitionBy(*by, size, "block_").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn(le, F.when(F.col(side) == 1, F.count_if(F.col(side) == 0).over(block)).otherwise(0))
    # `le` has earlier rows with the same value too; they are those of `same` but the row itself
    sums = each.groupBy(*by, order).agg(F.sum(le).alias(le))
    known = known.join(sums, [*by, order]).select(*by, order, (F.col(place) + 1).alias("n"), (F.col(le) - F.col(same) + 1).alias("below"), F.col(same).cast("long").alias("equal"))
    return x.join(known, [*by, order], "left")


def average_rank() -> Column:
    """The share of a row's value among those up to it, ties in the middle."""
    return (F.col("below") + (F.col("equal") + 1) / 2) / F.col("n")


#: Rows of which all values are counted; of more only those near a percentile, by as much on both sides as a sketch of SKETCH buckets may err, ten times over.
FEW_ROWS, SKETCH, NEAR = 100_000, 10_000, 0.001


def percentiles(x: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row with the exact percentiles p0, p1 ... of `column`, as F.percentile gives them (null if there is no value). That holds each different value and its number in one task; here a sketch tells where
    the percentiles lie, and only the values there are told apart. `x` is read twice."""
    v, known = F.col(column), x.where(F.col(column).isNotNull())
    near = F.percentile_approx(column, [min(max(s + e, 0.0), 1.0) for s in shares for e in (-NEAR, NEAR)], SKETCH)
    bounds = known.agg(F.count("*").alias("rows_"), near.alias("near_"))
    within = lambda k: v.between(F.col("near_")[2 * k], F.col("near_")[2 * k + 1])
    kept, zone = F.col("rows_") <= FEW_ROWS, F.lit(0)
    for k in range(len(shares)):
        kept, zone = kept | within(k), zone + (v > F.col("near_")[2 * k + 1]).cast("int") + (v >= F.col("near_")[2 * k]).cast("int")
    groups = known.select(column).join(F.broadcast(bounds), how="cross").groupBy(F.when(kept, v).alias("v_"), zone.alias("zone_")).agg(F.count("*").alias("n_"), F.min(v).alias("at_"), F.max("rows_").alias("rows_"))
    upto = F.sum("n_").over(Window.partitionBy(F.lit(1)).orderBy("at_"))  # few values
    placed = groups.withColumn("upto_", upto)
    spots, out = [], []
    for k, s in enumerate(shares):
        for name, at in (("low", F.floor), ("high", F.ceil)):
            beyond = F.when(F.col("upto_") > at(F.lit(float(s)) * (F.col("rows_") - 1)), F.col("upto_"))
            spots.append(F.min_by(F.struct("v_"), beyond)["v_"].alias(f"{name}{k}"))
        low, high, place = F.col(f"low{k}"), F.col(f"high{k}"), F.lit(float(s)) * F.col("last_")
        lost = F.raise_error(F.lit("a percentile lies where its sketch says it does not")).cast("double")
        between = F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)
        out.append(F.when(F.col("last_").isNotNull(), F.when(low.isNull() | high.isNull(), lost).otherwise(between)).alias(f"p{k}"))
    return placed.agg((F.max("rows_") - 1).alias("last_"), *spots).select(*out)
