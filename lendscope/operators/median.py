"""Exact medians of large columns, by bracketed selection.

The built-in exact percentile gathers every distinct value in one task. Here a first pass takes
a mergeable sketch of known rank error, which gives a value certainly below the median and one
certainly above. A second pass counts what lies below, and keeps apart only values between the
two: a few in ten thousand rows, or one if they are equal. The middle ranks are found there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A sketch's ranks are right to a share of 1 / ACCURACY of all values. The bracket is three
#: times as wide on both sides. A task's part of a sketch has some 24 * ACCURACY bytes.
ACCURACY = 10_000
MARGIN = 3


def brackets(df: DataFrame, *names: str, accuracy: int = ACCURACY) -> Column:
    """Scalar subquery: for each column a struct of `low` and `high`, between which its median
    lies. Both are NULL where the column has no values."""

    def bracket(name: str) -> Column:
        shares = [0.5 - MARGIN / accuracy, 0.5 + MARGIN / accuracy]
        ends = F.approx_percentile(F.col(name).cast("double"), shares, accuracy)
        return F.struct(ends[0].alias("low"), ends[1].alias("high")).alias(name)

    return df.agg(F.struct(*(bracket(name) for name in names)).alias("brackets")).scalar()


def side(value: Column, bracket: Column) -> Column:
    """-1 below the bracket, 1 above, 0 inside; NULL for NULL."""
    return (
        F.when(value < bracket["low"], -1).when(value > bracket["high"], 1).when(value.isNotNull(), 0)
    ).cast("int")


def inside(value: Column, bracket: Column) -> Column:
    """The value itself where it lies inside the bracket, so that all others are one group."""
    return F.when((value >= bracket["low"]) & (value <= bracket["high"]), value)


def middle(side_: Column, value: Column, n: Column, of: Sequence[Column] = ()) -> Column:
    """Window function: the median of each group `of`, over rows that stand for `n` values each
    and have their side of the bracket, and the value itself inside it.

    NULLs are skipped, and the two middle values of an even count are averaged. Its rows are
    those inside the bracket and a few more, so one task can hold them.
    """
    counted = F.when(side_.isNotNull(), n)
    everything = Window.partitionBy(*of)
    # Rows of equal value are peers: the sum is the same at all of them.
    up_to = F.sum(counted).over(everything.orderBy(side_, value))
    total = F.sum(counted).over(everything)
    below = F.coalesce(F.sum(F.when(side_ < 0, n)).over(everything), F.lit(0))
    above = F.coalesce(F.sum(F.when(side_ > 0, n)).over(everything), F.lit(0))
    # A bracket that missed the middle would break the sketch's bound: no result then.
    missed = F.raise_error(F.lit("the bracket does not hold the median")).cast("double")

    def at(rank: Column) -> Column:
        found = F.min(F.when((side_ == 0) & (up_to > rank), value)).over(everything)
        return F.when((below > rank) | (total - above <= rank), missed).otherwise(found)

    return at(F.floor((total - 1) / 2)) * 0.5 + at(F.floor(total / 2)) * 0.5


def exact_medians(df: DataFrame, *names: str, accuracy: int = ACCURACY) -> DataFrame:
    """One row with the median of each named column, as a double.

    NULLs are skipped. Nothing depends on the order of rows, so the plan gives the same answer
    when parts of it are computed twice.
    """
    found = brackets(df, *names, accuracy=accuracy)

    def cell(name: str) -> Column:
        value, bracket = F.col(name).cast("double"), F.col("brackets")[name]
        return F.struct(
            F.lit(name).alias("metric"), side(value, bracket).alias("side"), inside(value, bracket).alias("value")
        )

    cells = df.select(*names).withColumn("brackets", found)
    counts = (
        cells.select(F.explode(F.array(*map(cell, names))).alias("cell"))
        .groupBy("cell.metric", "cell.side", "cell.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    middles = counts.withColumn(
        "middle", middle(F.col("side"), F.col("value"), F.col("n"), [F.col("metric")])
    )
    return middles.agg(
        *(F.max(F.when(F.col("metric") == name, F.col("middle"))).alias(name) for name in names)
    )
