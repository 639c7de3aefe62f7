"""Work on a customer's loans that stays spread out when one customer has very many.

Aggregates need none of this, because they combine on the map side. Windows and joins on
`customer_id` do: they would send all loans of a customer to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 5_000_000

#: Loans sampled for each slice of a hot customer. A slice of twice the mean size would have
#: half as many as it should: with 64, some six standard deviations off.
SAMPLED = 64

# Widths a binary search tries: finds a place among 2^20 splitters.
_STEPS = [1 << k for k in reversed(range(20))]


def hot_customers(loans: DataFrame, hot_rows: int) -> DataFrame:
    """Customers with more than `hot_rows` loans, and how many slices they are cut into.

    There can be at most `count(loans) / hot_rows` of them, and each is a few dozen
    bytes, so the list can be broadcast; raise `hot_rows` together with the table. The
    counts are exact, so every branch of a plan that asks gets the same list.
    """
    return (
        loans.groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > hot_rows)
        .select(F.col("customer_id").alias("hot_id"), F.ceil(F.col("n") / hot_rows).alias("slices"))
    )


def _hot_match(loans: DataFrame, hot_rows: int) -> tuple[DataFrame, Column]:
    """The broadcast list of hot customers, and the condition that joins it.

    The condition names every column of the list, always true, so that no join prunes
    one and all of them share a single count of loans per customer.
    """
    same = F.col("customer_id").eqNullSafe(F.col("hot_id")) & (F.col("slices") > 0)
    return F.broadcast(hot_customers(loans, hot_rows)), same


def split_hot(loans: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """The loans of ordinary customers, and those of hot ones with their number of slices."""
    hot, same = _hot_match(loans, hot_rows)
    return loans.join(hot, same, "left_anti"), loans.join(hot, same).drop("hot_id")


def _place(loans: DataFrame) -> Column:
    """Where a loan stands among its customer's. The hash parts loans of one day that have the
    same id, or none."""
    others = [name for name in loans.columns if name != "slices"]
    return F.struct("origination_date", "loan_id", F.xxhash64(*others).alias("hash"))


def splitters(hot: DataFrame, hot_rows: int) -> DataFrame:
    """For each hot customer the places, in order, at which its slices after the first begin.

    They are quantiles of a sample that a hash draws, so every branch of a plan gets the same
    ones, and slices are of about equal size however dates and ids crowd. A customer's sample
    has SAMPLED places a slice; all splitters together are as many as slices.
    """
    every = max(1, hot_rows // SAMPLED)
    drawn = F.pmod(F.xxhash64(F.lit(1), *hot.columns), F.lit(every)) == 0
    sample = F.array_sort(F.collect_list(F.col("place")))
    return (
        hot.select("customer_id", "slices", _place(hot).alias("place"), drawn.alias("drawn"))
        .where("drawn")
        .groupBy("customer_id", "slices")
        .agg(sample.alias("sample"))
        .select(
            F.col("customer_id").alias("split_id"),
            F.transform(
                F.sequence(F.lit(1).cast("long"), F.greatest(F.col("slices") - 1, F.lit(1))),
                lambda k: F.get("sample", F.floor(k * F.size("sample") / F.col("slices")).cast("int")),
            ).alias("splitters"),
        )
    )


def _slice_of(place: Column, ordered: Column) -> Column:
    """How many splitters are at or before a place: a binary search."""

    def step(at: Column, width: Column) -> Column:
        further = F.get(ordered, at + width - 1) <= place
        return F.when(further, at + width).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), step)


def in_slices(hot: DataFrame, hot_rows: int) -> DataFrame:
    """Loans of hot customers with their `slice`: ranges of (date, id), in order."""
    found = F.broadcast(splitters(hot, hot_rows))
    placed = hot.withColumn("place", _place(hot)).join(
        found, F.col("customer_id").eqNullSafe(F.col("split_id")), "left"
    )
    number = F.coalesce(_slice_of(F.col("place"), F.col("splitters")), F.lit(0))
    return placed.withColumn("slice", number).drop("slices", "split_id", "splitters")


def join_customers(loans: DataFrame, per_customer: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of loans with a relation that has one row per `customer_id`.

    Ordinary customers join as Spark sees fit. Those with more than `hot_rows` loans are
    few, so their rows of `per_customer` are broadcast and their loans stay where they are.
    """
    hot, same = _hot_match(loans, hot_rows)
    few = per_customer.join(hot, same, "left_semi")
    ordinary, of_hot = loans.join(hot, same, "left_anti"), loans.join(hot, same, "left_semi")
    return ordinary.join(per_customer, "customer_id").unionByName(
        of_hot.join(F.broadcast(few), "customer_id")
    )


def loan_sequence(loans: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number each customer's loans by date and id, and look back at the one before.

    Adds `loan_number`, `previous_loan_date`, `previous_loan_amount` and
    `previous_loan_dpd`. An ordinary customer is one window group. The loans of a hot
    customer are cut into slices that follow the order, each slice is numbered on its
    own, and a small relation of one row a slice supplies what came before it. No task
    sees a hot customer's loans at once.
    """
    ordinary, hot = split_hot(loans, hot_rows)
    return _numbered(ordinary, ["customer_id"], _ORDER).unionByName(_numbered_in_slices(hot, hot_rows))


_ORDER = ("origination_date", "loan_id")
_PREVIOUS = {
    "previous_loan_date": "origination_date",
    "previous_loan_amount": "loan_amount",
    "previous_loan_dpd": "days_past_due",
}


def _numbered(loans: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    in_order = Window.partitionBy(*group).orderBy(*order)
    return loans.withColumns(
        {
            "loan_number": F.row_number().over(in_order).cast("long"),
            **{new: F.lag(old).over(in_order) for new, old in _PREVIOUS.items()},
        }
    )


def _numbered_in_slices(hot: DataFrame, hot_rows: int) -> DataFrame:
    sliced = in_slices(hot, hot_rows)
    piece = ["customer_id", "slice"]
    last = F.max(F.struct("place", *_PREVIOUS.values())).alias("last")
    in_order = Window.partitionBy("customer_id").orderBy("slice")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*piece)
        .agg(F.count(F.lit(1)).alias("n"), last)
        .select(
            *(F.col(name).alias(f"{name}_") for name in piece),
            F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
            F.lag("last").over(in_order).alias("last_before"),
        )
    )
    local = _numbered(sliced, piece, ["place"]).join(starts, _null_safe(piece))
    opens_slice = F.col("loan_number") == 1
    return local.withColumns(
        {
            "loan_number": F.col("loan_number") + F.col("before"),
            **{
                new: F.when(opens_slice, F.col("last_before")[old]).otherwise(F.col(new))
                for new, old in _PREVIOUS.items()
            },
        }
    ).drop(*(f"{name}_" for name in piece), "slice", "place", "before", "last_before")


def _null_safe(names: Sequence[str]) -> Column:
    first, *rest = [F.col(name).eqNullSafe(F.col(f"{name}_")) for name in names]
    for condition in rest:
        first = first & condition
    return first


def with_previous_count(counts: DataFrame, ordinal: str, count: str, alias: str) -> DataFrame:
    """Add the `count` of the row whose `ordinal` is one less, as `alias`.

    Each row is sent to its own ordinal and to the next one, and the two meet there. A
    `lag` over an unpartitioned window would do the same in a single task, and there can
    be as many ordinals as the largest customer has loans.
    """
    here = F.col("ahead") == 0
    own = [name for name in counts.columns if name != ordinal]
    return (
        counts.withColumn("ahead", F.explode(F.array(F.lit(0), F.lit(1))))
        .groupBy((F.col(ordinal) + F.col("ahead")).alias(ordinal))
        .agg(
            *(F.max(F.when(here, F.col(name))).alias(name) for name in own),
            F.max(F.when(~here, F.col(count))).alias(alias),
            F.min("ahead").alias("nearest"),
        )
        .where("nearest = 0")
        .drop("nearest")
    )
