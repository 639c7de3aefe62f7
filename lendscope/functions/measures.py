"""Aggregates over loans, each defined once.

Money sums are exact, so they do not depend on the order in which executors deliver
their parts.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.functions.numbers import pct, ratio

NON_PERFORMING = ("Defaulted", "Written Off")
PAR_DAYS = 30
_SPLIT_BITS = 20

#: Figures that are doubles are averaged over their sum in this type: those of 10^18 and above
#: end the query.
_FIGURE = "decimal(28,10)"

#: Digits before the point that a long of hundredths holds with any two decimals, and those of
#: a rate whose product with the high bits of such an amount is still a long.
LONG_DIGITS, RATE_DIGITS = 16, 4


def overdue(days: int = PAR_DAYS) -> Column:
    """Whether a loan is more than `days` days past due."""
    return F.col("days_past_due") > days


def non_performing() -> Column:
    return F.col("status").isin(*NON_PERFORMING)


def loans() -> Column:
    return F.count(F.lit(1))


def _declared(value: Column, digits: int) -> Column:
    """Whether a column's type has at most two decimals and `digits` digits before them.

    It is a constant of the plan: the optimizer folds it, and with it goes the accumulator that
    the schema rules out. It knows the schema where this function does not. Outside of
    aggregates the type is that of the maximum, which the folding removes as well.
    """
    kinds = "|".join(f"{_up_to(digits + scale)},{scale}" for scale in range(3))
    return F.typeof(value).rlike(rf"^decimal\(({kinds})\)$")


def _up_to(n: int) -> str:
    """A pattern for the numbers 1 to n, of two digits at most."""
    return f"([1-9]|1[0-{n - 10}])" if n >= 10 else f"[1-{n}]"


def _hundredths(name: str) -> Column:
    """A value in hundredths, as a long; the double is exact below 10^13."""
    value = F.col(name)
    as_double = value.cast("double")
    small = F.rint(as_double * 100).cast("long")
    is_small = _declared(value, 12) | (F.abs(as_double) < 1e13)
    return F.when(is_small, small).otherwise((value * 100).cast("long"))


def _low(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << _SPLIT_BITS) - 1))


def _high(value: Column) -> Column:
    return F.shiftright(value, _SPLIT_BITS)


def _put_together(scale: int, *limbs: Column) -> Column:
    """The decimal that sums of limbs, highest first, are in units of 10^-scale."""
    whole = limbs[0].cast("decimal(20,0)")
    for limb in limbs[1:]:
        whole = (whole * F.lit(Decimal(1 << _SPLIT_BITS))).cast("decimal(38,0)") + limb
    return (whole.cast("decimal(38,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal({24 + scale},{scale})")


def _exact_sum(units: Column, scale: int) -> Column:
    """Decimal sum of longs that count units of 10^-scale.

    Summing a decimal column keeps a wide decimal per group, which costs more than twice
    the time of longs. A long sum would overflow on a large book. So the high and the low
    bits are summed apart, which is good for 10^12 loans, and put together in the result.
    """
    return _put_together(scale, F.sum(_high(units)), F.sum(_low(units)))


def money(name: str, condition: Column | None = None) -> Column:
    """Exact sum of an amount, or of the amounts where a condition holds (0 if it holds
    nowhere). Types of more digits than the longs hold are summed as decimals."""
    units, value = _hundredths(name), F.col(name)
    if condition is not None:
        units, value = (F.when(condition, x).otherwise(0) for x in (units, value))
    fits = _declared(F.max(name), LONG_DIGITS)
    return F.when(fits, _exact_sum(units, 2)).otherwise(F.sum(value))


def amount() -> Column:
    return money("loan_amount")


def amount_where(condition: Column) -> Column:
    return money("loan_amount", condition)


def loss() -> Column:
    return money("actual_loss")


def expected_loss() -> Column:
    return money("expected_loss")


def income() -> Column:
    """One year of simple interest: amount times rate, which is in percent.

    The amount's high and low bits are multiplied apart, so that products of all amounts and
    rates that the types allow are exact in three sums of longs. Wider and finer types are
    multiplied and summed as decimals.
    """
    amount_, rate = _hundredths("loan_amount"), _hundredths("interest_rate")
    lower = _low(amount_) * rate
    upper = _high(amount_) * rate + _high(lower)
    longs = _put_together(6, F.sum(_high(upper)), F.sum(_low(upper)), F.sum(_low(lower)))
    fits = _declared(F.max("loan_amount"), LONG_DIGITS) & _declared(F.max("interest_rate"), RATE_DIGITS)
    percent = F.col("interest_rate") * F.lit(Decimal("0.01"))
    return F.when(fits, longs).otherwise(F.sum(F.col("loan_amount") * percent))


def net_profit() -> Column:
    return income() - loss()


def mean(name: str) -> Column:
    """Average as sum over count, so that decimals average like integers do."""
    return ratio(F.sum(name), F.count(name))


def mean_of_means(name: str | Column) -> Column:
    """Average of figures that are doubles, over their sum as decimals: the same whatever
    order the rows come in."""
    value = F.col(name) if isinstance(name, str) else name
    return ratio(F.sum(value.cast(_FIGURE)), F.count(value))


def exact_mean(name: str) -> Column:
    """Sum and count of figures that are doubles, for `merged_mean` to put together."""
    return F.struct(F.sum(F.col(name).cast(_FIGURE)).alias("sum"), F.count(name).alias("count"))


def merged_mean(name: str) -> Column:
    """Average of figures from several `exact_mean`s: the same as `mean_of_means` over all."""
    return ratio(F.sum(F.col(name)["sum"]), F.sum(F.col(name)["count"]))


def mean_money(name: str) -> Column:
    """Average of a two-decimal column over its exact sum."""
    return ratio(money(name), F.count(name))


def par_rate(days: int = PAR_DAYS) -> Column:
    """Share of the amount that is more than `days` days past due, in percent."""
    return pct(amount_where(overdue(days)), amount())


def loss_rate() -> Column:
    return pct(loss(), amount())


def net_return() -> Column:
    return pct(net_profit(), amount())


def loss_variance() -> Column:
    """How far actual losses exceed expected losses, in percent of the expected."""
    return pct(loss() - expected_loss(), expected_loss())


def distinct_ids(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """Exact number of distinct ids, whole numbers of any size and sign: a row with the column
    `name`, for each group of `by` if any. NULLs do not count.

    Ids are bits of words of 64, merged on the map side, so what is shuffled is one word for all
    ids of a task that lie in it: a word for each id at worst, and far less where ids are dense
    and loans of neighbouring ids stored together.
    """
    number = F.col(name).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))
    words = rows.groupBy(*by, F.shiftright(number, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy(*by).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).alias(name))


def distinct_values(name: str) -> Column:
    """Sorted array of the non-NULL values of a low-cardinality column.

    `collect_set` merges on the map side and holds at most the distinct values, so a
    customer with very many loans costs no more than any other.
    """
    return F.array_sort(F.collect_set(name))


def share_of_rows(name: str) -> Column:
    """`name` in percent of its total over all rows.

    The window is unpartitioned: use it on aggregated rows only, one per group.
    """
    return pct(F.col(name), F.sum(name).over(Window.partitionBy()))


def days_since(day: Column, as_of: date | None) -> Column:
    """Whole days from `day` to `as_of`, or to today when `as_of` is None."""
    today = F.current_date() if as_of is None else F.lit(as_of)
    return F.datediff(today, day).cast("long")


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")
