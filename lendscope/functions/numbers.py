"""Division, rounding and labelling rules that every operator shares."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """`numerator / denominator` as a double; NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def pct(numerator: Column, denominator: Column) -> Column:
    """`numerator` as a percentage of `denominator`, to two decimals."""
    return round_to(ratio(numerator, denominator) * 100, 2)


def round_to(value: Column, digits: int) -> Column:
    """Round half up in decimal arithmetic, and return a double.

    Going through a decimal makes ties such as 1.005 round the way they read, and
    keeps sums of money exact up to the rounding itself.
    """
    return F.round(value.cast("decimal(38,10)"), digits).cast("double")


def label(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The label of the first condition that holds, else `default`."""
    first, *rest = cases
    chain = reduce(lambda acc, case: acc.when(case[0], case[1]), rest, F.when(*first))
    return chain if default is None else chain.otherwise(default)


def band(value: Column, edges: Sequence[int]) -> Column:
    """Name the half-open band that `value` falls in; NULL counts as the top band."""
    low, top = edges[0], edges[-1]
    inner = [(value < hi, f"{lo}-{hi - 1}") for lo, hi in zip(edges, edges[1:])]
    return label([(value < low, f"< {low}"), *inner], f"{top}+")


def band_names(edges: Sequence[int]) -> list[str]:
    """The names `band` gives, in ascending order."""
    low, top = edges[0], edges[-1]
    return [f"< {low}", *(f"{lo}-{hi - 1}" for lo, hi in zip(edges, edges[1:])), f"{top}+"]


def place_in(value: Column, ordered: Sequence[str]) -> Column:
    """Position of `value` in a fixed list, as a sort key; anything else comes last."""
    return label([(value == name, i) for i, name in enumerate(ordered)], len(ordered))


def joined(values: Column) -> Column:
    """Comma-separated text of an array; NULL when the array is empty."""
    return F.when(F.size(values) > 0, F.array_join(values, ", "))
