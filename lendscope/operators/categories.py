"""Categories at customer grain as numbers, so that aggregates hash.

Spark can hash-aggregate fixed-width buffers only; a minimum of a struct makes it sort the
loans by customer first, and a set of texts is gathered object by object. A date and a loan id
side by side in one decimal do not, nor do the bits of a set whose names are known.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BEFORE_ALL_DATES = -10_000_000
_BITS = 63

#: Names up to which a column is coded: two longs of bits. More take the way by text.
MOST_NAMES = 2 * _BITS


def place() -> Column:
    """Sorts like (origination_date, loan_id), NULL dates first; 20 digits hold any long."""
    day = F.coalesce(F.unix_date("origination_date"), F.lit(_BEFORE_ALL_DATES))
    return day.cast("decimal(8,0)") * F.lit(Decimal(10) ** 20) + F.col("loan_id")


def first_place() -> Column:
    """Aggregate: the place of the earliest loan."""
    return F.min(place())


class Coded:
    """A text column whose distinct names are known: each has a number, in sorted order."""

    def __init__(self, column: str, names: Sequence[str]):
        self.column = column
        self.names = sorted(names, key=str.encode)

    def code(self) -> Column:
        """From 0; NULL for NULL. A name that is not known ends the query."""
        value = F.col(self.column)
        if not self.names:
            return F.when(value.isNotNull(), self._unknown(value))
        codes = F.create_map(*(F.lit(x) for pair in zip(self.names, range(len(self.names))) for x in pair))
        return F.when(value.isNotNull(), F.coalesce(F.try_element_at(codes, value), self._unknown(value)))

    def _unknown(self, value: Column) -> Column:
        told = F.concat(F.lit(f"{self.column} has a name that was not there before: "), value)
        return F.raise_error(told).cast("int")

    def _words(self) -> range:
        return range(0, max(1, len(self.names)), _BITS)

    def masks(self) -> dict[str, Column]:
        """Aggregates: the set of names in a group, as bits of as many longs as names need."""
        code = self.code()

        def bits(first: int) -> Column:
            own = code - first
            if len(self._words()) > 1:
                own = F.when((code >= first) & (code < first + _BITS), own)
            return F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), own)), F.lit(0))

        return {f"{self.column}_bits_{first}": bits(first) for first in self._words()}

    def held(self) -> Column:
        """The names of a set, sorted, from the columns of `masks`."""
        parts = []
        for first in self._words():
            some, mask = self.names[first : first + _BITS], F.col(f"{self.column}_bits_{first}")
            listed = F.array(*map(F.lit, some)).cast("array<string>")
            parts.append(F.filter(listed, lambda _, i: F.getbit(mask, i) == 1))  # noqa: B023
        return F.concat(*parts)

    def size(self) -> Column:
        """How many names a set has."""
        first, *more = (F.bit_count(F.col(f"{self.column}_bits_{first}")) for first in self._words())
        for part in more:
            first = first + part
        return first.cast("long")

    def first(self) -> Column:
        """Aggregate: the earliest loan and its name in one number, for `name_of_first`. Of
        equal places the least name counts, NULL before all."""
        return F.min(place() * F.lit(Decimal(1000)) + F.coalesce(self.code() + 1, F.lit(0)))

    def name_of_first(self, first: Column) -> Column:
        code = F.pmod(first, F.lit(Decimal(1000))).cast("int")
        listed = F.array(*map(F.lit, self.names)).cast("array<string>")
        return F.when(code > 0, F.get(listed, code - 1))


def coded(loans: DataFrame, column: str, most: int = MOST_NAMES) -> Coded | None:
    """The column's distinct names, by a job over this column alone that returns at most
    `most + 1` of them; None if there are more."""
    names = loans.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    return None if len(names) > most else Coded(column, [row[0] for row in names])
