"""Business rules as data: ordered tables that compile into one projection.

A test compares a column, or a SQL expression over columns, with a constant. A rule holds when
all tests of one of its alternatives do. Of rules that overlap, the first one counts. A test of
NULL does not hold, as in SQL, so a row with NULLs falls through to what does not need them.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
    "=": operator.eq,
    "<>": operator.ne,
}


class Test(NamedTuple):
    """`of` is a column or a SQL expression; `by` a comparison of _COMPARE, or "in"."""

    __test__ = False  # not a case for pytest

    of: str
    by: str
    value: object

    def holds(self) -> Column:
        value = F.expr(self.of)
        if self.by == "in":
            return value.isin(*self.value)
        if self.by not in _COMPARE:
            raise ValueError(f"{self.of}: no comparison {self.by!r}")
        return _COMPARE[self.by](value, F.lit(self.value))


class Rule(NamedTuple):
    """A name, and alternatives of which each is a list of tests that must all hold."""

    name: object
    alternatives: Sequence[Sequence[Test]]

    def holds(self) -> Column:
        if not self.alternatives or not all(self.alternatives):
            raise ValueError(f"rule {self.name!r} has an alternative without tests")
        every = (reduce(operator.and_, (test.holds() for test in tests)) for tests in self.alternatives)
        return reduce(operator.or_, every)


def rule(name: object, *tests: tuple, alternatives: Sequence[Sequence[tuple]] = ()) -> Rule:
    """A rule from plain tuples: all of `tests`, or all of one of the `alternatives`."""
    lists = ([tests] if tests else []) + list(alternatives)
    return Rule(name, tuple(tuple(Test(*test) for test in some) for some in lists))


class RuleTable(NamedTuple):
    """Rules in order of precedence, and what to call a row that none of them fits."""

    rules: Sequence[Rule]
    default: object = None

    def first(self) -> Column:
        """The name of the first rule that holds, else the default."""
        names = [each.name for each in self.rules]
        if len(set(names)) < len(names):
            raise ValueError(f"rules of the same name: {names}")
        if not self.rules:
            return F.lit(self.default)
        first, *rest = self.rules
        chain = F.when(first.holds(), F.lit(first.name))
        for each in rest:
            chain = chain.when(each.holds(), F.lit(each.name))
        return chain.otherwise(F.lit(self.default))

    def any(self) -> Column:
        """Whether some rule holds; NULL where that depends on NULLs."""
        return reduce(operator.or_, (each.holds() for each in self.rules), F.lit(False))

    def all_names(self) -> Column:
        """Names of all rules that hold, in order: where they overlap there are several."""
        return F.array_compact(F.array(*(F.when(each.holds(), F.lit(each.name)) for each in self.rules)))


class Points(NamedTuple):
    """Points for a row whose test holds: `points`, or as many times the expression `per`."""

    test: Test
    points: float
    per: str | None = None

    def scored(self) -> Column:
        points = F.lit(self.points)
        gained = points if self.per is None else F.expr(self.per) * points
        return F.when(self.test.holds(), gained).otherwise(0)


class Score(NamedTuple):
    """A score that starts somewhere and gains or loses points; it is not clamped."""

    start: float
    terms: Sequence[Points]

    def value(self) -> Column:
        return reduce(operator.add, (term.scored() for term in self.terms), F.lit(self.start))
