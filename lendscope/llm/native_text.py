"""Text as columns: built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words; every other character belongs to one.
SPACES = " \t\n\x0b\x0c\r"
SEPARATORS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, SEPARATORS)).otherwise(
        F.array().cast("array<string>")
    )


def without(text: Column, characters: Sequence[str]) -> Column:
    """The text less some characters; plain replacements are faster than translate()."""
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def tail(array: Column, start: int) -> Column:
    """The elements from `start` (1 is the first) on."""
    return F.slice(array, F.lit(start), F.greatest(F.size(array) - (start - 1), F.lit(0)))
