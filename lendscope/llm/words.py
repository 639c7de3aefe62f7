"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

For operators whose work per word is too fine for columns of built-in functions. Batches are
cut into slices of a few MB of text, which bounds the arrays; a longer text is a slice alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


class Words(NamedTuple):
    """Words of consecutive texts. `text` has the bytes of all texts, `bounds` where each one
    starts and the last ends; word k is text[start[k]:end[k]], and words
    first[i]:first[i + 1] are those of text i."""

    text: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows with at most `limit` bytes of text each, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield a, b
        a = b


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the bounds of its texts; null counts as empty."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[bounds[0] : bounds[-1]], bounds - bounds[0]


def lowered(text: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((text >= 0x41) & (text <= 0x5A), text | 0x20, text)


def split(text: np.ndarray, bounds: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """`cuts` tells bytes at which a word begins whatever precedes."""
    inside = ~_SEPARATES[text]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    if cuts is not None:
        starts |= inside & cuts
        ends[:-1] |= inside[:-1] & cuts[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(text))]
    starts[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start = np.flatnonzero(starts)
    return Words(text, bounds, start, np.flatnonzero(ends) + 1, np.searchsorted(start, bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finishing steps of a common 64-bit generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers made before, up to so many of a base.
CACHED_POWERS = 1 << 22
_known_powers: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _known_powers.get(base)
    if known is not None and len(known) >= n:
        return known[:n]
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= CACHED_POWERS:
        out.flags.writeable = False
        _known_powers[base] = out
    return out


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash for each word: a polynomial over its bytes, from running sums."""
    n = len(words.text)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[words.text] * _powers(_MULTIPLIER, n), out=sums[1:])
    shifted = (sums[words.end] - sums[words.start]) * _powers(_INVERSE, n)[words.start]
    return mix(shifted ^ ((words.end - words.start).astype(np.uint64) << np.uint64(40)))


def windows(values: np.ndarray, size: int, multiplier: int = _MULTIPLIER) -> np.ndarray:
    """A 64-bit hash for each run of `size` values: an order-dependent sum, made by doubling."""
    power = lambda n: np.uint64(pow(multiplier, n, 1 << 64))
    count = max(0, len(values) - size + 1)
    out, covered = np.zeros(count, np.uint64), 0
    block, length, rest = values, 1, size
    while rest:
        if rest & 1:
            out = out + block[covered : covered + count] * power(covered)
            covered += length
        rest >>= 1
        if rest:
            block = block[: len(block) - length] + block[length:] * power(length)
            length *= 2
    return mix(out)


def whole(words: Words, size: int) -> np.ndarray:
    """Of all runs of `size` words (as `windows` has them), which lie in one text."""
    count = max(0, len(words.start) - size + 1)
    owner = owners(words)
    return owner[:count] == owner[size - 1 : size - 1 + count]


def owners(words: Words) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))


def joined(words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The texts of all words, or those to keep, joined by one space, and their bounds."""
    start, end, owner = words.start, words.end, owners(words)
    if keep is not None:
        start, end, owner = start[keep], end[keep], owner[keep]
    size = end - start
    more = np.zeros(len(start), bool)  # another word of the same text follows
    more[:-1] = owner[1:] == owner[:-1]
    begin = np.cumsum(size + more) - size - more
    counts = np.bincount(owner, size + more, len(words.first) - 1).astype(np.int64)
    text = np.full(int(counts.sum()), 0x20, np.uint8)
    place = np.arange(int(size.sum()))
    shift = np.cumsum(size) - size
    text[place + np.repeat(begin - shift, size)] = words.text[place + np.repeat(start - shift, size)]
    return text, np.concatenate([[0], np.cumsum(counts)])
