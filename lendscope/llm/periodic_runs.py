"""Periodic runs: stretches of a text that repeat a sequence of words three times or more.

A run of period q ends where a square (a sequence of q words, twice) cannot be moved right: the
two suffixes q words apart share q words exactly. So each run belongs to one LCP interval of
depth q of the suffix array. For many documents at once, as arrays:

1. A run makes two equal windows of `2/3 * min_length` words, so only documents in which such a
   window comes back go on; their hashes may let more through, never fewer.
2. Suffixes are sorted by prefix doubling, the document leading each key: suffixes of different
   documents never compare equal, and common passages of documents cost nothing. Ranks of all
   doublings are kept; equal ranks mean equal blocks of 1, 2, 4 ... words.
3. LCP values come from those ranks. A stack gives each boundary of the suffix array the
   intervals on both sides of it; ties are taken one child at a time.
4. Every suffix i of the smaller side looks up ISA[i + depth] and ISA[i - depth]: one that lies
   on the other side makes a square that cannot move right. There are no tree nodes.
5. Squares are rotated left as far as they go, by blocks of equal rank. Those that reach the
   least length are runs; squares of a multiple of the period give the same stretch, which
   keeps its smallest period.

Each document is worked on where it is read, with no shuffle. Work is n log^2 n at worst, in a
document's words; memory is bounded by a slice of a few MB of text, or one longer text (some
150 bytes a word of a text that has repeated windows).

Defined results: a null or empty text has no words, no runs and an empty collapsed text; rows
with equal ids, and null ids, are documents like any others; an empty table gives an empty
table; other columns are not carried, whatever their names. Runs are listed by start, then
period. Words are told apart by 64-bit hashes within a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm import native_text
from lendscope.llm import words as W

MIN_LENGTH = 24
MIN_EXPONENT = 3
FLAT = 4 << 20

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>,"
    " collapsed_text string"
)


class Runs(NamedTuple):
    """Runs of several documents: `start` counts from the first word of all."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


class Suffixes(NamedTuple):
    """Suffixes of consecutive documents in order, and ranks of their first 1, 2, 4 ... words.

    `order` has suffixes by slot, `slot` the slot of each suffix; a rank is the first slot of
    the suffixes that agree so far. One more entry, -1, stands behind the last word."""

    order: np.ndarray
    slot: np.ndarray
    ranks: list[np.ndarray]


def suffixes(codes: np.ndarray, first: np.ndarray) -> Suffixes:
    """`codes` are numbers of words, from 0; words first[d]:first[d + 1] are those of document d."""
    n = len(codes)
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ends = np.repeat(first[1:], np.diff(first))
    key = document * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    key = key[order]
    rank = np.full(n + 1, -1, np.int32)
    slots = np.arange(n)
    ranks, size = [], 1
    while True:
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = slots[np.flatnonzero(new)]
        group = np.cumsum(new) - 1
        rank[order[slots]] = start[group]
        ranks.append(rank.copy())
        shared = (np.bincount(group) > 1)[group] if len(group) else new
        slots = slots[shared]
        if not len(slots):
            return Suffixes(order, rank[:n].copy(), ranks)
        some = order[slots]
        # One suffix at most of a group ends here; it comes first.
        follows = np.where(some + size < ends[some], rank[some + size], -1).astype(np.int64)
        key = rank[some].astype(np.int64) * (n + 1) + follows + 1
        sorted_ = np.argsort(key, kind="stable")
        order[slots] = some[sorted_]
        key = key[sorted_]
        size *= 2


def shared_prefixes(found: Suffixes) -> np.ndarray:
    """LCP: how many words the suffix of each slot shares with the one before."""
    n = len(found.order)
    out = np.zeros(n, np.int64)
    near = np.flatnonzero(found.ranks[0][found.order[1:]] == found.ranks[0][found.order[:-1]]) + 1
    a, b = found.order[near - 1], found.order[near]
    shared = np.zeros(len(near), np.int64)
    for k in reversed(range(len(found.ranks))):
        rank = found.ranks[k]
        shared += (rank[a + shared] == rank[b + shared]).astype(np.int64) << k
    out[near] = shared
    return out


def _sides(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary: the boundary before it with a smaller value, and the next one whose
    value is not greater. The slots between are what the boundary splits."""
    values = lcp.tolist()
    before, after, stack = [0] * len(values), [len(values)] * len(values), []
    for at, value in enumerate(values):
        while stack and values[stack[-1]] >= value:
            after[stack.pop()] = at
        before[at] = stack[-1] if stack else 0
        stack.append(at)
    return np.array(before, np.int64), np.array(after, np.int64)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ranges low:high in turn, and the range of each."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size), owner


def squares(found: Suffixes, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square that cannot move right, of periods up to the `longest`
    of the document (given by word)."""
    lcp = shared_prefixes(found)
    before, after = _sides(lcp)
    at = np.flatnonzero((lcp > 0) & (lcp <= longest[found.order]))
    left, right, depth = before[at], after[at], lcp[at]
    small_left = at - left <= right - at
    low, high = np.where(small_left, left, at), np.where(small_left, at, right)
    other_low, other_high = np.where(small_left, at, left), np.where(small_left, right, at)
    ends = np.cumsum(high - low)
    starts, periods, a, n = [], [], 0, len(found.order)
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + FLAT)))
        slot, own = _spread(low[a:b], high[a:b])
        suffix, step = found.order[slot], depth[a:b][own]
        for there in (suffix + step, suffix - step):
            near = np.flatnonzero((there >= 0) & (there < n))
            slot_there = found.slot[there[near]]
            hit = near[(slot_there >= other_low[a:b][own[near]]) & (slot_there < other_high[a:b][own[near]])]
            starts.append(np.minimum(suffix[hit], there[hit]))
            periods.append(step[hit])
        a = b
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def rotated(found: Suffixes, start: np.ndarray, period: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """By how many words each square moves left, at most to the `begin` of its document."""
    moved = np.zeros(len(start), np.int64)
    for k in reversed(range(len(found.ranks))):
        to = start - moved - (1 << k)
        inside = np.flatnonzero(to >= begin)
        to = to[inside]
        same = found.ranks[k][to] == found.ranks[k][to + period[inside]]
        moved[inside[same]] += 1 << k
    return moved


def runs_of(
    codes: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> Runs:
    """All runs of consecutive documents, by start and period."""
    if not len(codes):
        return Runs(*(np.zeros(0, np.int64) for _ in range(3)))
    found = suffixes(codes, first)
    sizes = np.diff(first)
    start, period = squares(found, np.repeat(sizes // min_exponent, sizes))
    begin = np.repeat(first[:-1], sizes)[start]
    # Most squares do not move at all.
    least = np.maximum(min_length, min_exponent * period)
    may = (2 * period >= least) | ((start > begin) & (codes[start - 1] == codes[start + period - 1]))
    start, period, begin, least = start[may], period[may], begin[may], least[may]
    moved = rotated(found, start, period, begin)
    start, length = start - moved, 2 * period + moved
    long = length >= least
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[smallest], length[smallest], period[smallest]
    order = np.lexsort((period, start))
    return Runs(start[order], length[order], period[order])


def _with_repeats(words: W.Words, hashes: np.ndarray, window: int) -> np.ndarray:
    """Documents in which some window of that many words comes back."""
    inside = W.whole(words, window)
    owner = W.owners(words)[: len(inside)][inside].astype(np.uint64)
    value = W.mix(W.windows(hashes, window)[inside] + owner)
    order = np.argsort(value)
    same = value[order[1:]] == value[order[:-1]]
    return np.unique(owner[order[1:][same]]).astype(np.int64)


def _runs_of_slice(words: W.Words, min_length: int, min_exponent: int) -> Runs:
    """Runs of a slice of texts; `start` is a place in `words`."""
    hashes = W.hashes(words)
    # A run of period q repeats its first length - q words: at least this many, whatever q is.
    window = min(
        max(min_length - q, (min_exponent - 1) * q) for q in range(1, max(2, min_length))
    )
    docs = _with_repeats(words, hashes, window)
    place, _ = _spread(words.first[docs], words.first[docs + 1])
    codes = np.unique(hashes[place], return_inverse=True)[1].astype(np.int64)
    first = np.concatenate([[0], np.cumsum(words.first[docs + 1] - words.first[docs])]).astype(np.int64)
    runs = runs_of(codes, first, min_length, min_exponent)
    return Runs(place[runs.start], runs.length, runs.period)


def _found(min_length: int, min_exponent: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in W.slices(batch.column(1)):
                words = W.split(*W.raw(batch.column(1).slice(a, b - a)))
                runs = _runs_of_slice(words, min_length, min_exponent)
                total = len(words.start)
                # Whatever comes after a run's first period is covered.
                change = np.bincount(runs.start + runs.period, minlength=total + 1)
                change = change - np.bincount(runs.start + runs.length, minlength=total + 1)
                text, bounds = W.joined(words, np.cumsum(change)[:total] == 0)
                edges = np.searchsorted(runs.start, words.first)
                begin = words.first[np.searchsorted(words.first, runs.start, side="right") - 1]
                cells = [pa.array(x, pa.int64()) for x in (runs.start - begin, runs.length, runs.period)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(edges, pa.int32()), pa.StructArray.from_arrays(cells, fields=list(RUN))
                        ),
                        pa.StringArray.from_buffers(
                            b - a, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(text)
                        ),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed_text"],
                )

    return found


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words) and collapsed_text: the words that
    no run covers after its first period, joined by one space."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("runs are of two words and two periods at least")
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    return rows.mapInArrow(_found(min_length, min_exponent), FOUND)


def _made_periodic(docs: DataFrame) -> DataFrame:
    """Documents, a tenth of them with a periodic rest: from word a on, p words over and over."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h")).select(
        "doc_id",
        "text",
        F.floor(F.col("h") / 10).alias("g"),
        F.when(F.col("h") % 10 == 0, native_text.words(F.col("text"))).alias("words"),
    )
    n, g = F.size("words"), F.col("g")
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    rest = F.slice(again, F.lit(1), n - a)
    periodic = F.array_join(F.concat(F.slice("words", F.lit(1), a), rest), " ")
    some = F.col("words").isNotNull() & (n > 0)
    return chosen.select("doc_id", F.when(some, periodic).otherwise(F.col("text")).alias("text"))


def _best(runs: Column) -> Column:
    """Of greatest length over period, then least start, then least period. Quotients of whole
    numbers below 9 * 10^7 differ as doubles unless they are equal."""
    rated = F.transform(
        runs,
        lambda r: F.struct(
            (r["length"] / r["period"]).alias("exponent"),
            (-r["start"]).alias("start"),
            (-r["period"]).alias("period"),
            r["length"].alias("length"),
        ),
    )
    return F.array_max(rated)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(_made_periodic(docs)).withColumn("best", _best(F.col("runs")))
    line = lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"),
        F.lit("\n"),
    )
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
