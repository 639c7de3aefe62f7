"""Benchmark decontamination: passages within a small edit distance of a benchmark item.

Texts and items are words in lower case without ASCII punctuation; distances count words.
Each item is cut into windows of a size class of about three quarters of its length, at
every offset; documents into windows of the same sizes, a quarter of a window apart, so any
passage holds some that line up with one of the item's. A random walk embeds a window (CGK):
at each step it writes the current word, and a random function of the step and that word
says whether to go on to the next, so that after an edit two walks soon fall in step again,
and few places of the two outputs differ. Bit-sampling takes some places of the output as a
key, again and again with other places and other walks. The number of repetitions follows
from the share of keys that meet between items and copies of them edited at random, as far
as a match may be. Where the most repetitions do not reach the target recall, as with long
items, an item of k edits at most is keyed by k + 1 pieces instead, one of which every match
has whole. Where keys meet, the edit distance of the whole item to the
best-fitting passage is computed and decides.

Documents are read once for each block of items and never shuffled; a block has at most
`max_keys` keys, which bounds what is broadcast.

Defined results: a null or empty text matches nothing, nor does an item without words;
repeated rows, documents or items, are judged one by one; ids may be null and are carried;
an empty table of either kind gives no matches and drops nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm import words as W

#: A passage matches within this share of the item's words.
MAX_EDIT = 0.15
#: Copies at the largest distance that matches are to be found with this probability.
RECALL = 0.95
PLACES = 6
#: Repetitions at most and walks, to be tried in this order; and copies that judge a class.
LEVELS = ((24, 2), (48, 4))
TRIALS = 200
MAX_KEYS = 4_000_000
#: Windows whose keys are made at once, and bytes of text: what a task holds is some tens of MB.
BLOCK = 1 << 14
SLICE_BYTES = 1 << 20
FILTER_BITS = 22

MATCHES = "doc_id long, item_id long, start long, end long, start_word long, end_word long, distance long"

_ONE = np.uint64(1)


def normalised(text: np.ndarray, bounds: np.ndarray) -> tuple[W.Words, np.ndarray]:
    """Words in lower case without ASCII punctuation, and the place in `text` of each byte kept."""
    punctuation = (text > 0x20) & (text < 0x80) & ~(
        (text >= 0x30) & (text <= 0x39) | ((text | 0x20) >= 0x61) & ((text | 0x20) <= 0x7A)
    )
    kept = np.flatnonzero(~punctuation)
    return W.split(W.lowered(text[kept]), np.searchsorted(kept, bounds)), kept


class Sizes(NamedTuple):
    window: int
    stride: int


def size_class(length: int) -> Sizes:
    """The class of items of `length` words: windows that grow by steps of about 1.4."""
    window = max(1, math.ceil(0.75 * length)) if length < 6 else int(0.75 * length)
    if window > 4:
        step = int(math.log(window / 4) / math.log(1.4) + 1e-9)
        window = int(4 * 1.4**step)
    return Sizes(window, max(1, window // 4))


class Scheme(NamedTuple):
    """Random choices of one size class: factors of the walks by (walk, step), and by
    repetition its walk, the steps it samples, and their coefficients."""

    sizes: Sizes
    turns: np.ndarray
    walk: np.ndarray
    places: np.ndarray
    coefficients: np.ndarray


def scheme(sizes: Sizes, repetitions: int, places: int = PLACES, walks: int = LEVELS[0][1]) -> Scheme:
    random = np.random.default_rng(sizes.window)
    steps = 2 * sizes.window
    odd = lambda *shape: random.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + _ONE
    return Scheme(
        sizes,
        odd(walks, steps),
        np.arange(repetitions) % walks,
        np.stack([random.choice(steps, places, replace=steps < places) for _ in range(repetitions)]),
        odd(repetitions, places),
    )


def keys(symbols: np.ndarray, starts: np.ndarray, plan: Scheme) -> np.ndarray:
    """Keys of the windows that begin at `starts`, by (repetition, window)."""
    repetitions = len(plan.walk)
    out = np.zeros((repetitions, len(starts)), np.uint64)
    padded = np.append(symbols, np.uint64(0))
    nothing = len(symbols)
    sampled = [[[] for _ in range(plan.turns.shape[1])] for _ in range(len(plan.turns))]
    for r in range(repetitions):
        for place, coefficient in zip(plan.places[r], plan.coefficients[r], strict=True):
            sampled[plan.walk[r]][place].append((r, coefficient))
    for a in range(0, len(starts), BLOCK):
        begin = starts[a : a + BLOCK]
        end = begin + plan.sizes.window
        for walk, turns in enumerate(plan.turns):
            at = begin.copy()
            for step, turn in enumerate(turns):
                symbol = padded[np.where(at < end, at, nothing)]
                for r, coefficient in sampled[walk][step]:
                    out[r, a : a + BLOCK] += symbol * coefficient
                at += ((symbol * turn) >> np.uint64(63)).astype(np.int64)
    # A key also tells its class and repetition.
    tags = W.mix(np.arange(repetitions, dtype=np.uint64) + np.uint64(plan.sizes.window << 20) + _ONE)
    for own, tag in zip(out, tags, strict=True):
        own[:] = W.mix(own + tag)
    return out


def edited(item: np.ndarray, random: np.random.Generator, rate: float) -> np.ndarray:
    """A copy with that share of its words, rounded down, each replaced, dropped or followed by
    another: a third of the draws each."""
    chosen = np.zeros(len(item), bool)
    chosen[random.choice(len(item), int(rate * len(item)), replace=False)] = True
    out = []
    for word, edit in zip(item, chosen, strict=True):
        kind = int(random.integers(0, 3)) if edit else -1
        if kind != 1:
            out.append(random.integers(1, 1 << 62, dtype=np.uint64) if kind == 0 else word)
        if kind == 2:
            out.append(random.integers(1, 1 << 62, dtype=np.uint64))
    return np.array(out, np.uint64)


def _owners(parts: list[np.ndarray]) -> np.ndarray:
    return np.repeat(np.arange(len(parts)), [len(part) for part in parts])


def _together(starts: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Starts within each text as starts within all of them, one after the other."""
    shift = np.cumsum([0, *(len(text) for text in texts)])
    return np.concatenate([own + by for own, by in zip(starts, shift, strict=False)])


def plan_for(
    items: list[np.ndarray], sizes: Sizes, rate: float = MAX_EDIT, recall: float = RECALL, trials: int = TRIALS
) -> Scheme | None:
    """The fewest repetitions by which the edited copy of an item meets it, at any window, with
    probability `recall`, and a standard error of the trials more; None if the most do not."""
    goal = recall + math.sqrt(recall * (1 - recall) / trials)
    random = np.random.default_rng(1)
    of = np.arange(trials) % len(items)
    used = items[:trials]
    copies = [edited(used[i], random, rate) for i in of]
    # Without a window inside the copy nothing meets.
    inside = [
        np.arange(shift, max(shift, len(copy) - sizes.window + 1), sizes.stride)
        for copy, shift in zip(copies, random.integers(0, sizes.stride, trials), strict=True)
    ]
    whole = [np.arange(len(item) - sizes.window + 1) for item in used]
    own_of, copy_of = _owners(whole), _owners(inside)
    own_tag, copy_tag = W.mix(own_of.astype(np.uint64)), W.mix(of[copy_of].astype(np.uint64))
    for many, walks in LEVELS:
        plan = scheme(sizes, many, walks=walks)
        own = keys(np.concatenate(used), _together(whole, used), plan) ^ own_tag
        other = keys(np.concatenate(copies), _together(inside, copies), plan) ^ copy_tag
        met = np.zeros((trials, many), bool)
        for r in range(many):
            met[copy_of[np.isin(other[r], own[r])], r] = True
        share = np.logical_or.accumulate(met, axis=1).mean(axis=0)
        enough = np.flatnonzero(share[walks - 1 :] >= goal)
        if len(enough):
            n = walks + int(enough[0])
            return plan._replace(
                walk=plan.walk[:n], places=plan.places[:n], coefficients=plan.coefficients[:n]
            )
    return None


def pieces(length: int, max_edit: float) -> tuple[int, np.ndarray]:
    """Size and offsets of pieces of an item, one more than a match may have edits. An edit
    spoils one piece at most, so every match has some piece whole."""
    count = int(max_edit * length) + 1
    return max(1, length // count), np.arange(count) * length // count


def piece_keys(symbols: np.ndarray, size: int) -> np.ndarray:
    return W.mix(W.windows(symbols, size) ^ W.mix(np.array([size], np.uint64)))


class Items(NamedTuple):
    """A block of items, as broadcast; `pieces` are the sizes in use. Entries of `key` are sorted; each belongs to the window
    at `offset` of an item."""

    ids: list
    words: list[np.ndarray]
    schemes: list[Scheme]
    pieces: list[int]
    key: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    maybe: np.ndarray


def _sent(spark, items: Items):
    """Broadcast a block as plain tuples and arrays, which need no class of this library."""
    schemes = [(tuple(plan.sizes), *plan[1:]) for plan in items.schemes]
    return spark.sparkContext.broadcast(tuple(items._replace(schemes=schemes)))


def _received(value: tuple) -> Items:
    items = Items(*value)
    return items._replace(schemes=[Scheme(Sizes(*plan[0]), *plan[1:]) for plan in items.schemes])


def _low(key: np.ndarray) -> np.ndarray:
    return (key & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


class Plans(NamedTuple):
    """Words of items, and the classes: the scheme of each, or None for pieces, and its items."""

    words: list[np.ndarray]
    classes: list[tuple[Scheme | None, list[int]]]
    max_edit: float

    def count(self) -> int:
        """How many keys the items have."""
        return sum(
            len(plan.walk) * (len(self.words[i]) - plan.sizes.window + 1)
            if plan
            else int(self.max_edit * len(self.words[i])) + 1
            for plan, members in self.classes
            for i in members
        )


def planned(rows: list[tuple[object, str | None]], max_edit: float = MAX_EDIT) -> Plans:
    texts = pa.array([text for _, text in rows], pa.string())
    words, _ = normalised(*W.raw(texts))
    symbols = W.hashes(words)
    lists = [symbols[words.first[i] : words.first[i + 1]] for i in range(len(rows))]
    classes: dict[Sizes, list[int]] = {}
    for i, item in enumerate(lists):
        if len(item):
            classes.setdefault(size_class(len(item)), []).append(i)
    plans = [
        (plan_for([lists[i] for i in members], sizes, max_edit), members)
        for sizes, members in sorted(classes.items())
    ]
    return Plans(lists, plans, max_edit)


def prepared(
    rows: list[tuple[object, str | None]], max_edit: float = MAX_EDIT, plans: Plans | None = None
) -> Items:
    lists, classes, _ = plans or planned(rows, max_edit)
    schemes, sizes, key, item, offset = [], set(), [], [], []
    for plan, members in classes:
        if plan:
            schemes.append(plan)
        for i in members:
            if plan:
                at = np.arange(len(lists[i]) - plan.sizes.window + 1)
                own = keys(lists[i], at, plan)
            else:
                size, at = pieces(len(lists[i]), max_edit)
                sizes.add(size)
                own = piece_keys(lists[i], size)[at][None, :]
            key.append(own.ravel())
            item.append(np.full(own.size, i))
            offset.append(np.tile(at, len(own)))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    key, item, offset = join(key, np.uint64), join(item, np.int64), join(offset, np.int64)
    order = np.argsort(key, kind="stable")
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[_low(key)] = True
    ids = [i for i, _ in rows]
    return Items(ids, lists, schemes, sorted(sizes), key[order], item[order], offset[order], maybe)


def best_fit(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to any run of the region, and where that run ends."""
    places = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item):
        step = np.minimum(row[:-1] + (region != word), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate([[i + 1], step]) - places) + places
    end = int(np.argmin(row))
    return int(row[end]), end


def candidates(symbols: np.ndarray, first: np.ndarray, items: Items) -> np.ndarray:
    """Distinct (text, item, where the item would start) for windows whose keys meet."""
    found = []
    counts = np.diff(first)

    def meet(own: np.ndarray, text: np.ndarray, starts: np.ndarray) -> None:
        near = np.flatnonzero(items.maybe[_low(own)])
        low = np.searchsorted(items.key, own[near], "left")
        high = np.searchsorted(items.key, own[near], "right")
        near, low, size = near[high > low], low[high > low], (high - low)[high > low]
        entry = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        at = np.repeat(near, size)
        found.append(
            np.stack([text[at], items.item[entry], starts[at] - items.offset[entry]], axis=1)
        )

    for plan in items.schemes:
        window, stride = plan.sizes
        windows = np.maximum(0, (counts - window) // stride + 1)
        text = np.repeat(np.arange(len(counts)), windows)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = first[:-1][text] + nth * stride
        for a in range(0, len(starts), BLOCK):
            begin = starts[a : a + BLOCK]
            here = symbols[begin[0] : begin[-1] + window]
            for own in keys(here, begin - begin[0], plan):
                meet(own, text[a : a + BLOCK], begin)
    for size in items.pieces:
        owner = np.repeat(np.arange(len(counts)), counts)
        own = piece_keys(symbols, size)
        starts = np.flatnonzero(owner[: len(own)] == owner[size - 1 : size - 1 + len(own)])
        meet(own[starts], owner[starts], starts)
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def passages(column: pa.Array, items: Items, max_edit: float = MAX_EDIT) -> Iterator[tuple]:
    """(text, item, start, end, start_word, end_word, distance) of each match: the best run for
    every place where an item may start. start and end are code points, end exclusive."""
    for a, b in W.slices(column, SLICE_BYTES):
        text, bounds = W.raw(column.slice(a, b - a))
        words, kept = normalised(text, bounds)
        symbols = W.hashes(words)
        last: tuple | None = None
        for i, k, begin in candidates(symbols, words.first, items).tolist():
            item = items.words[k]
            slack = int(max_edit * len(item))
            if last and last[:2] == (i, k) and begin <= last[2]:
                continue
            low = max(int(words.first[i]), begin - 2 * slack - 1)
            high = min(int(words.first[i + 1]), begin + len(item) + 2 * slack + 1)
            region = symbols[low:high]
            if np.isin(item, region).sum() < len(item) - slack:
                continue
            distance, end = best_fit(item, region)
            if distance > slack:
                continue
            back, size = best_fit(item[::-1], region[:end][::-1])
            start_word, end_word = low + end - size, low + end
            if last and last[:2] == (i, k) and start_word < last[3]:
                continue
            last = (i, k, start_word + slack, end_word)
            from_byte = kept[words.start[start_word]] - bounds[i]
            to_byte = kept[words.end[end_word - 1] - 1] + 1 - bounds[i]
            data = text[bounds[i] : bounds[i + 1]].tobytes()
            start = len(data[:from_byte].decode())
            yield (
                a + i, k, start, start + len(data[from_byte:to_byte].decode()),
                start_word - int(words.first[i]), end_word - int(words.first[i]), distance,
            )


def item_blocks(
    items: DataFrame, max_keys: int = MAX_KEYS, max_edit: float = MAX_EDIT
) -> Iterator[Items]:
    """Items (item_id, text) in blocks whose keys are bounded."""
    narrow = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    # An item of n words has up to n/2 windows, each with 24 keys or so; more are halved below.
    size = narrow.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    blocks = max(1, -(-size * 12 // max_keys))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for block in range(blocks):
        rows = narrow.filter(place == block).orderBy("item_id", "text").collect()
        if rows:
            yield from _bounded([tuple(row) for row in rows], max_keys, max_edit)


def _bounded(rows: list[tuple], max_keys: int, max_edit: float) -> Iterator[Items]:
    plans = planned(rows, max_edit)
    if plans.count() > max_keys and len(rows) > 1:
        for half in (rows[::2], rows[1::2]):
            yield from _bounded(half, max_keys, max_edit)
    else:
        yield prepared(rows, max_edit, plans)


def find_passages(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    max_edit: float = MAX_EDIT,
) -> DataFrame:
    """Every match of an item in a document (MATCHES)."""
    spark = docs.sparkSession
    texts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )
    out = spark.createDataFrame([], MATCHES)
    for block in item_blocks(items, max_edit=max_edit):
        sent = _sent(spark, block)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = _received(sent.value)
            schema = pa.schema([(f.split()[0], pa.int64()) for f in MATCHES.split(", ")])
            for batch in batches:
                found = list(passages(batch.column("text"), items, max_edit))
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[i], items.ids[k], *rest) for i, k, *rest in found]
                columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], schema=schema
                )

        out = out.unionByName(texts.mapInArrow(find, MATCHES))
    return out


def clean_documents(
    docs: DataFrame, items: DataFrame, text_col: str = "text", max_edit: float = MAX_EDIT
) -> DataFrame:
    """`docs` less those in which an item is found."""
    spark = docs.sparkSession
    for block in item_blocks(items, max_edit=max_edit):
        sent = _sent(spark, block)

        def drop(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = _received(sent.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, *_ in passages(batch.column(text_col), items, max_edit):
                    keep[i] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(drop, docs.schema)
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return find_passages(docs, items)
