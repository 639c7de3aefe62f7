"""Substring dedup: drop words in 50-word windows that an earlier document has too.

1. Documents are stored in chunks of a few MB, each one row, the unit of all later steps.
2. Every window has an anchor, the least hash of the 12-word runs in it. Equal windows have
   equal anchors, and neighbouring windows mostly share one, so a document has one for some
   twenty words. Count-min sketches count the documents of each anchor, apart in every
   partition, and are merged: an estimate for all windows of that anchor, never too low.
3. Windows whose estimate is two or more, and only those, are grouped exactly: each chunk
   sends its distinct ones, by 96-bit hash, with the smallest document that has it. Buckets
   of hashes answer, with one bit each, whether another chunk has a smaller document.
4. Each chunk finds the same windows again, in the same order, and applies the bits.

A window that a third of all documents share is sent once by a chunk. Chunks, bucket count
and sketch width are set by the size of the texts; the sketch has a largest width, beyond
which it lets more windows through, never fewer.

Defined results: a null or empty text has no words and keeps the empty text; rows with the
same id do not count as smaller than each other; a null id is larger than all others and
carried on; an empty table gives an empty table. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm import sketch
from lendscope.llm import words as W
from lendscope.llm.scratch import stored

WINDOW = 50
RUN = 12
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
MAX_WIDTH = 1 << 30
OTHER = 0xC2B2AE3D27D4EB4F
LAST = np.iinfo(np.int64).max

CHUNKS = "chunk long, bytes long, ids binary, bounds binary, text binary"
ASKED = "bucket int, chunk long, high binary, low binary, least binary"
ANSWERS = "chunk long, bucket int, bits binary"
KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ids = np.asarray(pc.fill_null(batch.column("doc_id"), LAST))
        for a, b in W.slices(batch.column("text"), CHUNK_BYTES):
            text, bounds = W.raw(batch.column("text").slice(a, b - a))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([len(text)])]
                + [pa.array([x.tobytes()], pa.binary()) for x in (ids[a:b], bounds, text)],
                names=["chunk", "bytes", "ids", "bounds", "text"],
            )
            number += 1


class Chunk(NamedTuple):
    number: int
    ids: np.ndarray
    words: W.Words
    hashes: np.ndarray


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for k in range(batch.num_rows):
            view = lambda n, kind: np.frombuffer(batch.column(n)[k].as_buffer(), kind)  # noqa: B023, E731
            words = W.split(view("text", np.uint8), view("bounds", np.int64))
            yield Chunk(batch.column("chunk")[k].as_py(), view("ids", np.int64), words, W.hashes(words))


def least(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each run of `size` values."""
    length = 1
    while 2 * length <= size:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    rest = size - length
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(chunk: Chunk, window: int, run: int) -> np.ndarray:
    """The anchor of each run of `window` words."""
    if len(chunk.hashes) < window:
        return np.zeros(0, np.uint64)
    return least(W.windows(chunk.hashes, run), window - run + 1)


def _anchor_values(window: int, run: int):
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for chunk in _chunks(batches):
            inside = W.whole(chunk.words, window)
            own = anchors(chunk, window, run)[inside]
            owner = W.owners(chunk.words)[: len(inside)][inside]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
            own, owner = own[new], owner[new]
            # Once for each document, though its anchors may come back later in the text.
            order = np.lexsort((own, owner))
            own, owner = own[order], owner[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])
            yield own[new]

    return values


class Found(NamedTuple):
    """Windows of a chunk that may be repeated. `start` is a window's first word, `group` its
    place among the distinct ones, which are sorted by (high, low) up to collisions."""

    start: np.ndarray
    group: np.ndarray
    high: np.ndarray
    low: np.ndarray
    smallest: np.ndarray


def suspects(chunk: Chunk, bits: np.ndarray, window: int, run: int) -> Found:
    inside = W.whole(chunk.words, window)
    start = np.flatnonzero(inside & sketch.maybe_repeated(anchors(chunk, window, run), bits))
    high = W.windows(chunk.hashes, window)[start]
    low = (W.windows(chunk.hashes, window, OTHER)[start] >> np.uint64(32)).astype(np.uint32)
    doc = chunk.ids[W.owners(chunk.words)[start]]
    order = np.argsort(high, kind="stable")
    start, high, low, doc = start[order], high[order], low[order], doc[order]
    new = np.ones(len(start), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    smallest = np.minimum.reduceat(doc, np.flatnonzero(new)) if len(doc) else doc
    return Found(start, np.cumsum(new) - 1, high[new], low[new], smallest)


def _bucket_edges(high: np.ndarray, buckets: int) -> np.ndarray:
    """Where the hashes of each bucket begin; buckets are equal ranges, a power of two."""
    if buckets == 1:
        return np.array([0, len(high)])
    step = (1 << 64) // buckets
    inner = np.searchsorted(high, np.array([step * k for k in range(1, buckets)], np.uint64))
    return np.concatenate([[0], inner, [len(high)]])


def _ask(sent, buckets: int, window: int, run: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            found = suspects(chunk, sent.value, window, run)
            edges = _bucket_edges(found.high, buckets)
            full = np.flatnonzero(np.diff(edges))
            cut = lambda x: pa.array(
                [x[edges[k] : edges[k + 1]].tobytes() for k in full], pa.binary()  # noqa: B023
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()), pa.array([chunk.number] * len(full), pa.int64()),
                    cut(found.high), cut(found.low), cut(found.smallest),
                ],
                names=["bucket", "chunk", "high", "low", "least"],
            )

    return ask


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def answered(bucket: int, asked: list) -> pa.RecordBatch:
        sizes = [len(low) // 4 for _, _, low, _ in asked]
        join = lambda i, kind: np.concatenate([np.frombuffer(x[i], kind) for x in asked])
        high, low, doc = join(1, np.uint64), join(2, np.uint32), join(3, np.int64)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.ones(len(high), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        smaller = np.empty(len(doc), bool)
        smaller[order] = first[np.cumsum(new) - 1] < doc[order]
        ends = np.cumsum(sizes)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in asked], pa.int64()),
                pa.array([bucket] * len(asked), pa.int32()),
                pa.array(
                    [np.packbits(smaller[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)],
                    pa.binary(),
                ),
            ],
            names=["chunk", "bucket", "bits"],
        )

    bucket, asked = None, []
    for batch in batches:
        for own, chunk, *blobs in zip(
            *(batch.column(n).to_pylist() for n in ("bucket", "chunk", "high", "low", "least")), strict=True
        ):
            if own != bucket:
                if asked:
                    yield answered(bucket, asked)
                bucket, asked = own, []
            asked.append((chunk, *blobs))
    if asked:
        yield answered(bucket, asked)


def _apply(sent, buckets: int, window: int, run: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = batch.column("answers").to_pylist()
            for chunk, answer in zip(_chunks([batch]), answers, strict=True):
                found = suspects(chunk, sent.value, window, run)
                edges = _bucket_edges(found.high, buckets)
                smaller = np.zeros(len(found.high), bool)
                for part in answer or []:
                    a, b = edges[part["bucket"]], edges[part["bucket"] + 1]
                    smaller[a:b] = np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=b - a)
                doc = chunk.ids[W.owners(chunk.words)[found.start]]
                gone = found.start[smaller[found.group] | (doc > found.smallest[found.group])]
                total = len(chunk.words.start)
                ends = np.bincount(gone, minlength=total + 1) - np.bincount(gone + window, minlength=total + 1)
                removed = np.cumsum(ends)[:total] > 0
                text, bounds = W.joined(chunk.words, ~removed)
                n_removed = np.concatenate([[0], np.cumsum(removed)])[chunk.words.first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chunk.ids, mask=chunk.ids == LAST),
                        pa.array(np.diff(chunk.words.first).astype(np.int64)),
                        pa.array(np.diff(n_removed).astype(np.int64)),
                        pa.StringArray.from_buffers(
                            len(chunk.ids), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(text)
                        ),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return apply


def drop_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    run: int = RUN,
    max_width: int = MAX_WIDTH,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (KEPT) of every document."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )
    chunks = stored(rows.mapInArrow(_chunked, CHUNKS), "dedup-chunks")
    total = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    # A word has some six bytes, and a window's anchor serves about half as many windows as it
    # has runs.
    width = sketch.width_for(int(total * 2 / (6 * (window - run + 2))), max_width)
    values = _anchor_values(window, run)
    partials = chunks.mapInArrow(lambda batches: sketch.partial(values(batches), width), sketch.PARTIAL)
    sent = spark.sparkContext.broadcast(sketch.repeated_cells(partials, width))

    buckets = 1 << max(0, (total // bucket_bytes)).bit_length()
    asked = chunks.mapInArrow(_ask(sent, buckets, window, run), ASKED)
    answers = stored(
        asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer, ANSWERS),
        "dedup-answers",
    )
    answered = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    return chunks.join(answered, "chunk", "left").mapInArrow(_apply(sent, buckets, window, run), KEPT)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP1_SQL = """
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words
  from documents
), v as (
  select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as h
  from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50)
), f as (
  select doc_id, i, min(doc_id) over (partition by h) as first from v
), gone as (
  select doc_id, list_distinct(flatten(list(range(i, i + 50)))) as places from f where first < doc_id group by doc_id
)
select w.doc_id, len(words)::bigint as n_words, coalesce(len(places), 0)::bigint as n_removed,
  sha256(case when places is null then array_to_string(words, ' ') else coalesce(array_to_string(
    list_filter(words, lambda x, k: not list_contains(places, k)), ' '), '') end) as kept_sha256
from w left join gone on w.doc_id = gone.doc_id
"""
