"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A document's features are the hash buckets of its character 3-, 4- and 5-grams, present or
not. Of each bucket the share of toxic and of other training documents that have it gives a
log-count ratio; logistic regression over the present ratios of the most telling buckets
gives the score.

Fitting takes at most `max_train` labelled rows, those whose hashed id is smallest; what
reaches the driver is bounded by that and by the number of buckets. Scoring is one pass over
all documents that moves no rows; the weights, one float for each bucket, are broadcast.

Defined results: a null or empty text has the features of blank text and gets their score;
repeated rows are scored alike; a null id is scored, carried on and never held out; a null
label is no label, and of several labels of one document the largest counts; without a
labelled row of either class every score is 0; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm import words as W
from lendscope.llm.scratch import stored

ORDERS = (3, 4, 5)
BITS = 18
BUCKETS = 1 << BITS
SELECTED = 1024
MAX_TRAIN = 12_000
THRESHOLD = 0.3
SLICE_BYTES = 2 << 20

_FACTORS = [int(f) | 1 for f in W.mix(np.arange(11, 11 + max(ORDERS), dtype=np.uint64))]


def _characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case (A-Z only), each text led by blanks, and their texts. Blanks
    keep n-grams of two texts apart."""
    pad = " " * (max(ORDERS) - 1)
    texts = pc.ascii_lower(pc.fill_null(column, "")).to_pylist()
    joined = pad + "".join(text + pad for text in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    # The blanks after a text lead the next one; those after the last are its own.
    sizes = np.array([len(text) + len(pad) for text in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    return points, owner


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the text and bucket of every n-gram."""
    points, owner = _characters(column)
    points = points.astype(np.uint64)
    sums = np.zeros(len(points), np.uint64)
    for j in range(max(ORDERS)):
        n = len(points) - j
        sums = sums[:n] + points[j:] * np.uint64(_FACTORS[j])
        if j + 1 in ORDERS:
            count = min(n, len(owner))
            spread = sums[:count] * np.uint64(_FACTORS[j] ^ 0x5DEECE66C)
            yield owner[:count], (spread >> np.uint64(64 - BITS)).astype(np.int64)


def present(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, bucket) pairs of a column, sorted; of `wanted` buckets if given."""
    found = []
    for owner, bucket in grams(column):
        if wanted is not None:
            keep = np.flatnonzero(wanted[bucket])
            owner, bucket = owner[keep], bucket[keep]
        found.append(owner << BITS | bucket)
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & (BUCKETS - 1)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    text = batch.column("text")
    for a, b in W.slices(text, SLICE_BYTES):
        yield a, b, text.slice(a, b - a)


def _blobs(owner: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    """The values of each row as one binary."""
    offsets = np.searchsorted(owner, np.arange(rows + 1)) * values.itemsize
    return pa.BinaryArray.from_buffers(
        pa.binary(), rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)]
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, text in _batches(batch):
            owner, bucket = present(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rank").slice(a, b - a),
                    batch.column("toxic").slice(a, b - a),
                    _blobs(owner, bucket.astype(np.int32), b - a),
                ],
                names=["rank", "toxic", "buckets"],
            )


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: documents with each bucket, for either class."""
    totals = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        for toxic, blob in zip(
            batch.column("toxic").to_pylist(), batch.column("buckets"), strict=True
        ):
            totals[toxic, np.frombuffer(blob.as_buffer(), np.int32)] += 1
    yield pa.RecordBatch.from_arrays([pa.array([totals.tobytes()], pa.binary())], names=["totals"])


def _selected(code: np.ndarray):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for blob in batch.column("buckets"):
                codes = code[np.frombuffer(blob.as_buffer(), np.int32)]
                blobs.append(codes[codes >= 0].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rank"), batch.column("toxic"), pa.array(blobs, pa.binary())],
                names=["rank", "toxic", "codes"],
            )

    return select


def log_count_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Of the smoothed share of documents with a feature, toxic ones against others."""
    return np.log((toxic + 1) / (n_toxic + 2)) - np.log((other + 1) / (n_other + 2))


def regress(
    rows: np.ndarray, columns: np.ndarray, scale: np.ndarray, label: np.ndarray, steps: int = 200,
    penalty: float = 1e-4, rate: float = 0.05,
) -> tuple[np.ndarray, float]:
    """Logistic regression over present features times `scale`, by averaged gradient steps
    with momentum: weights and intercept."""
    n, width = len(label), len(scale)
    weight, bias = np.zeros(width), float(np.log((label.sum() + 1) / (n - label.sum() + 1)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    value = scale[columns]
    for step in range(1, steps + 1):
        margin = np.bincount(rows, weight[columns] * value, n) + bias
        error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - label
        slope = np.append(
            np.bincount(columns, error[rows] * value, width) / n + penalty * weight, error.mean()
        )
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weight, bias = weight - move[:-1], bias - move[-1]
    return weight, bias


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """A weight for each bucket, and the intercept. `docs` has doc_id and text, `labels` doc_id
    and toxic (0 or 1); both hold training rows only."""
    sample = (
        labels.filter("toxic in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("rank", F.xxhash64("doc_id"))
        .orderBy("rank", "doc_id")
        .limit(max_train)
    )
    # At most max_train rows of 20 bytes: safe to broadcast.
    features = stored(
        docs.join(F.broadcast(sample), "doc_id")
        .select("rank", F.col("toxic").cast("int").alias("toxic"), "text")
        .mapInArrow(_features, "rank long, toxic int, buckets binary"),
        "toxicity-features",
    ).coalesce(8)
    totals = np.zeros((2, BUCKETS), np.int64)
    for row in features.mapInArrow(_counts, "totals binary").collect():
        totals += np.frombuffer(row.totals, np.int32).reshape(2, BUCKETS)
    sizes = {r.toxic: r["count"] for r in features.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return np.zeros(BUCKETS, np.float32), -np.inf
    ratio = log_count_ratios(totals[1], totals[0], sizes[1], sizes[0])
    # How far a bucket's toxic count is from what its frequency alone would give.
    share = sizes[1] / (sizes[0] + sizes[1])
    count = totals.sum(0)
    telling = np.abs(totals[1] - share * count) / np.sqrt(count * share * (1 - share) + 1)
    chosen = np.sort(np.argsort(-telling, kind="stable")[:SELECTED])
    code = np.full(BUCKETS, -1, np.int64)
    code[chosen] = np.arange(len(chosen))
    rows = features.mapInArrow(_selected(code), "rank long, toxic int, codes binary").collect()
    rows.sort(key=lambda r: (r.rank, r.toxic, r.codes))
    codes = [np.frombuffer(r.codes, np.int32) for r in rows]
    weight, bias = regress(
        np.repeat(np.arange(len(rows)), [len(c) for c in codes]),
        np.concatenate(codes),
        ratio[chosen],
        np.array([r.toxic for r in rows], float),
    )
    table = np.zeros(BUCKETS, np.float32)
    table[chosen] = weight * ratio[chosen]
    return table, float(bias)


def score(docs: DataFrame, table: np.ndarray, bias: float) -> DataFrame:
    """doc_id and score of every row of `docs` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((table, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = sent.value
        wanted = table != 0
        for batch in batches:
            for a, b, text in _batches(batch):
                owner, bucket = present(text, wanted)
                margin = np.bincount(owner, table[bucket], b - a) + bias
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(1 / (1 + np.exp(-np.clip(margin, -40, 40)))),
                    ],
                    names=["doc_id", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    train = ~held_out(F.col("doc_id"))
    table, bias = fit(docs.filter(train), labels.filter(train))
    return score(docs, table, bias).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
