"""Ranked lexical search: the best documents for each item, by integer BM25 scores.

1. One pass over the documents writes their postings of the items' terms, in blocks of some
   thousand documents, as a table. Document counts of terms, and totals, are sums over blocks.
2. Each block has one bitmap a term. An item's bitmaps, read across, are the presence masks of
   the documents: which of its terms each one has. Documents that miss every term without
   which the score to beat is out of reach are masked out first, by OR-ing bitmaps.
3. Documents are grouped by mask. A mask's maximum score adds the best weight that any document
   of the block has for each of its terms. Masks are evaluated in descending order of that
   maximum, their documents exactly, until the next maximum is below the k-th best score so
   far: no document left can then enter the list, nor tie with its last one.
4. A task carries the k-th scores from block to block, and sends k rows an item. The lists of
   all tasks meet in a window of at most tasks * k rows an item.

Nothing is cut: what is not evaluated is proven too low. Items are taken in blocks of at most
`block_items` and `block_terms` different terms (or one item), each with its own pass, so that
what the driver holds and sends does not grow with their number.

Defined results: a null or empty text has no terms, and does not count as a document; an item
without terms, or whose terms no document has, has no rows. Rows that repeat, of documents or
items, count and rank each on its own. Equal scores go by ascending id, null ids last. Empty
tables give an empty table. Very long texts count whole; each is one row of work. Other
columns are not read, whatever their names. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.llm import words as W
from lendscope.llm.scratch import stored

TOP = 20
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 4 << 20
BLOCK_ITEMS = 4096
BLOCK_TERMS = 1 << 16
WAVE = 64
LAST = np.iinfo(np.int64).max
FILTER_BITS = 20

BLOCKS = (
    "n_docs long, n_terms long, ids binary, lengths binary, terms binary, counts binary,"
    " places binary, tfs binary"
)
FOUND = "item int, doc_id long, score long"

# What no term has becomes a space, and A-Z lower case.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
_FOLD[0x41:0x5B] += 0x20


def terms_of(column: pa.Array) -> W.Words:
    """The terms of texts: runs of ASCII letters, digits and all beyond ASCII, A-Z lowered."""
    text, bounds = W.raw(column)
    return W.split(_FOLD[text], bounds)


class Items(NamedTuple):
    """A block of items: the sorted hashes of all their terms, and for each item its different
    terms, as places in `vocabulary`, with how often it repeats them."""

    vocabulary: np.ndarray
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def _items(texts: list[str | None]) -> Items:
    words = terms_of(pa.array(texts, pa.string()))
    vocabulary, own = np.unique(W.hashes(words), return_inverse=True)
    pairs = [
        np.unique(own[words.first[k] : words.first[k + 1]], return_counts=True) for k in range(len(texts))
    ]
    return Items(vocabulary, [p[0] for p in pairs], [p[1].astype(np.int64) for p in pairs])


def _item_blocks(items: DataFrame, most_items: int, most_terms: int) -> Iterator[list]:
    """Rows of (id, text), taken from the executors one partition at a time."""
    block, terms = [], 0
    for row in items.toLocalIterator():
        size = len(terms_of(pa.array([row[1]], pa.string())).start)
        if block and (len(block) == most_items or terms + size > most_terms):
            yield block
            block, terms = [], 0
        block.append(row)
        terms += size
    if block:
        yield block


class _Block:
    """Documents on their way into one row of BLOCKS."""

    def __init__(self):
        self.docs = self.terms = self.kept = self.size = 0
        self.parts = []

    def add(self, ids: np.ndarray, words: W.Words, term: np.ndarray) -> None:
        """`term` is each word's place in the vocabulary, or -1."""
        lengths = np.diff(words.first)
        self.docs += int(np.count_nonzero(lengths))
        self.terms += int(lengths.sum())
        found = np.flatnonzero(term >= 0)
        keys = (W.owners(words)[found].astype(np.int64) << 32) | term[found]
        keys, tf = np.unique(keys, return_counts=True)
        owner, term = keys >> 32, keys & 0xFFFFFFFF
        present, place = np.unique(owner, return_inverse=True)
        self.parts.append((ids[present], lengths[present], term, place + self.kept, tf))
        self.kept += len(present)
        self.size += len(tf)

    def row(self) -> pa.RecordBatch:
        ids, lengths, term, place, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((place, term))
        terms, counts = np.unique(term, return_counts=True)
        blobs = (
            ids.astype(np.int64), lengths.astype(np.int64), terms.astype(np.int32), counts.astype(np.int32),
            place[order].astype(np.int32), tf[order].astype(np.int32),
        )
        return pa.RecordBatch.from_arrays(
            [pa.array([self.docs]), pa.array([self.terms])] + [pa.array([b.tobytes()], pa.binary()) for b in blobs],
            names=["n_docs", "n_terms", "ids", "lengths", "terms", "counts", "places", "tfs"],
        )


def _places(hashes: np.ndarray, vocabulary: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Where each hash stands in the vocabulary, or -1."""
    place = np.full(len(hashes), -1, np.int64)
    maybe = np.flatnonzero(seen[hashes >> np.uint64(64 - FILTER_BITS)])
    at = np.minimum(np.searchsorted(vocabulary, hashes[maybe]), len(vocabulary) - 1)
    same = vocabulary[at] == hashes[maybe]
    place[maybe[same]] = at[same]
    return place


def _postings(sent, most_docs: int, most_postings: int):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value.vocabulary
        seen = np.zeros(1 << FILTER_BITS, bool)
        seen[vocabulary >> np.uint64(64 - FILTER_BITS)] = True
        block = _Block()
        for batch in batches:
            ids = np.asarray(pc.fill_null(batch.column(0), LAST))
            for a, b in W.slices(batch.column(1)):
                for c in range(a, b, most_docs):
                    d = min(b, c + most_docs)
                    words = terms_of(batch.column(1).slice(c, d - c))
                    if block.parts and (block.kept + d - c > most_docs or block.size > most_postings):
                        yield block.row()
                        block = _Block()
                    block.add(ids[c:d], words, _places(W.hashes(words), vocabulary, seen))
        if block.parts:
            yield block.row()

    return postings


def _document_counts(size: int):
    """One row a term and task."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms, own in zip(batch.column(0), batch.column(1), strict=True):
                total[np.frombuffer(terms.as_buffer(), np.int32)] += np.frombuffer(own.as_buffer(), np.int32)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(term, pa.int32()), pa.array(total[term])], names=["term", "df"]
        )

    return counts


class Query(NamedTuple):
    items: Items
    weights: np.ndarray
    docs: int
    terms: int


def weights_of(df: np.ndarray, docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(tf: np.ndarray, length: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term's weight is multiplied by, for a document of `length` terms."""
    tf = tf.astype(np.int64)
    m = 75 + (25 * length * docs) // terms
    return (10**9 * tf) // (1000 * tf + 12 * m)


def by_mask(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each column of a 0/1 matrix, and one column of each group."""
    code = np.zeros(bits.shape[1], np.int64)
    first = np.zeros(min(1, bits.shape[1]), np.int64)
    for a in range(0, len(bits), 32):
        packed = np.packbits(bits[a : a + 32], axis=0)
        part = np.zeros(bits.shape[1], np.int64)
        for byte in packed:
            part = part << 8 | byte
        _, first, code = np.unique(code << 32 | part, return_index=True, return_inverse=True)
    return code, first


class _Index:
    """A stored block: a bitmap and the best impact of each term, and the impact of each posting."""

    def __init__(self, row: dict, query: Query):
        view = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids = view("ids", np.int64)
        terms, counts, place = view("terms", np.int32), view("counts", np.int32), view("places", np.int32)
        self.impact = impacts(view("tfs", np.int32), view("lengths", np.int64)[place], query.docs, query.terms)
        self.at = np.full(len(query.items.vocabulary), -1, np.int64)
        self.at[terms] = np.arange(len(terms))
        own = np.repeat(np.arange(len(terms)), counts)
        self.key = own * len(self.ids) + place
        width = (len(self.ids) + 7) // 8
        self.bitmaps = np.zeros(len(terms) * width, np.uint8)
        self.best = np.zeros(len(terms), np.int64)
        if len(place):
            byte = own * width + (place >> 3)
            new = np.flatnonzero(np.diff(byte, prepend=-1))
            self.bitmaps[byte[new]] = np.add.reduceat((0x80 >> (place & 7)).astype(np.uint8), new)
            self.best = np.maximum.reduceat(self.impact, np.cumsum(counts) - counts)
        self.bitmaps = self.bitmaps.reshape(len(terms), width)

    def scores(self, own: np.ndarray, gain: np.ndarray, bits: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores of documents, whose masks are the columns of `bits`."""
        term, doc = np.nonzero(bits)
        found = np.searchsorted(self.key, own[term] * len(self.ids) + docs[doc])
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, doc, gain[term] * self.impact[found])
        return total


class _Best:
    """The `k` best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        """The least score that may still enter, by rank of its id if equal to the k-th."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.floor()
        scores = np.concatenate([self.scores, scores[good]])
        ids = np.concatenate([self.ids, ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def evaluate(index: _Index, terms: np.ndarray, gain: np.ndarray, best: _Best) -> None:
    """Take a block's documents into the `best` of one item with these terms and weights."""
    own = index.at[terms]
    own, gain = own[own >= 0], gain[own >= 0]
    most = gain * index.best[own]
    order = np.argsort(-most)
    own, gain, most = own[order], gain[order], most[order]
    # A document needs one of the first terms, as all others together are below the floor.
    left = np.cumsum(most[::-1])[::-1]
    needed = int(np.count_nonzero(left >= best.floor()))
    if not needed:
        return
    some = np.bitwise_or.reduce(index.bitmaps[own[:needed]], axis=0)
    docs = np.flatnonzero(np.unpackbits(some, count=len(index.ids)))
    bits = index.bitmaps[own][:, docs >> 3] >> (7 - (docs & 7)).astype(np.uint8) & 1
    mask, sample = by_mask(bits)
    bound = most @ bits[:, sample].astype(np.int64)
    descending = np.argsort(-bound, kind="stable")
    place = np.empty(len(bound), np.int64)
    place[descending] = np.arange(len(bound))
    by_bound = np.argsort(place[mask], kind="stable")
    ends = np.cumsum(np.bincount(place[mask], minlength=len(bound)))
    bound = bound[descending]
    group, start, wave = 0, 0, WAVE
    while group < len(bound) and bound[group] >= best.floor():
        last = min(len(bound) - 1, int(np.searchsorted(ends, start + wave)))
        some = by_bound[start : ends[last]]
        best.add(index.scores(own, gain, bits[:, some], docs[some]), index.ids[docs[some]])
        group, start, wave = last + 1, int(ends[last]), 2 * wave


def _search(sent, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query: Query = sent.value
        items = query.items
        best = [_Best(k) for _ in items.terms]
        for batch in batches:
            for row in batch.to_pylist():
                index = _Index(row, query)
                for own, repeats, so_far in zip(items.terms, items.repeats, best, strict=True):
                    evaluate(index, own, repeats * query.weights[own], so_far)
        ids = np.concatenate([b.ids for b in best])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(best)), [len(b.ids) for b in best]), pa.int32()),
                pa.array(ids, mask=ids == LAST),
                pa.array(np.concatenate([b.scores for b in best])),
            ],
            names=["item", "doc_id", "score"],
        )

    return search


def _ranked_block(docs: DataFrame, rows: list, id_type: T.DataType, k: int, most_docs: int) -> DataFrame:
    spark = docs.sparkSession
    items = _items([row[1] for row in rows])
    if not len(items.vocabulary):
        return spark.createDataFrame([], _result(id_type))
    sent = spark.sparkContext.broadcast(items)
    blocks = stored(docs.mapInArrow(_postings(sent, most_docs, BLOCK_POSTINGS), BLOCKS), "search-postings")
    total = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not total[0]:
        return spark.createDataFrame([], _result(id_type))
    counted = (
        blocks.select("terms", "counts")
        .mapInArrow(_document_counts(len(items.vocabulary)), "term int, df long")
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
    )
    df = np.zeros(len(items.vocabulary), np.int64)
    for term, own in counted.collect():  # at most one row a term of the block of items
        df[term] = own
    sent = spark.sparkContext.broadcast(Query(items, weights_of(df, total[0]), total[0], total[1]))
    found = blocks.select("ids", "lengths", "terms", "counts", "places", "tfs").mapInArrow(_search(sent, k), FOUND)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    names = spark.createDataFrame(
        [(i, row[0]) for i, row in enumerate(rows)],
        T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type)]),
    )
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .join(F.broadcast(names), "item")
        .select("item_id", "rank", "doc_id", "score")
    )


def _result(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("item_id", id_type),
            T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", T.LongType()),
            T.StructField("score", T.LongType()),
        ]
    )


def best_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_items: int = BLOCK_ITEMS,
    block_terms: int = BLOCK_TERMS,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """item_id, rank, doc_id and score of the `k` documents that score highest for each item."""
    docs = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    items = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    id_type = items.schema["item_id"].dataType
    out = None
    for rows in _item_blocks(items, block_items, block_terms):
        block = _ranked_block(docs, rows, id_type, k, block_docs)
        out = block if out is None else out.unionByName(block)
    return docs.sparkSession.createDataFrame([], _result(id_type)) if out is None else out


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return best_documents(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


OP11_SQL = r"""
with d as (
  select doc_id, row_number() over () as place, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+')) as term
  from documents
), tf as (
  select place, doc_id, term, count(*) as tf from d group by place, doc_id, term
), len as (
  select place, count(*) as n from d group by place
), total as (
  select count(*) as docs, sum(n)::bigint as terms from len
), weight as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tf, total group by term, docs
), i as (
  select item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+')) as term
  from benchmark
), q as (
  select item_id, term, count(*) as repeats from i group by item_id, term
), scored as (
  select q.item_id, tf.place, tf.doc_id, sum(q.repeats * w * ((1000000000 * tf.tf)
    // (1000 * tf.tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
  from q join tf on q.term = tf.term join len on tf.place = len.place join weight on weight.term = q.term, total
  group by q.item_id, tf.place, tf.doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
  from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
"""
