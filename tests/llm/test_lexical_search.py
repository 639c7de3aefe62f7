"""Ranked lexical search against scores of every document."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.llm import lexical_search as ls
from lendscope.llm.catalog import QUERIES
from tests.conftest import ORACLE_DIR
from tests.llm import brute

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def ranked(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def mixed(seed=3, n=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Über", "ñandú", "ÉCOLE", "x1y2"]
    text = lambda most: " ".join(rng.choice(words[: rng.choice([5, 20, 64])]) for _ in range(rng.randint(0, most)))
    docs = [(k, text(40)) for k in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " -- !"), (n + 3, "W1,w2;W3"), (5, docs[5][1]), (None, "w1 w2"), (n + 4, text(9) * 2000)]
    items = [(k, text(30)) for k in range(12)] + [(90, None), (91, "unheard of"), (92, "w1 w1 w1 W2"), (92, "w1 w1 w1 W2")]
    return docs, items


@pytest.mark.parametrize("block_docs", [8, 64, 8192])
def test_equals_scoring_every_document(spark, block_docs):
    docs, items = mixed()
    got = ranked(
        ls.best_documents(
            spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), block_docs=block_docs
        )
    )
    want = sorted(brute.lexical(docs, items), key=lambda r: (r[0], r[1]))
    key = lambda r: (r[0], r[1], r[3], r[2] is None, r[2] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_blocks_of_items_and_small_k(spark):
    docs, items = mixed(8, 80)
    docs = [(i, t) for i, t in docs if i is not None]
    got = ranked(
        ls.best_documents(
            spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k=3, block_items=5, block_terms=40
        )
    )
    assert got == sorted(brute.lexical(docs, items, 3))


def test_more_terms_than_a_word_of_bits(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(f"t{rng.randrange(150)}" for _ in range(60))) for k in range(200)]
    items = [(0, " ".join(f"t{k}" for k in range(150)))]
    got = ranked(ls.best_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)))
    assert got == brute.lexical(docs, items)


def test_ties_go_by_id(spark):
    docs = [(k, "same text here") for k in range(100, 0, -1)] + [(k, "other") for k in range(200, 500)]
    out = ranked(
        ls.best_documents(
            spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame([(1, "text")], ITEMS), block_docs=16
        )
    )
    assert [r[2] for r in out] == list(range(1, 21))


def test_empty_tables_and_clashing_columns(spark):
    docs, items = mixed(5, 30)
    docs = [(i, t) for i, t in docs if i is not None]
    df, asked = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    none = ls.best_documents(df.limit(0), asked)
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.collect() == []
    assert ls.best_documents(df, asked.limit(0)).collect() == []
    more = {name: F.lit("z") for name in ("item", "score", "rank", "term", "ids", "places", "item_id", "n_docs")}
    wide = df.withColumnRenamed("doc_id", "score id").withColumns(more)
    asked_wide = asked.withColumns({name: F.lit(1) for name in ("doc_id", "rank", "item")})
    assert ranked(ls.best_documents(wide, asked_wide, id_col="score id")) == ranked(ls.best_documents(df, asked))


def test_masks():
    bits = np.array([[1, 0, 1, 1], [0, 0, 0, 1]] + [[0, 0, 0, 0]] * 40 + [[1, 0, 1, 1]], np.uint8)
    group, first = ls.by_mask(bits)
    assert group[0] == group[2] and len(set(group)) == 3
    assert [group[k] for k in first] == [0, 1, 2]


def test_masks_below_the_floor_are_not_scored(spark):
    """The scores to beat leave most documents out."""
    calls = []

    class Counting(ls._Index):
        def scores(self, own, gain, bits, docs):
            calls.append(len(docs))
            return super().scores(own, gain, bits, docs)

    docs = [(k, "common " * 3 + f"filler{k}") for k in range(4000)] + [(9000 + k, "common rare rarer") for k in range(30)]
    items = ls._items(["common rare rarer"])
    rows = []

    class Sent:
        value = items

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[1] for d in docs])], names=["i", "t"])
    for row in ls._postings(Sent, 8192, 1 << 20)([batch]):
        rows += row.to_pylist()
    df = np.zeros(len(items.vocabulary), np.int64)
    for row in rows:
        df[np.frombuffer(row["terms"], np.int32)] += np.frombuffer(row["counts"], np.int32)
    total = sum(r["n_docs"] for r in rows), sum(r["n_terms"] for r in rows)
    query = ls.Query(items, ls.weights_of(df, total[0]), *total)
    best = ls._Best(20)
    for row in rows:
        ls.evaluate(Counting(row, query), items.terms[0], query.weights[items.terms[0]], best)
    assert sum(calls) < 200
    assert list(best.ids) == list(range(9000, 9020))


def test_whole_table(spark):
    got = ranked(QUERIES["op11_lexical_search"](spark, ORACLE_DIR))
    read = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{ORACLE_DIR}/{name}.parquet").select(*cols).collect()]
    assert got == sorted(brute.lexical(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text")))
