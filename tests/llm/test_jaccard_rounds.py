"""The n-gram Jaccard join: sorting of sets, and groups that become one component early."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lendscope.llm import jaccard_join as jj
from lendscope.llm import words as W
from tests.llm import brute
from tests.llm.test_jaccard_parts import near_copies


@pytest.mark.parametrize("texts", [1, 2, 70])
def test_grams_are_sorted_within_texts(texts):
    rng = np.random.default_rng(texts)
    of = np.sort(rng.integers(0, texts, 900))
    gram = rng.integers(0, 1 << 64, 900, dtype=np.uint64)
    gram[:300] &= np.uint64(7)  # told apart by their last bits only
    for keys in (gram, gram[300:]):
        own = of[: len(keys)]
        order, want = jj._by_text(keys, own, texts), np.lexsort((keys, own))
        assert (keys[order] == keys[want]).all() and (own[order] == own[want]).all()


@pytest.mark.parametrize("share", [0, 0.3, 1])
def test_frequent_grams_come_last(share):
    sets = jj.Sets(pa.array(near_copies(3, 20, (0, 3, 9), 80) + ["", None, "one two"]))
    bits = np.packbits(np.random.default_rng(4).random(1 << 10) < share, bitorder="little")
    late = jj._frequent(sets.gram, bits).astype(np.uint64) << np.uint64(63)
    place = sets.gram >> np.uint64(1) | late
    order = np.lexsort((place, sets.of))
    got, of = sets.ordered(bits)
    assert (got == place[order]).all() and (of == sets.of[order]).all()


def test_known_powers_are_those_of_the_base():
    for n in (5, 3, 0, 9):
        assert [int(x) for x in W._powers(12345677, n)] == [pow(12345677, k, 1 << 64) for k in range(n)]


def joined(spark, sets):
    """Labels of nodes whose pairs are all still to be verified."""
    rows = [(k, 0, len(s), bytearray(np.array(sorted(s), np.uint64).tobytes())) for k, s in sets.items()]
    pairs = [(a, b, len(sets[a] & sets[b])) for b in sets for a in sets if a < b]
    links = jj._connected(
        spark.createDataFrame([], "a long, b long"),
        spark.createDataFrame(pairs, "a long, b long, shared long"),
        spark.createDataFrame(rows, jj.SETS),
    )
    return {r.node: r.label for r in jj.components(links).collect()}


def test_a_group_takes_few_pairs(spark, monkeypatch):
    """Pairs that are verified grow with a group's nodes, not with their square."""
    verified, seen = jj.verified, []
    monkeypatch.setattr(jj, "verified", lambda pairs, sets: seen.append(pairs.count()) or verified(pairs, sets))
    rng = random.Random(1)
    sets = {k: {x for x in range(200) if rng.random() > 0.04} for k in range(60)}
    assert joined(spark, sets) == dict.fromkeys(range(60), 0)
    assert sum(seen) < 3 * 60


def test_nearest_pairs_alone_are_not_enough(spark):
    """Two groups that only links between nodes join, which are no node's nearest."""
    sets = {k: set(range(100)) | {1000 + k} for k in range(4)}
    sets |= {k: set(range(8, 108)) | {1000 + k} for k in range(4, 8)}
    assert joined(spark, sets) == dict.fromkeys(range(8), 0)


def test_linked_documents_of_a_group(spark):
    texts = near_copies(11, 50, (2, 3, 4, 5), 100) + near_copies(12, 30, (1, 2), 30) + ["", None, "one two"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.linked_documents(docs).collect())
    assert got == brute.linked(rows)
