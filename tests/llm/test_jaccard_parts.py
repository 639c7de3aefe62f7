"""Parts of the n-gram Jaccard join: signatures, pairs of lists, groups just below the limit."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lendscope.llm import jaccard_join as jj
from tests.llm import brute


def gram_sets(rng, n, size):
    pool = rng.integers(1, 1 << 62, 3 * size, dtype=np.uint64)
    return [rng.choice(pool, rng.integers(size // 2, size), replace=False) for _ in range(n)]


@pytest.mark.parametrize("size", [2, 40, 700, 5000])
def test_signatures_bound_what_sets_share(size):
    sets = gram_sets(np.random.default_rng(size), 12, size)
    width = min(jj.signature_bits(len(s)) for s in sets)
    signs = []
    for s in sets:
        sign = jj.signature(s)[None]
        while sign.shape[1] * 64 > width:
            sign = jj.folded(sign)
        signs.append(sign[0])
    table, sizes = np.stack(signs), np.array([len(s) for s in sets])
    for k, own in enumerate(sets):
        bound = jj.most_shared(table[k], table, sizes[k], sizes)
        shared = [len(np.intersect1d(own, other)) for other in sets]
        assert (bound >= shared).all()
        assert bound[k] == sizes[k]


def test_folding_is_hashing_with_a_bit_less(monkeypatch):
    grams = gram_sets(np.random.default_rng(1), 1, 400)[0]
    wide = jj.signature(grams)
    monkeypatch.setattr(jj, "signature_bits", lambda n: len(wide) * 32)
    assert (jj.folded(wide[None])[0] == jj.signature(grams)).all()


@pytest.mark.parametrize("flat", [3, 1 << 20])
@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_pairs_of_short_lists(monkeypatch, flat, batch):
    monkeypatch.setattr(jj, "FLAT_PAIRS", flat)
    rng = random.Random(2)
    rows = sorted(
        {(rng.randrange(9), rng.randrange(4), rng.randrange(60), rng.choice([90, 100, 130, 200])) for _ in range(120)}
    )
    names = ["list", "label", "node", "code", "shared"]
    table = [pa.array(x, pa.int64()) for x in zip(*(r + (r[0] + 1,) for r in rows), strict=True)]
    whole = pa.RecordBatch.from_arrays(table, names=names)
    got = []
    for out in jj._across(iter([whole.slice(k, batch) for k in range(0, len(rows), batch)])):
        got += [tuple(r.values()) for r in out.to_pylist()]
    want = []
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] < b[1] and 100 * min(a[3], b[3]) >= 75 * max(a[3], b[3]):
                one, two = sorted([a, b], key=lambda r: r[2]) if a[2] != b[2] else (a, b)
                want.append((one[2], two[2], one[3], two[3], a[0] + 1))
    assert sorted(got) == sorted(want)


def near_copies(seed, n, edits, words=200):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.choice(edits)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_a_group_just_below_the_limit(spark, monkeypatch):
    """Long lists in several blocks, by signatures: the same components."""
    monkeypatch.setattr(jj, "SHORT", 6)
    monkeypatch.setattr(jj, "MEMBERS", 16)
    texts = near_copies(5, 90, (2, 4, 6, 7, 8, 9)) + near_copies(6, 12, (1, 5), 40) + ["", None, "one two"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.linked_documents(docs).collect())
    assert got == brute.linked(rows)


def test_blocks_refute_only_what_is_not_alike(monkeypatch):
    """What `_refuted` leaves holds every pair of 0.75 or more, and few others."""
    texts = near_copies(7, 60, (1, 3, 5, 8, 11, 14), 300)
    sets = jj.Sets(pa.array(texts))
    grams = [sets.gram[sets.first[k] : sets.first[k + 1]] for k in range(len(texts))]
    rows = [(7, 0, 0, 0, k, k, jj.size_code(sets.size[k : k + 1])[0], 1, len(g)) for k, g in enumerate(grams)]
    names = ["list", "low", "high", "own", "label", "node", "code", "shared", "size"]
    columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
    columns.append(pa.array([jj.signature(g).tobytes() for g in grams], pa.binary()))
    batch = pa.RecordBatch.from_arrays(columns, names=[*names, "bits"])
    got = set()
    for out in jj._refuted(iter([batch.slice(0, 25), batch.slice(25)])):
        got |= {(r["a"], r["b"]) for r in out.to_pylist()}
    pairs = [(a, b) for b in range(len(grams)) for a in range(b)]
    alike = lambda a, b: len(np.intersect1d(grams[a], grams[b])) / len(np.union1d(grams[a], grams[b]))
    assert {p for p in pairs if alike(*p) >= 0.75} <= got
    assert not {p for p in pairs if alike(*p) < 0.70} & got


def test_documents_stay_where_they_are(spark, monkeypatch, tmp_path):
    rows = [(k if k % 4 else None, t) for k, t in enumerate(near_copies(9, 30, (0, 1, 40), 60) * 2 + [None, ""])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    by_bits = sorted(map(repr, jj.one_of_each(docs).collect()))
    monkeypatch.setattr(jj, "ROWS_AS_BITS", 0)
    assert by_bits == sorted(map(repr, jj.one_of_each(docs).collect()))
