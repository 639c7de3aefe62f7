"""The n-gram Jaccard join: what blocks know of sets, and pairs that become rows in a large group."""

import numpy as np
import pytest

from lendscope.llm import jaccard_join as jj
from tests.llm import brute
from tests.llm.test_jaccard_parts import gram_sets, near_copies


@pytest.mark.parametrize("size", [1, 2, 3, 40, 700, 5000])
def test_prints_bound_what_sets_share(size):
    sets = gram_sets(np.random.default_rng(size), 9, max(2, size)) if size > 3 else [np.arange(1, size + 1, dtype=np.uint64)]
    known = [jj.unpacked(jj.packed(s), len(s)) for s in sets]
    for s, (sign, own) in zip(sets, known, strict=True):
        assert (sign == jj.signature(s)).all()
        assert own is None or size <= jj.MAX_PRINTS
        if own is not None:
            shared = [len(np.intersect1d(s, other)) for other in sets]
            assert jj.shared_prints(own, [k[1] for k in known]).tolist() == shared


def test_pairs_left_of_a_group_are_few(spark, monkeypatch):
    """A group in long lists whose least nodes are linked with few: no pairs by the square."""
    monkeypatch.setattr(jj, "SHORT", 6)
    monkeypatch.setattr(jj, "MEMBERS", 64)
    stored, seen = jj.stored, {}

    def counted(df, name):
        out = stored(df, name)
        seen[name] = max(seen.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jj, "stored", counted)
    rows = list(enumerate(near_copies(22, 150, (1, 2, 2, 3, 4, 4))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jj.linked_documents(docs).collect())
    assert got == brute.linked(rows)
    assert seen["jaccard-nearest"] <= 150
    assert seen["jaccard-rest"] <= 150, seen
