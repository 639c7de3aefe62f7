"""Periodic runs against a search of every period."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.llm import periodic_runs as pr
from lendscope.llm.catalog import QUERIES
from tests.conftest import SMALL
from tests.llm import brute

DOCS = "doc_id long, text string"


def repetitive(rng):
    out, kinds = [], rng.choice([1, 2, 2, 3, 6, 30])
    for _ in range(rng.randint(0, 6)):
        part = [rng.randrange(kinds) for _ in range(rng.randint(1, 14))] * rng.choice([1, 2, 3, 4, 9])
        out += part[: max(0, len(part) - rng.randint(0, 3))]
    return out


def test_suffix_order_and_shared_prefixes():
    rng = random.Random(2)
    for _ in range(50):
        docs = [repetitive(rng) for _ in range(3)]
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        codes = np.array([c for d in docs for c in d], np.int64)
        if not len(codes):
            continue
        tails = [(d, doc[k:]) for d, doc in enumerate(docs) for k in range(len(doc))]
        found = pr.suffixes(codes, first)
        order = sorted(range(len(tails)), key=tails.__getitem__)
        assert found.order.tolist() == order
        assert found.slot[found.order].tolist() == list(range(len(order)))
        for slot, lcp in enumerate(pr.shared_prefixes(found).tolist()):
            (a, x), (b, y) = tails[order[slot - 1]], tails[order[slot]]
            want = 0
            while slot and a == b and want < min(len(x), len(y)) and x[want] == y[want]:
                want += 1
            assert lcp == want


@pytest.mark.parametrize("least, exponent", [(24, 3), (4, 2), (6, 3), (2, 2)])
def test_runs_of_lists(least, exponent):
    rng = random.Random(least)
    for _ in range(150):
        docs = [repetitive(rng) for _ in range(rng.randint(1, 5))]
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        found = pr.runs_of(np.array([c for d in docs for c in d], np.int64), first, least, exponent)
        got = list(zip(found.start.tolist(), found.length.tolist(), found.period.tolist(), strict=True))
        want = [(s + int(first[k]), n, q) for k, d in enumerate(docs) for s, n, q in brute.runs(d, least, exponent)]
        assert got == want


TEXTS = [
    None, "", " \n\t", "one", "a " * 23, "a " * 24, "a b " * 12, "a b " * 12 + "a", "x " + "a b c " * 8 + "y",
    ("p q r s t u v w x " * 3).strip(), "p q r s t u v w x " * 2, "a " * 30 + "b " * 30, "a b a b a c " * 9,
    "é ü\n" * 40, "w" * 50_000 + " " + "z " * 5_000, " ".join(f"w{k}" for k in range(3000)) + " " + "k l m " * 2000,
    "\x0bA a\x0cA a " * 13, "a\x85b " * 30,
]


def check(out, rows):
    want = sorted(
        ((i, len(w), f, brute.collapsed(w, f)) for i, w, f in ((i, w, brute.runs(w)) for i, w in rows)), key=repr
    )
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed_text) for r in out.collect()]
    assert sorted(got, key=repr) == want


def test_texts(spark):
    rows = [(k if k % 5 else None, t) for k, t in enumerate(TEXTS)] + [(1, TEXTS[5]), (1, TEXTS[5])]
    df = spark.createDataFrame(rows, DOCS).repartition(2)
    check(pr.periodic_runs(df), [(i, brute.WORD.findall(t or "")) for i, t in rows])


def test_more_columns_and_no_rows(spark):
    df = spark.createDataFrame([(3, "a " * 24)], DOCS)
    odd = df.withColumnsRenamed({"doc_id": "runs", "text": "n_words"}).withColumns({n: F.lit("?") for n in ("text", "doc_id", "h", "start")})
    row = pr.periodic_runs(odd, "runs", "n_words").first()
    assert (row.doc_id, row.n_words, row.collapsed_text, tuple(row.runs[0])) == (3, 24, "a", (0, 24, 1))
    assert pr.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="two words"):
        pr.periodic_runs(df, min_exponent=1)


def test_only_documents_with_repeats_are_sorted(monkeypatch):
    import pyarrow as pa

    from lendscope.llm import words as W

    seen = []
    real = pr.suffixes
    monkeypatch.setattr(pr, "suffixes", lambda codes, first: seen.append(len(codes)) or real(codes, first))
    texts = pa.array([" ".join(f"u{k}" for k in range(500)), "a b " * 20, "c " * 15])
    pr._runs_of_slice(W.split(*W.raw(texts)), 24, 3)
    assert seen == [40]


def test_whole_table(spark):
    """The registered query, over all documents of the smallest table."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want, some = [], 0
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, text in docs:
        own = brute.made_periodic(i, text)
        found = brute.runs(own)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        some += bool(found)
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        want.append((i, len(found), *figures, sha(lines), sha(brute.collapsed(own, found))))
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SMALL).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert 10 < some < len(docs)
