"""The corpus pipeline, stage by stage against plain Python where that can tell."""

import random

import corpus_pipeline
from lendscope.llm.scratch import stored
from tests.conftest import SMALL
from tests.llm import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(after)
        if name == "quality_rules":
            short = {i for i, t in before.items() if brute.measures(t)[0] < 50}
            assert not short & after.keys()
        if name == "jaccard_join":
            assert set(after) == {least for _, _, least in brute.linked(before.items())}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            held = {i for i, t in before.items() if any(item in t for item in items)}
            assert held <= before.keys() - after.keys()
            assert len(before) - len(after) <= len(held) + 1
        if name == "secret_scan":
            assert after.keys() == before.keys()
            assert not any(brute.secrets(t) for t in after.values())
            assert {i for i in after if after[i] != before[i]} == {i for i in before if brute.secrets(before[i])}
            assert all(texts[i] == after[i] for i in after if not brute.secrets(texts[i]))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in pieces} == set(after)
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 50 and "sequence_id" in out.columns


def _tables(spark, folder, documents, items):
    kind = "doc_id long, text string, lang string, row int, document string, node long, label string, list int, id int"
    rows = [(i, t, "en", 1, "x", 2, "y", 3, 4) for i, t in documents]
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def _prose(seed, n):
    rng = random.Random(seed)
    parts = ("ra", "mo", "ti", "lu", "den", "sor", "vel", "kin")
    words = [f"{a}{b}{c}{d}" for a in ("the ", "", "of ", "and ", "") for b in parts for c in parts for d in parts]
    return ".\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(n)) + "."


def test_odd_tables(spark, tmp_path):
    """Nulls, copies, equal ids, a long text, clashing columns and an empty benchmark."""
    documents = [
        (None, None), (1, None), (2, ""), (None, _prose(1, 12)), (3, _prose(1, 12)), (4, _prose(2, 12)), (4, _prose(2, 12)),
        (4, _prose(3, 12)), (None, _prose(4, 12)), (5, _prose(5, 1500)), (6, "too short"),
    ]
    folder = _tables(spark, tmp_path, documents, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr))
    assert len(seen[0]) == 7 and all(t and len(t) > 100 for _, t in seen[0])
    want = [(None, _prose(4, 12)), (3, _prose(1, 12)), (4, _prose(2, 12)), (4, _prose(3, 12)), (5, _prose(5, 1500))]
    assert seen[1] == sorted(want, key=repr)
    assert seen[3] == seen[2] == seen[1]
    assert corpus_pipeline.run(spark, folder).count() >= 5


def test_empty_tables(spark, tmp_path):
    folder = _tables(spark, tmp_path, [], [(1, "an item of the benchmark")])
    assert corpus_pipeline.run(spark, folder).collect() == []
