"""Chat formatting: layouts, the template's round trip, digests."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendscope.llm import chat_format as cf

NASTY = [
    "", "plain", "</s>", "<s>[INST] x [/INST]</s>", "[\\INST]", "<\\/s> <\\\\s>", "[[INST]", "[INST", "]", "<<s>>",
    "[INST]\\", "\\", "a\nb\x0b", "é[/INST]🙂</s>", "[/\\INST]", "<\\", "s>", "[\\\\\\/INST]",
]


def records(spark, *rows):
    return spark.createDataFrame([(k, json.dumps(r) if not isinstance(r, str) else r) for k, r in enumerate(rows)], "conv_id long, record string")


def said(turns):
    out = {}
    for r in turns.orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    return out


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": "a"}], "system": "s", "id": 7}, [("system", "s"), ("user", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "p"}, {"text": "q"}]}, {"role": "assistant", "content": "r"}]},
     [("user", "pq"), ("assistant", "r")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "GPT", "value": "b"}, {"from": "tool", "value": "c"}]},
     [("user", "a"), ("assistant", "b"), ("tool", "c")]),
    ({"prompt": "a", "completion": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"prompt": "a", "response": "b", "system": None}, [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "input": "", "output": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "input": "i", "output": "b", "system": "s"}, [("system", "s"), ("user", "a\n\ni"), ("assistant", "b")]),
    ({"question": "a", "answer": 4}, [("user", "a"), ("assistant", "4")]),
    ({"prompt": [{"role": "user", "content": "a"}], "completion": [{"role": "assistant", "content": "b"}]},
     [("user", "a"), ("assistant", "b")]),
    ({"role": "user", "text": "t", "turn": 3}, [("user", "t")]),
]


def test_layouts_of_json(spark):
    df = records(spark, *(record for record, _ in LAYOUTS))
    assert said(cf.canonical_turns_of_json(df)) == {k: want for k, (_, want) in enumerate(LAYOUTS)}
    assert cf.unmapped(df).collect() == []


def test_unknown_records_are_listed(spark):
    bad = ["null", "3", "{broken", {"messages": []}, {"prompt": "a"}, {"prompt": "a", "response": "b", "completion": "c"}, {"x": [{"role": 1}]}]
    df = records(spark, *bad)
    assert cf.canonical_turns_of_json(df).collect() == []
    found = {r.conv_id: r.paths for r in cf.unmapped(df).collect()}
    assert set(found) == set(range(len(bad)))
    assert found[5] == ["completion", "prompt", "response"] and found[6] == []


@pytest.mark.parametrize("record, want", [LAYOUTS[1], LAYOUTS[3], LAYOUTS[7], LAYOUTS[9]])
def test_the_same_layouts_as_columns(spark, record, want):
    typed = spark.read.json(spark.sparkContext.parallelize([json.dumps(record | {"conv_id": 5, "place": 1, "segment": "x"})]))
    assert said(cf.canonical_turns(typed)) == {5: want}


def test_frames_of_no_layout_are_refused(spark):
    with pytest.raises(ValueError, match="no layout"):
        cf.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, prompt string"))


def test_fingerprints_are_of_paths_and_tell_layouts_apart():
    kind = T.StructType.fromDDL("b struct<c: array<struct<d: int, e: array<string>>>>, a string")
    assert cf.schema_paths(kind) == {"a", "b.c[].d", "b.c[].e[]"}
    assert cf.fingerprint(["b", "a"]) == cf.fingerprint(["a", "b"]) != cf.fingerprint(["a.b"])
    with pytest.raises(ValueError, match="fields of another"):
        cf.fingerprints((*cf.LAYOUTS, cf.Layout("again", ("prompt", "response"), (), ())))


def test_escaping_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", cf.escaped(F.col("t")).alias("e"))
    for text, safe in df.collect():
        assert cf.unescaped(safe) == text
        assert not re.search(r"\[/?INST\]|</?s>", safe)


def digest(turns):
    learnt = "".join(t for r, t in turns if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt)


def rows_of(conversations):
    return [(i, k, r, t) for i, turns in conversations.items() for k, (r, t) in enumerate(turns)]


def test_read_back(spark):
    conversations = {
        1: [(r, t) for t in NASTY for r in ("user", "assistant")],
        2: [("assistant", "x" * 300_000)],
        None: [("[INST]odd", "t"), ("", "</s>")],
        3: [("assistant", "a"), ("assistant", "b"), ("tool", "c")],
    }
    df = spark.createDataFrame(rows_of(conversations), "conv_id long, turn long, role string, text string")
    segments = cf.formatted(cf.canonical_turns(df.repartition(4).withColumns({"n_turns": F.lit(1), "loss_start": F.lit("x")})))
    got = {r.conv_id: tuple(r)[1:5] for r in cf.read_back(segments).collect()}
    assert got == {i: digest(turns) for i, turns in conversations.items()}
    for r in cf.whole_conversations(segments).collect():
        turns = conversations[r.conv_id]
        assert [(cf.unescaped(m[1]), cf.unescaped(m[2])) for m in cf.TURN.finditer(r.formatted)] == turns
        assert "".join(m[0] for m in cf.TURN.finditer(r.formatted)) == r.formatted
        masked = [cf.unescaped(r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert masked == [t for role, t in turns if role == "assistant"]


def test_nulls_ties_repeats_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "system", "z")]
    got = cf.read_back(cf.formatted(cf.canonical_turns(spark.createDataFrame(rows, schema)))).first()
    assert tuple(got)[1:5] == digest([("system", "z"), ("", ""), ("user", "a"), ("user", "b"), ("user", "b")])
    empty = cf.read_back(cf.formatted(cf.canonical_turns(spark.createDataFrame([], schema))))
    assert empty.collect() == [] and len(empty.columns) == 6


def test_a_conversation_over_many_batches(spark):
    df = spark.range(25_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text")
    )
    row = cf.read_back(cf.formatted(cf.canonical_turns(df.repartition(7)))).first()
    assert tuple(row)[1:5] == digest([("assistant", str(k)) for k in range(25_000)])


def test_broken_output_is_not_accepted(spark):
    bad = spark.createDataFrame([(1, 0, "[INST]user[/INST]x</s>rest", None, None)], "conv_id long, place long, segment string, loss_start int, loss_end int")
    with pytest.raises(Exception, match="does not follow the template"):
        cf.read_back(bad).collect()
