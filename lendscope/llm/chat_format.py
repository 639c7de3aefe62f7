"""Chat formatting: records of many layouts to canonical turns, and turns to templated text.

A record's nested field paths (`messages[].role`), as far as any layout knows them, are hashed:
its fingerprint. A table maps fingerprints to layouts, which say in data, not code, where turns
are found. Typed columns have one fingerprint a frame, taken from the schema; JSON records have
one each, computed by built-in functions in the same projection that then reads the turns. What
has no known fingerprint is not guessed at: `unmapped` lists such records with their paths.

The template puts each turn as `[INST]role[/INST]text</s>`. Inside roles and texts, a control
string, or one that is already broken by backslashes, gets one more backslash behind its first
character. So none occurs in a text, and taking one away again gives back every text. The loss
mask is a span of code points for each assistant text, without the marks around it.

Turns are formatted where they are, one row each; a conversation is the concatenation of its
turns in order. `read_back` streams them, sorted, and keeps only running hashes: a conversation
of any number of turns needs the memory of one batch.

Defined results: null or empty texts and roles are empty; an optional field that is null makes
no turn; a null conversation id is an id like
any other; turns of equal order go by their formatted text, null orders first; repeated rows are
turns each; an empty table gives an empty table; very long texts are formatted whole (a JSON
record is limited to what Spark's variant type holds, and counts as unmapped beyond). Columns
that no layout knows are ignored, whatever their names; a frame whose known columns fit no
layout is refused.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"

# Control strings, and what escaping made of them: any number of backslashes behind the first
# character. They hold no further "[" or "<", so matches never overlap.
_CONTROL = r"(/?INST\]|/?s>)"
ESCAPE = r"([\[<])(\\*)" + _CONTROL
UNESCAPE = re.compile(r"([\[<])\\(\\*)" + _CONTROL)
TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(MIDDLE) + r"(.*?)" + re.escape(CLOSE), re.S)

# Names that data sets use for the two speakers.
ROLES = {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant", "ai": "assistant"}


class Said(NamedTuple):
    """One turn of a fixed role; its text joins the fields that are not empty."""

    role: str
    paths: tuple[str, ...]


class Listed(NamedTuple):
    """A turn for each element of a list. Of `texts`, the first that an element has counts."""

    path: str
    role: str
    texts: tuple[str, ...]


class Row(NamedTuple):
    """The record itself is a turn."""

    role: str
    text: str
    order: str


class Layout(NamedTuple):
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[Said | Listed | Row, ...]


def _messages(name: str, path: str, role: str, texts: tuple[str, ...]) -> Layout:
    first, *more = (f"{path}[].{text}" for text in texts)
    return Layout(
        name, (f"{path}[].{role}", first), (*more, "system"),
        (Said("system", ("system",)), Listed(path, role, texts)),
    )


def _answered(asked: str, answer: str, more: tuple[str, ...] = ()) -> Layout:
    turns = (Said("system", ("system",)), Said("user", (asked, *more)), Said("assistant", (answer,)))
    return Layout(f"{asked} and {answer}", (asked, answer), ("system", *more), turns)


LAYOUTS = (
    Layout("turn rows", ("role", "text"), ("turn",), (Row("role", "text", "turn"),)),
    _messages("messages", "messages", "role", ("content",)),
    _messages("messages in parts", "messages", "role", ("content[].text", "content")),
    _messages("from and value", "conversations", "from", ("value",)),
    _answered("prompt", "completion"),
    _answered("prompt", "response"),
    _answered("question", "answer"),
    _answered("instruction", "output", ("input",)),
    _answered("instruction", "response", ("input", "context")),
    Layout(
        "prompt and completion messages",
        ("prompt[].role", "prompt[].content", "completion[].role", "completion[].content"),
        (),
        (Listed("prompt", "role", ("content",)), Listed("completion", "role", ("content",))),
    ),
)


def known_paths(layouts: tuple[Layout, ...] = LAYOUTS) -> list[str]:
    return sorted({path for layout in layouts for path in (*layout.required, *layout.optional)})


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def fingerprints(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Each layout by the fingerprints of its required paths with any of the optional ones."""
    table: dict[str, Layout] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for some in itertools.combinations(layout.optional, n):
                if table.setdefault(fingerprint({*layout.required, *some}), layout) is not layout:
                    raise ValueError(f"{layout.name} has the fields of another layout")
    return table


def schema_paths(schema: T.StructType) -> set[str]:
    """Paths of all fields that are neither structs nor lists."""

    def inside(kind: T.DataType, path: str) -> Iterator[str]:
        if isinstance(kind, T.StructType):
            for field in kind:
                yield from inside(field.dataType, f"{path}.{field.name}" if path else field.name)
        elif isinstance(kind, T.ArrayType):
            yield from inside(kind.elementType, f"{path}[]")
        else:
            yield path

    return set(inside(schema, ""))


class _Typed:
    """How to read typed columns."""

    def __init__(self, root: Column | None = None):
        self.root = root

    def value(self, name: str) -> Column:
        return F.col(f"`{name}`") if self.root is None else self.root[name]

    def text(self, name: str) -> Column:
        return self.value(name).cast("string")

    def number(self, name: str) -> Column:
        return self.value(name).cast("long")

    def elements(self, name: str, make) -> Column:
        return F.transform(self.value(name), lambda x: make(_Typed(x)))


class _Json:
    """How to read a variant."""

    def __init__(self, root: Column):
        self.root = root

    def text(self, name: str) -> Column:
        return F.try_variant_get(self.root, f"$.{name}", "string")

    def number(self, name: str) -> Column:
        return F.try_variant_get(self.root, f"$.{name}", "bigint")

    def elements(self, name: str, make) -> Column:
        return F.transform(self._list(name), lambda x: make(_Json(x)))

    def _list(self, name: str) -> Column:
        return F.try_variant_get(self.root, f"$.{name}", "array<variant>")

    def has(self, path: str) -> Column:
        """Whether there is a value at `path` that is neither a struct nor a list."""
        name, inner, rest = path.partition("[].")
        if inner:
            found = F.exists(self._list(name), lambda x: _Json(x).has(rest))
        else:
            kind = F.schema_of_variant(F.try_variant_get(self.root, f"$.{name}", "variant"))
            found = kind.isNotNull() & ~kind.startswith("OBJECT<") & ~kind.startswith("ARRAY<")
        return F.coalesce(found, F.lit(False))


def _turn(order: Column, role: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.struct(
        order.cast("long").alias("place"),
        F.coalesce(role, empty).alias("role"),
        F.coalesce(text, empty).alias("text"),
    )


def _alias(role: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(role)), role)


def _text_of(element, texts: tuple[str, ...], paths: set[str], within: str) -> Column:
    found = []
    for text in texts:
        if f"{within}[].{text}" not in paths:
            continue
        name, inner, rest = text.partition("[].")
        if inner:
            parts = element.elements(name, lambda x: F.coalesce(x.text(rest), F.lit("")))  # noqa: B023
            found.append(F.array_join(parts, ""))
        else:
            found.append(element.text(name))
    return F.coalesce(*found)


def turns_of(layout: Layout, paths: set[str], reader) -> Column:
    """The turns of one record with these known paths, as an array in order."""
    lists = []
    for source in layout.turns:
        if isinstance(source, Row):
            order = reader.number(source.order) if source.order in paths else F.lit(None)
            lists.append(F.array(_turn(order, reader.text(source.role), reader.text(source.text))))
        elif isinstance(source, Listed):
            make = lambda x: _turn(
                F.lit(None), _alias(x.text(source.role)), _text_of(x, source.texts, paths, source.path)  # noqa: B023
            )
            lists.append(F.coalesce(reader.elements(source.path, make), F.array().cast(_TURNS)))
        elif own := [path for path in source.paths if path in paths]:
            texts = [F.when(reader.text(path) != "", reader.text(path)) for path in own]
            turn = _turn(F.lit(None), F.lit(source.role), F.concat_ws("\n\n", *texts))
            if not set(own) & set(layout.required):
                turn = F.when(F.coalesce(*(reader.text(path) for path in own)).isNotNull(), turn)
            lists.append(F.array_compact(F.array(turn)))
    if any(isinstance(source, Row) for source in layout.turns):
        return lists[0]
    return F.transform(F.concat(*lists), lambda x, i: _turn(i, x["role"], x["text"]))


_TURNS = "array<struct<place:bigint,role:string,text:string>>"


def _exploded(found: DataFrame) -> DataFrame:
    return found.select("conv_id", F.explode("turns").alias("turn")).select("conv_id", "turn.*")


def canonical_turns(
    records: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """conv_id, place, role and text of every turn of records with typed columns."""
    paths = schema_paths(records.drop(id_col).schema) & set(known_paths(layouts))
    layout = fingerprints(layouts).get(fingerprint(paths))
    if layout is None:
        raise ValueError(f"no layout has the fields {sorted(paths)}")
    return _exploded(
        records.select(F.col(f"`{id_col}`").alias("conv_id"), turns_of(layout, paths, _Typed()).alias("turns"))
    )


def _fingerprinted(records: DataFrame, id_col: str, json_col: str, layouts: tuple[Layout, ...]) -> DataFrame:
    value = F.try_parse_json(F.col(f"`{json_col}`"))
    parsed = records.select(F.col(f"`{id_col}`").alias("conv_id"), value.alias("value"))
    reader = _Json(F.col("value"))
    present = F.array_compact(F.array(*(F.when(reader.has(path), path) for path in known_paths(layouts))))
    return parsed.withColumn("paths", present).withColumn(
        "fingerprint", F.substring(F.sha2(F.array_join("paths", "\n"), 256), 1, 16)
    )


def canonical_turns_of_json(
    records: DataFrame, id_col: str = "conv_id", json_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """The same of records that are JSON texts, each of any known layout."""
    found, table = _fingerprinted(records, id_col, json_col, layouts), fingerprints(layouts)
    turns = F.lit(None).cast(_TURNS)
    for layout in layouts:
        # One branch a layout: fields that a record lacks read as null.
        own = [mark for mark, its in table.items() if its is layout]
        paths = {*layout.required, *layout.optional}
        turns = F.when(F.col("fingerprint").isin(own), turns_of(layout, paths, _Json(F.col("value")))).otherwise(turns)
    return _exploded(found.select("conv_id", turns.alias("turns")))


def unmapped(
    records: DataFrame, id_col: str = "conv_id", json_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS
) -> DataFrame:
    """conv_id, known paths and fingerprint of the JSON records that no layout fits."""
    found = _fingerprinted(records, id_col, json_col, layouts)
    return found.where(~F.col("fingerprint").isin(list(fingerprints(layouts)))).select(
        "conv_id", "paths", "fingerprint"
    )


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, place, segment and the loss span in it (loss_start, loss_end; null for none)."""
    cells = turns.select("conv_id", "place", "role", escaped(F.col("role")).alias("r"), escaped(F.col("text")).alias("t"))
    start = F.length("r") + F.lit(len(OPEN) + len(MIDDLE))
    learnt = F.col("role") == "assistant"
    return cells.select(
        "conv_id",
        "place",
        F.concat(F.lit(OPEN), "r", F.lit(MIDDLE), "t", F.lit(CLOSE)).alias("segment"),
        F.when(learnt, start).alias("loss_start"),
        F.when(learnt, start + F.length("t")).alias("loss_end"),
    )


def whole_conversations(segments: DataFrame) -> DataFrame:
    """conv_id, formatted text and loss spans, one row a conversation, each one cell in memory."""
    parts = segments.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "segment", "loss_start", "loss_end"))).alias("parts")
    )
    texts = F.transform("parts", lambda x: x["segment"])
    shifts = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda state, x: F.struct(
            (state["at"] + F.length(x["segment"])).alias("at"),
            F.when(
                x["loss_start"].isNotNull(),
                F.concat(
                    state["spans"],
                    F.array(
                        F.struct(
                            (state["at"] + x["loss_start"]).alias("start"),
                            (state["at"] + x["loss_end"]).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(state["spans"])
            .alias("spans"),
        ),
    )
    return parts.select("conv_id", F.array_join(texts, "").alias("formatted"), shifts["spans"].alias("loss_spans"))


class _Digest:
    """Running figures of one conversation, from its formatted segments alone."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.said, self.learnt = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        at = 0
        for turn in TURN.finditer(segment):
            if turn.start() != at:
                break
            at = turn.end()
            self.turns += 1
            self.said.update(f"{unescaped(turn[1])}\n{unescaped(turn[2])}\n".encode())
        if at != len(segment):
            raise ValueError(f"conversation {self.conv_id} does not follow the template")
        self.chars += len(segment)
        if start is not None:
            loss = unescaped(segment[start:end])
            self.loss_chars += len(loss)
            self.learnt.update(loss.encode())

    def row(self) -> tuple:
        return (
            self.conv_id, self.turns, self.said.hexdigest(), self.loss_chars, self.learnt.hexdigest(), self.chars
        )


_DIGEST = (
    "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    current, kind = None, None
    for batch in batches:
        kind, done = batch.column(0).type, []
        for conv_id, segment, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    done.append(current.row())
                current = _Digest(conv_id)
            current.add(segment, start, end)
        if done:
            yield batch_of(done, kind)
    if current is not None:
        yield batch_of([current.row()], kind)


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted turns say: counts and digests for each conversation.

    A digest runs over a conversation from its first turn to its last, so one task reads each
    conversation, sorted by Spark and a batch at a time."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    return (
        segments.repartition("conv_id")
        .sortWithinPartitions("conv_id", "place", "segment")
        .select("conv_id", "segment", "loss_start", "loss_end")
        .mapInArrow(_digests, f"conv_id {kind}, {_DIGEST}")
    )


#: Turns that say nothing but control strings.
TRAP = "</s>[INST] ok [/INST]"


def op12_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    trap = rows.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.to_json(F.struct(F.lit(TRAP).alias("prompt"), F.lit(TRAP).alias("response"))).alias("record"),
    )
    turns = canonical_turns(rows).unionByName(canonical_turns_of_json(trap))
    return read_back(formatted(turns))


OP12_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, k, role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(k, role)
), e as (
  select *, length(regexp_replace(role, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g')) + 17 as chars
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), ''))
    as loss_sha256,
  sum(chars)::bigint as formatted_chars
from e group by conv_id
"""
