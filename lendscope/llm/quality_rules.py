"""Quality rules: a threshold table compiled into one projection over whole texts.

Every measure is a column of built-in functions over one row, so nothing is shuffled and a
hot source or a group of copies costs no more than its own rows. A text's arrays are the
largest thing held, and grow with that text alone.

Defined results: a null or empty text has no words and fails (too few words); repeated rows
are judged one by one; an empty table gives an empty table; columns of the input named like
a measure are shadowed in `measured` and untouched by `kept_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.native_text import SPACES, tail, without, words

# Function words that prose of each language cannot do without.
STOP_WORDS = (
    # English
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with",
    # German
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von", "auf", "für", "zu",
    # French
    "le", "la", "les", "et", "des", "est", "une", "dans", "que", "pour", "pas", "sur", "du",
    # Spanish
    "el", "los", "las", "y", "en", "se", "por", "con", "del", "una", "no", "su", "de",
)

SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """A document fails where `measure` is below `low` or above `high` times `per`."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None

    def fails(self) -> Column:
        scale = F.col(self.per) if self.per else F.lit(1)
        tests = []
        if self.low is not None:
            tests.append(F.col(self.measure) < scale * F.lit(self.low))
        if self.high is not None:
            tests.append(F.col(self.measure) > scale * F.lit(self.high))
        return reduce(lambda a, b: a | b, tests, F.lit(False))


#: The base rules, which decide `base_failed`.
BASE_RULES = (
    Rule("too_short", "n_words", low=50),
    Rule("repeats_itself", "n_repeat_words", per="n_words", high=0.5),
)

#: What else sends a document away. Loose on purpose: clean prose is to stay.
RULES = (
    Rule("word_length", "word_chars", per="n_words", low=2.0, high=16.0),
    Rule("symbols", "n_symbols", per="n_words", high=0.1),
    Rule("repeated_lines", "n_dup_lines", per="n_lines", high=0.6),
    Rule("no_stop_words", "n_stop_words", per="n_words", low=0.02),
)


def _twins(ordered: Column, same, position) -> Column:
    """Of sorted elements, the positions of those that agree with the next one or the one
    before, in the order of the elements."""
    pairs = F.filter(
        F.arrays_zip(
            F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))).alias("a"),
            tail(ordered, 2).alias("b"),
        ),
        lambda z: same(z["a"]) == same(z["b"]),
    )
    return F.array_distinct(
        F.flatten(F.transform(pairs, lambda z: F.array(position(z["a"]), position(z["b"]))))
    )


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the counts that rules use: n_words, word_chars, n_symbols, n_lines,
    n_dup_lines, n_repeat_words, n_stop_words (all long).

    Words in repeated 3-word windows: windows are hashed, packed as (hash, position) into
    longs and sorted; only those whose hash comes twice are compared word by word.
    """
    measures = (
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        "n_stop_words",
    )
    plain = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{text}`").alias("text"),
    )
    split = plain.select(
        "row",
        words(F.col("text")).alias("words"),
        F.coalesce(F.length(without(F.col("text"), SPACES)), F.lit(0)).alias("word_chars"),
        F.coalesce(
            F.length("text") - F.length(without(F.col("text"), SYMBOLS)), F.lit(0)
        ).alias("n_symbols"),
        F.coalesce(
            F.filter(
                F.split("text", "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0
            ),
            F.array().cast("array<string>"),
        ).alias("lines"),
    )
    position = F.lit((1 << 32) - 1)
    packed = split.withColumn(
        "packed",
        F.sort_array(
            F.slice(
                F.transform(
                    "words",
                    lambda word, i: F.shiftleft(
                        F.hash(word, F.get("words", i + 1), F.get("words", i + 2)).cast("long"), 32
                    ).bitwiseOR(i.cast("long")),
                ),
                F.lit(1),
                F.greatest(F.size("words") - 2, F.lit(0)),
            )
        ),
    )
    suspects = packed.withColumn(
        "suspects",
        _twins(
            F.col("packed"),
            lambda packed: F.shiftright(packed, 32),
            lambda packed: packed.bitwiseAND(position).cast("int"),
        ),
    )
    compared = suspects.withColumn(
        "compared",
        F.sort_array(
            F.transform(
                "suspects",
                lambda p: F.struct(
                    F.array_join(F.slice(F.col("words"), p + 1, F.lit(3)), " ").alias("key"),
                    p.alias("position"),
                ),
            )
        ),
    )
    repeated = compared.withColumn(
        "repeated",
        F.sort_array(
            _twins(F.col("compared"), lambda entry: entry["key"], lambda entry: entry["position"])
        ),
    )
    covered = F.aggregate(
        F.arrays_zip(F.col("repeated").alias("here"), tail(F.col("repeated"), 2).alias("after")),
        F.lit(0).cast("long"),
        lambda total, z: total + F.least(F.lit(3), F.coalesce(z["after"] - z["here"], F.lit(3))),
    )
    counted = repeated.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS)))
        .cast("long")
        .alias("n_stop_words"),
    )
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in measures]
    return counted.select(*own, *measures)


def judged(
    docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES
) -> DataFrame:
    """`measured` with base_failed, kept, and `failed`: the names of all rules not met."""
    rows = measured(docs, text)
    any_of = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    failed = F.array_compact(
        F.array(*[F.when(r.fails(), F.lit(r.name)) for r in (*base, *rules)])
    )
    return rows.withColumns(
        {
            "base_failed": any_of([r.fails() for r in base]),
            "kept": ~any_of([r.fails() for r in (*base, *rules)]),
            "failed": failed,
        }
    )


def kept_documents(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that meet every rule, with the columns they came with."""
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"),
        F.col(f"`{text}`").alias("text"),
    )
    # A filter on what built-in functions made would be pushed below them, and have each
    # measure written out again for every use. It stays above a projection with row numbers.
    verdicts = judged(packed, "text", rules).select(
        "document", "kept", F.monotonically_increasing_id().alias("place")
    )
    kept = verdicts.filter(F.col("kept") & (F.col("place") >= 0))
    return kept.select(*[F.col("document").getField(c).alias(c) for c in docs.columns])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_stop_words", F.array_join("failed", ",").alias("failed"),
    )


def _sql_test(rule: Rule) -> str:
    scale = f"{rule.per}::double" if rule.per else "1.0::double"
    low = f"{rule.measure} < {scale} * {rule.low}::double" if rule.low is not None else "false"
    high = f"{rule.measure} > {scale} * {rule.high}::double" if rule.high is not None else "false"
    return f"({low} or {high})"


OP8_SQL = f"""
with t as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), w as (
  select *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from t
), g as (
  select r, i, count(*) over (partition by r, gram) as n
  from (select r, unnest(range(1, len(words) - 1)) as i, unnest(list_transform(range(1, len(words) - 1),
    lambda k: array_to_string(words[k:k + 2], ' '))) as gram from w)
), c as (
  select r, count(distinct i + j) as n from g, (values (0), (1), (2)) as o(j) where n > 1 group by r
), m as (
  select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words,
    len(list_filter(words, lambda x: lower(x) in ({", ".join(f"'{w}'" for w in STOP_WORDS)})))::bigint as n_stop_words
  from w left join c using (r)
), f as (
  select *, {" or ".join(_sql_test(r) for r in BASE_RULES)} as base_failed,
    array_to_string(list_filter([{", ".join(f"case when {_sql_test(r)} then '{r.name}' end" for r in (*BASE_RULES, *RULES))}],
      lambda x: x is not null), ',') as failed
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(failed, '') = '' as kept, n_stop_words, coalesce(failed, '') as failed
from f
"""
