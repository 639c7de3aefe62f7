"""Secret scan: patterns, and weak parts that count only next to their complement.

Some credentials come in parts. An access identifier is telling by itself; a 40-character
token or an address is not. Both are reported only where the parts that complete them lie
within the same scope, an interval of code points around the part: a token near an access
identifier, an address near an access identifier or an assigned secret. The interval join
asks only for the nearest complement on either side, which ordered windows over the few
found spans give; no pairs are made, however many parts a text has.

Positions: a text's matches and the pieces between them have lengths, whose running sum
gives each start. Texts stay in the scan; only match rows are shuffled, by row.

Defined results: a null or empty text has no spans; an id may be null or repeated, each row
is scanned by itself; spans of one kind never overlap; weak parts that overlap a base span
are dropped; the rows must come from a stored table, since they are numbered by their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns of the base kinds, given.
ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Weak parts: a token as long as an access identifier's secret, and an address.
TOKEN = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ADDRESS = r"[a-z][a-z0-9+.-]{1,9}://[A-Za-z0-9._~:@-]+"

PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN, "address": ADDRESS}
BASE = ("assign", "access", "hex")
ORDER = {kind: k for k, kind in enumerate(PATTERNS)}

#: Code points between a weak part and its complement, at most.
SCOPE = 400


def _pieces(text: Column, kind: str, where: Column) -> Column:
    """Matches of one kind: struct(kind, nth, gap before it, its length, whether it counts)."""
    pattern = F.lit(PATTERNS[kind])
    counts = (
        (lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)
        if kind == "assign"
        else (lambda m: F.lit(True))
    )
    matches = F.arrays_zip(
        F.regexp_extract_all(text, pattern, 0).alias("match"),
        F.transform(F.split(text, PATTERNS[kind], -1), lambda p: F.length(p)).alias("gap"),
    )
    found = F.transform(
        F.filter(matches, lambda z: z["match"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("nth"),
            z["gap"].alias("gap"),
            F.length(z["match"]).alias("length"),
            counts(z["match"]).alias("counts"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,nth:int,gap:int,length:int,counts:boolean>>")
    return F.coalesce(F.when(where, found), none)


def has_base(text: Column) -> Column:
    """Whether a text may hold a base span; false for null."""
    return F.coalesce(
        (F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS)) | text.rlike(HEX) | text.rlike(ASSIGN),
        F.lit(False),
    )


def _matches(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """A row for each match, and one without a kind for each document that has none. Weak
    parts are looked for only where a base match may complete them."""
    text = F.col("text")
    flagged = docs.select(
        *keep,
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{text_col}`").alias("text"),
        *[
            (F.contains(F.col(f"`{text_col}`"), F.lit("AKIA")) & F.col(f"`{text_col}`").rlike(p)).alias(f"has_{k}")
            if k == "access"
            else F.col(f"`{text_col}`").rlike(p).alias(f"has_{k}")
            for k, p in PATTERNS.items()
            if k in BASE
        ],
    )
    parts = F.concat(
        _pieces(text, "assign", F.col("has_assign")),
        _pieces(text, "access", F.col("has_access")),
        _pieces(text, "hex", F.col("has_hex")),
        _pieces(text, "token", F.col("has_access")),
        _pieces(text, "address", F.col("has_access") | F.col("has_assign")),
    )
    names = [c for c in flagged.columns if c not in ("text", *[f"has_{k}" for k in BASE])]
    return flagged.select(*names, F.explode_outer(parts).alias("part")).select(*names, "part.*")


def found_spans(matches: DataFrame, scope: int = SCOPE) -> DataFrame:
    """`matches` with start, end (code points, end exclusive), `linked_to` (the start of the
    complement of a weak part). What does not count stays as a row without a kind."""
    dealt = matches.repartition("row")
    in_kind = Window.partitionBy("row", "kind").orderBy("nth")
    ends = F.sum((F.col("gap") + F.col("length")).cast("long")).over(in_kind)
    placed = (
        dealt.withColumn("end", ends)
        .withColumn("start", F.col("end") - F.col("length"))
        .withColumn("kind", F.when(F.col("counts"), F.col("kind")))
    )
    base = F.col("kind").isin(*BASE)
    key = lambda kinds, what: F.when(F.col("kind").isin(*kinds), F.col(what))
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    after = (
        Window.partitionBy("row")
        .orderBy(F.desc("start"), F.desc("end"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    near = placed
    for name, kinds in (("access", ("access",)), ("any", ("access", "assign"))):
        near = near.withColumns(
            {
                f"{name}_end": F.max(key(kinds, "end")).over(before),
                f"{name}_last": F.last(key(kinds, "start"), ignorenulls=True).over(before),
                f"{name}_next": F.min(key(kinds, "start")).over(after),
            }
        )
    near = near.withColumns(
        {
            "base_end": F.max(F.when(base, F.col("end"))).over(before),
            "base_next": F.min(F.when(base, F.col("start"))).over(after),
        }
    )
    free = F.coalesce(F.col("base_end") <= F.col("start"), F.lit(True)) & F.coalesce(
        F.col("base_next") >= F.col("end"), F.lit(True)
    )

    def complement(name: str) -> Column:
        left = F.col("start") - F.col(f"{name}_end") <= scope
        right = F.col(f"{name}_next") - F.col("end") <= scope
        return F.when(left, F.col(f"{name}_last")).when(right, F.col(f"{name}_next"))

    linked = F.when(
        free,
        F.when(F.col("kind") == "token", complement("access")).when(
            F.col("kind") == "address", complement("any")
        ),
    )
    weak = F.col("kind").isNotNull() & ~base
    return (
        near.withColumn("linked_to", linked)
        .withColumn("kind", F.when(~weak | F.col("linked_to").isNotNull(), F.col("kind")))
        .select(*[c for c in matches.columns if c not in ("nth", "gap", "length", "counts")], "start", "end", "linked_to")
    )


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE
) -> DataFrame:
    """Each document's id, `row`, and `spans`: array<struct<start, place, kind, end, linked_to>>
    ordered by start, then kind as listed in PATTERNS."""
    matches = _matches(docs, text_col, [F.col(f"`{id_col}`").alias(id_col)])
    place = F.lit(None).cast("int")
    for kind, k in ORDER.items():
        place = F.when(F.col("kind") == kind, F.lit(k)).otherwise(place)
    return (
        found_spans(matches, scope)
        .groupBy("row")
        .agg(
            F.first(id_col).alias(id_col),
            F.sort_array(
                F.collect_list(
                    F.when(
                        F.col("kind").isNotNull(),
                        F.struct("start", place.alias("place"), "kind", "end", "linked_to"),
                    )
                )
            ).alias("spans"),
        )
    )


def redacted(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """`docs` with each secret in the text replaced by its kind in brackets.

    Documents without a base span, nearly all, pass through the scan; the others meet their
    spans by row number.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    numbered = docs.select(
        F.struct(*columns).alias("document"),
        F.col(f"`{text_col}`").alias("text"),
        F.monotonically_increasing_id().alias("id"),
        has_base(F.col(f"`{text_col}`")).alias("hit"),
    )
    unpack = [F.col("document").getField(c).alias(c) for c in docs.columns]
    clean = numbered.filter("not hit").select(*unpack)
    hits = numbered.filter("hit")
    spans = scan_secrets(hits.select("id", "text"), "id", "text", scope)
    # Overlapping spans become one, named after the first.
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"),
        lambda out, s: F.when(
            (F.size(out) > 0) & (F.element_at(out, -1)["end"] > s["start"]),
            F.concat(
                F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.element_at(out, -1)["start"].alias("start"),
                        F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"),
                        F.element_at(out, -1)["kind"].alias("kind"),
                    )
                ),
            ),
        ).otherwise(
            F.concat(
                out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
            )
        ),
    )
    cut = F.concat(
        F.array_join(
            F.transform(
                "cuts",
                lambda c, i: F.concat(
                    F.substring(
                        F.col("text"),
                        (F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0)) + 1).cast("int"),
                        (c["start"] - F.coalesce(F.get("cuts", i - 1)["end"], F.lit(0))).cast("int"),
                    ),
                    F.lit("["),
                    c["kind"],
                    F.lit("]"),
                ),
            ),
            "",
        ),
        F.substring(
            F.col("text"), (F.element_at("cuts", -1)["end"] + 1).cast("int"), F.length("text")
        ),
    )
    dirty = (
        hits.join(spans.select("id", merged.alias("cuts")), "id")
        .withColumn("text", F.when(F.size("cuts") > 0, cut).otherwise(F.col("text")))
        .select(
            *[
                (F.col("text") if c == text_col else F.col("document").getField(c)).alias(c)
                for c in docs.columns
            ]
        )
    )
    return clean.unionByName(dirty)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = lambda kind: (
        F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    )
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    return scan_secrets(docs).select(
        "doc_id",
        *[counted(kind) for kind in BASE],
        F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP7_SQL = f"""
with t as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), p as (
  select r, 'assign' as kind, 0 as k, regexp_extract_all(text, {_quoted(ASSIGN)}) as m, regexp_split_to_array(text, {_quoted(ASSIGN)}) as g from t
  union all select r, 'access', 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') from t
  union all select r, 'hex', 2, regexp_extract_all(text, '[0-9a-f]+'), regexp_split_to_array(text, '[0-9a-f]+') from t
    where regexp_matches(text, '[0-9a-f]{{24}}')
  union all select r, 'token', 3, regexp_extract_all(text, '[A-Za-z0-9+/=_-]+'), regexp_split_to_array(text, '[A-Za-z0-9+/=_-]+') from t
    where contains(text, 'AKIA')
  union all select r, 'address', 4, regexp_extract_all(text, {_quoted(ADDRESS)}), regexp_split_to_array(text, {_quoted(ADDRESS)}) from t
    where contains(text, '://')
), u as (
  select r, kind, k, unnest(m) as m, unnest(g[1:len(m)]) as g, unnest(range(len(m))) as i from p
), s as (
  select r, kind, k, m, sum(length(m) + length(g)) over (partition by r, k order by i) as "end" from u
), q as (
  select r, kind, k, "end" - length(m) as start, "end" from s
  where case kind when 'assign' then length(regexp_extract(m, {_quoted(ASSIGN)}, 2)) >= 6
    when 'access' then length(m) >= 20 when 'hex' then length(m) >= 24
    when 'token' then regexp_full_match(m, '[A-Za-z0-9+/]{{40}}') else true end
), b as (
  select * from q where k < 3
), a as (
  select * from b
  union all
  select q.* from q where k >= 3
    and not exists (select 1 from b where b.r = q.r and b.start < q."end" and q.start < b."end")
    and exists (select 1 from b where b.r = q.r and (b.kind = 'access' or q.kind = 'address' and b.kind = 'assign')
      and (b.start between q."end" and q."end" + {SCOPE} or b."end" between q.start - {SCOPE} and q.start))
), l as (
  select r, count(*) filter (where k = 0) as n_assign, count(*) filter (where k = 1) as n_access,
    count(*) filter (where k = 2) as n_hex,
    string_agg(kind || ':' || start || ':' || "end", ',' order by start, k) filter (where k < 3) as base,
    string_agg(kind || ':' || start || ':' || "end", ',' order by start, k) as spans
  from a group by r
)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
  coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join l using (r)
"""
