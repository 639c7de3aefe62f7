"""URL filter: rules by host and path, then a blocked Bloom filter before an exact join.

A list of bad URLs, of any length, is canonicalised and hashed into a blocked Bloom filter:
each URL sets one bit in each of the eight longs of one 512-bit block. The filter has a
fixed largest size (`max_blocks`), which is what makes its broadcast safe; a longer list
only makes it pass more. Pages that it passes go through an exact join on the canonical URL,
which removes its false positives; all others are never shuffled.

Defined results: a url that is null or has no `://` has empty host and path, fits no rule
and no list entry, and is allowed; repeated pages are judged one by one; an empty list
blocks nothing; columns of the input other than the id and url are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.native_text import lower_ascii

LONGS = 8
BITS_PER_URL = 16

#: Sixteen MB of filter, which holds eight million URLs at BITS_PER_URL.
MAX_BLOCKS = 1 << 18


class Rule(NamedTuple):
    """Fits `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


#: The rules of the registered query, given.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

#: Hosts whose pages make up the list of the registered query.
LISTED_HOSTS = r"casino|bets|ads-track|xxx|adult"


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.`, path without a last slash, sorted query without utm_ keys; null
    without `://`. Scheme and fragment do not count."""
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(
        F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&"
    )
    return F.when(
        F.instr(url, "://") > 0,
        F.concat(
            F.regexp_replace(host(url), r"^www\.", ""),
            F.regexp_replace(path(url), "/$", ""),
            F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""),
        ),
    )


def rule_of(rules: Sequence[Rule], page_host: Column, page_path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = (page_host == rule.host) | page_host.endswith(f".{rule.host}")
        chosen = F.when(
            fits & page_path.startswith(rule.path),
            F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict")),
        ).otherwise(chosen)
    return chosen


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, i: int) -> Column:
    """The bit of a URL in long `i` of its block: six bits of a second hash."""
    six = F.shiftright(F.xxhash64(key, F.lit("bits")), 6 * i).bitwiseAND(F.lit(63))
    return F.call_function("shiftleft", F.lit(1).cast("long"), six.cast("int"))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """One row for each block in use: block, w0 .. w7. `listed` has the column `canonical`."""
    return listed.groupBy(_block(F.col("canonical"), blocks).alias("block")).agg(
        *[F.bit_or(_bit(F.col("canonical"), i)).alias(f"w{i}") for i in range(LONGS)]
    )


def blocks_for(urls: int, max_blocks: int = MAX_BLOCKS) -> int:
    """A power of two of blocks that gives each URL its bits, up to the largest size."""
    wanted = max(1, urls * BITS_PER_URL // (64 * LONGS))
    return min(max_blocks, 1 << (wanted - 1).bit_length())


def url_filter(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """Judge each page: id, host, path, rule, verdict, listed (in the list: true, false, or
    null where a rule has decided).

    `listed` has a column `url`. A rule's verdict goes before the list's.
    """
    entries = (
        listed.select(canonical(F.col("url")).alias("canonical")).filter("canonical is not null").distinct()
    )
    blocks = blocks_for(entries.count(), max_blocks)
    url = F.col(f"`{url_col}`")
    judged = pages.select(
        F.col(f"`{id_col}`").alias(id_col),
        host(url).alias("host"),
        path(url).alias("path"),
        canonical(url).alias("canonical"),
    ).withColumn("ruling", rule_of(rules, F.col("host"), F.col("path")))
    ruled = judged.filter("ruling is not null").select(
        id_col, "host", "path", "ruling.rule", "ruling.verdict", F.lit(None).cast("boolean").alias("listed")
    )
    # At most max_blocks rows of 72 bytes, however long the list: safe to broadcast.
    filters = F.broadcast(bloom(entries, blocks))
    probed = (
        judged.filter("ruling is null")
        .withColumn("block", _block(F.col("canonical"), blocks))
        .join(filters, "block", "left")
    )
    hits = F.lit(True)
    for i in range(LONGS):
        bit = _bit(F.col("canonical"), i)
        hits = hits & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    probed = probed.select(
        id_col, "host", "path", "canonical",
        F.coalesce(hits & F.col("canonical").isNotNull(), F.lit(False)).alias("possible"),
    )
    no_rule = F.lit(None).cast("string").alias("rule")
    passed = probed.filter("not possible").select(
        id_col, "host", "path", no_rule, F.lit("allow").alias("verdict"), F.lit(False).alias("listed")
    )
    exact = (
        probed.filter("possible")
        .join(entries.withColumn("listed", F.lit(True)), "canonical", "left")
        .select(
            id_col, "host", "path", no_rule,
            F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"),
            F.coalesce("listed", F.lit(False)).alias("listed"),
        )
    )
    return ruled.unionByName(passed).unionByName(exact)


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """The list: URLs of pages on gambling, adult and ad hosts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, pages.filter(host(F.col("url")).rlike(LISTED_HOSTS)).select("url"))


OP2_SQL = r"""
with p as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path,
    coalesce(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '') as query
  from pages
), c as (
  select page_id, host, path,
    case when contains(url, '://') then regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '')
      || case when len(k) > 0 then '?' || array_to_string(k, '&') else '' end end as canonical
  from (select *, list_sort(list_filter(string_split(query, '&'),
    lambda x: x <> '' and not starts_with(x, 'utm_'))) as k from p)
), listed as (
  select distinct canonical from c where regexp_matches(host, 'casino|bets|ads-track|xxx|adult')
), fits as (
  select c.page_id, c.host, c.path, c.canonical, r.rule, r.verdict,
    row_number() over (partition by c.page_id order by length(r.rule) desc) as k
  from c left join (values ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
    ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'),
    ('com', '/de/', 'com/de/', 'block')) r(h, start, rule, verdict)
  on (c.host = r.h or ends_with(c.host, '.' || r.h)) and starts_with(c.path, r.start)
)
select page_id, host, path, rule,
  coalesce(verdict, case when l.canonical is not null then 'block' else 'allow' end) as verdict,
  case when verdict is null then l.canonical is not null end as listed
from fits left join listed l on fits.canonical = l.canonical where k = 1
"""
