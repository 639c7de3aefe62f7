"""Sharding by longest processing time: equal texts stay together, shards get near equal bytes.

Scheduling longest-first needs one ordered list of groups, which no single process can hold
at scale. Only groups above a fixed fraction (1 / (shards * grain)) of all bytes can unbalance
a shard noticeably, and there are fewer than shards * grain of those: each goes to the heap by
itself. All smaller ones are gathered into shards * grain bundles, which go through the same
heap by falling size. What the heap sees is bounded by `grain`, not by the data.

Defined results: a null text counts as empty (size 1, crc32 0) and is grouped with empty
texts; repeated rows are placed one by one, in the shard of their group; a null id is carried
on; an empty table gives an empty table. A group larger than a shard's share makes that
shard larger; it is not cut, since its texts must stay together. Other columns are not carried.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.scratch import stored

#: Bundles for each shard: a bundle has about 1/GRAIN of a shard's share.
GRAIN = 1000

#: Rows that are numbered in one window, and of one text that a shuffle may bring together.
SLICE_ROWS = 250_000


def place(sizes: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """Longest processing time: (size, name) by falling size, each to the least-loaded shard."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for size, name in sorted(sizes, key=lambda entry: (-entry[0], entry[1])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    grain: int = GRAIN,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """id, size (bytes + 1), text_crc32, shard, and slot: gapless from 0 within the shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # Written once, so that every later step sees the same row numbers.
    rows = stored(
        docs.select(
            F.col(f"`{id_col}`").alias(id_col),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("text_key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    groups = stored(
        rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")),
        "shard-groups",
    )
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    bundles = shards * grain
    members = groups.withColumn(
        "bundle",
        F.when(F.col("bytes") * F.lit(bundles) > F.lit(total), F.hex("text_key")).otherwise(
            F.pmod(F.xxhash64("text_key"), F.lit(bundles)).cast("string")
        ),
    )

    # At most `bundles` large groups, since each has more than 1/bundles of all bytes, and as
    # many bundles.
    entries = members.groupBy("bundle").agg(F.sum("bytes").alias("bytes")).collect()
    placed = place([(entry.bytes, entry.bundle) for entry in entries], shards)
    shard_of = spark.createDataFrame(list(placed.items()), "bundle string, shard int")
    placed_groups = members.join(F.broadcast(shard_of), "bundle")

    # One text may hold a third of all rows: texts of so many rows, of which there are at most
    # count / slice_rows, meet their rows by broadcast, the others by a shuffle.
    many = F.broadcast(
        placed_groups.filter(F.col("rows") > slice_rows).select("text_key", "shard")
    )
    few = placed_groups.filter(F.col("rows") <= slice_rows).select("text_key", "shard")
    slices = max(1, -(-count // (shards * slice_rows)))
    placed_rows = stored(
        rows.join(many, "text_key")
        .unionByName(rows.join(many, "text_key", "left_anti").join(few, "text_key"))
        .withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))
        .select(id_col, "size", "text_crc32", "shard", "slice", "row"),
        "shard-placed",
    )
    by_slice = placed_rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("rows"))
    starts = by_slice.select(
        "shard", "slice",
        (
            F.sum("rows").over(Window.partitionBy("shard").orderBy("slice")) - F.col("rows")
        ).alias("start"),
    )
    numbered = placed_rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy("shard", "slice").orderBy("row"))
    )
    return numbered.join(starts, ["shard", "slice"]).select(
        id_col, "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot")
    )


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
