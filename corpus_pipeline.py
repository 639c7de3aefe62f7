"""From raw documents to packed token sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored and read again
as the next one's docs. All but the last return the columns that came in.

Defined results: a null or empty text fails the quality rules and goes at the first stage; a null
id ranks behind all others where one document of a group stays, and is kept if its group has no
other; equal rows are copies, of which one stays; of equal ids that are no copies all stay; very
long texts are worked on whole; empty tables give an empty table, and an empty benchmark
contaminates nothing. More columns of documents, whatever their names, pass through all stages but
the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lendscope.llm import decontamination, jaccard_join, packing, quality_rules, secret_scan
from lendscope.llm.scratch import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule lets pass."""
    return quality_rules.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, the one with the least id."""
    return jaccard_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean_documents(docs, items)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kind."""
    return secret_scan.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences along the curve, as pieces of documents."""
    return packing.packed_digest(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_copies),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Edit distance over windows and range partitions of packing have no SQL of use here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
