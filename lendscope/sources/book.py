"""A loan book stored by customer, so that customer aggregates and joins need no shuffle.

Loans of ordinary customers are a table bucketed and sorted by `customer_id`. A bucket is read
by one task, so customers with very many loans do not belong there: theirs are a second table,
dealt evenly, whose aggregates combine on the map side. No customer is in both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lendscope.operators.skew import HOT_ROWS, split_hot
from lendscope.sources.loans import loans_table


@dataclass(frozen=True)
class BucketedBook:
    """Customer views take it in place of a loan table."""

    ordinary: DataFrame
    hot: DataFrame

    def loans(self) -> DataFrame:
        """All loans as one table, without regard to how they are stored."""
        return self.ordinary.unionByName(self.hot)

    def by_customer(self, work) -> DataFrame:
        """What `work` makes of the loans, if it makes it of each customer's loans alone."""
        return work(self.ordinary).unionByName(work(self.hot))

    def join_customers(self, work) -> DataFrame:
        """Loans joined with what `work` makes of each customer's loans: side by side where
        they lie for ordinary customers, by broadcast for the few that are hot."""
        ordinary = self.ordinary.join(work(self.ordinary).hint("merge"), "customer_id")
        return ordinary.unionByName(self.hot.join(work(self.hot).hint("broadcast"), "customer_id"))


def write_book(
    loans: DataFrame, name: str, buckets: int, hot_rows: int = HOT_ROWS, path: str | None = None
) -> None:
    """Store `loans` as the tables `name` and `name`_hot of the session's catalog.

    A bucket should hold some 100 to 200 MB. Customers with more than `hot_rows` loans are hot;
    there are at most loans / hot_rows of them. `path` is where the files go, in two folders;
    without it they go where the catalog puts them.
    """
    ordinary, hot = split_hot(loans, hot_rows)
    # One task writes one bucket as one file, in order.
    writer = ordinary.repartition(buckets, "customer_id").write.format("parquet")
    writer = writer.bucketBy(buckets, "customer_id").sortBy("customer_id")
    hot_writer = hot.drop("slices").write.format("parquet")
    if path is not None:
        writer = writer.option("path", f"{path}/ordinary")
        hot_writer = hot_writer.option("path", f"{path}/hot")
    writer.saveAsTable(name)
    hot_writer.saveAsTable(f"{name}_hot")


def read_book(spark: SparkSession, name: str) -> BucketedBook:
    return BucketedBook(loans_table(spark, name), loans_table(spark, f"{name}_hot"))
