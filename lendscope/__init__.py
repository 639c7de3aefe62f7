"""Credit-portfolio and customer analytics over a loan table, as Spark DataFrames."""

from lendscope.sources.loans import LOANS_SCHEMA, load_loans, loans_table, read_loans

__all__ = ["LOANS_SCHEMA", "load_loans", "loans_table", "read_loans"]
