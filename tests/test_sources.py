import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from lendscope import LOANS_SCHEMA, load_loans, loans_table, read_loans
from tests.conftest import SMALL


def test_derived_loans_have_the_schema(spark):
    loans = load_loans(spark, SMALL)
    assert [(f.name, f.dataType) for f in loans.select(LOANS_SCHEMA.names).schema] == [
        (f.name, f.dataType) for f in LOANS_SCHEMA
    ]
    assert loans.count() == 1500


def test_stored_loans_are_read_back_and_cast(spark, tmp_path):
    loans = load_loans(spark, SMALL)
    loose = loans.withColumn("loan_amount", F.col("loan_amount").cast("double")).withColumn("extra", F.lit(1))
    for fmt in ("parquet", "orc"):
        path = str(tmp_path / fmt)
        loose.write.format(fmt).save(path)
        back = read_loans(spark, path, fmt)
        assert back.schema.names == LOANS_SCHEMA.names
        assert back.exceptAll(loans.select(LOANS_SCHEMA.names)).count() == 0


def test_catalog_tables(spark):
    load_loans(spark, SMALL).createOrReplaceTempView("book")
    assert loans_table(spark, "book").count() == 1500


def test_a_missing_column_is_named(spark, tmp_path):
    path = str(tmp_path / "short")
    load_loans(spark, SMALL).drop("status").write.parquet(path)
    with pytest.raises(ValueError, match="status"):
        read_loans(spark, path)


def test_driver_contract(spark):
    # Every loan query has SQL; of the others, those that SQL can express.
    assert set(contract.CATALOG) <= set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 6
    one = contract.queries()["op_having"](spark, SMALL)
    assert one.columns == ["customer_id", "number_of_loans"]
