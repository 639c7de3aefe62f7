import os
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from lendscope import LOANS_SCHEMA

SMALL = "/root/testdata/sf0.001"
ORACLE_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("TZ", "UTC")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("lendscope-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # No call sites are kept for error messages, which halves the time to build plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DEFAULTS = {
    "loan_id": 1,
    "customer_id": 1,
    "product_type": "SME",
    "channel": "Online",
    "loan_amount": "1000.00",
    "interest_rate": "10.00",
    "tenure_months": 12,
    "risk_score": 650,
    "risk_tier": "Low",
    "days_past_due": 0,
    "par_bucket": "Current",
    "status": "Active",
    "origination_date": "2024-01-01",
    "expected_loss": "1.00",
    "actual_loss": "0.00",
}


@pytest.fixture(scope="session")
def make_loans(spark):
    """Build loans from partial rows; the rest is filled from DEFAULTS, ids counted up."""

    def build(*rows):
        full = [{**DEFAULTS, "loan_id": i + 1, **row} for i, row in enumerate(rows)]
        typed = [
            tuple(None if r[f.name] is None else _typed(r[f.name], f.dataType) for f in LOANS_SCHEMA)
            for r in full
        ]
        return spark.createDataFrame(typed, LOANS_SCHEMA)

    return build


def _typed(value, data_type):
    if isinstance(data_type, T.DecimalType):
        return Decimal(str(value))
    if isinstance(data_type, T.DateType) and isinstance(value, str):
        return date.fromisoformat(value)
    return value


def by(key, df):
    """Collected rows as dicts, by the value of one column."""
    return {row[key]: row.asDict() for row in df.collect()}
