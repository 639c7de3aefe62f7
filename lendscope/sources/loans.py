"""The loan table: its schema, and the ways to get a DataFrame that has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOANS_SCHEMA = T.StructType(
    [
        T.StructField("loan_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("product_type", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("loan_amount", T.DecimalType(18, 2)),
        T.StructField("interest_rate", T.DecimalType(5, 2)),
        T.StructField("tenure_months", T.IntegerType()),
        T.StructField("risk_score", T.IntegerType()),
        T.StructField("risk_tier", T.StringType()),
        T.StructField("days_past_due", T.IntegerType()),
        T.StructField("par_bucket", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("origination_date", T.DateType()),
        T.StructField("expected_loss", T.DecimalType(18, 2)),
        T.StructField("actual_loss", T.DecimalType(18, 2)),
    ]
)


#: Decimals that sums of money keep exactly.
MOST_DECIMALS = 6


def _conformed(df: DataFrame, field: T.StructField) -> Column:
    """One column in its type of the schema. No decimals are lost: a finer decimal column
    keeps its scale, and a value of another type that has more decimals ends the query."""
    column, own = F.col(field.name), df.schema[field.name].dataType
    if own == field.dataType:
        return column
    cast = column.cast(field.dataType)
    if isinstance(field.dataType, T.DecimalType):
        if isinstance(own, T.DecimalType):
            if own.scale > MOST_DECIMALS:
                raise ValueError(f"{field.name} has {own.scale} decimals; sums keep {MOST_DECIMALS}")
            if own.scale > field.dataType.scale:
                # As many digits before the point as the schema has, which keeps products exact.
                whole = field.dataType.precision - field.dataType.scale
                return column.cast(T.DecimalType(min(own.precision, whole + own.scale), own.scale)).alias(field.name)
        else:
            finer = F.raise_error(F.lit(f"{field.name} has values of more than {field.dataType.scale} decimals"))
            same = cast.cast("double") == column.cast("double")
            cast = F.when(column.isNull() | same, cast).otherwise(finer)
    return cast.alias(field.name)


def conform(df: DataFrame) -> DataFrame:
    """Select the loan columns out of `df` by name and cast them to `LOANS_SCHEMA`.

    Columns already of the right type are passed through without a cast, so that
    filters on them still reach the Parquet scan. Decimals are never rounded.
    """
    missing = [f.name for f in LOANS_SCHEMA if f.name not in df.columns]
    if missing:
        raise ValueError(f"loan table lacks columns: {', '.join(missing)}")
    return df.select(*(_conformed(df, f) for f in LOANS_SCHEMA))


def read_loans(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Loans stored as files (a file, a directory or a glob)."""
    return conform(spark.read.format(fmt).load(path))


def loans_table(spark: SparkSession, name: str) -> DataFrame:
    """Loans registered in a catalog, by one- to three-part table name."""
    return conform(spark.table(name))


def loans_from_orders(orders: DataFrame) -> DataFrame:
    """Derive a loan per order; FIXTURES.md section 1 lists the expressions."""
    tier_by_score = "case when risk_score < 640 then {0} when risk_score < 715 then {1} else {2} end"
    return (
        orders.selectExpr(
            "o_orderkey as loan_id",
            "o_custkey * 4 + o_orderkey % 4 as customer_id",
            "case o_orderpriority when '1-URGENT' then 'Personal' when '2-HIGH' then 'SME'"
            " when '3-MEDIUM' then 'Salary' else 'POS' end as product_type",
            "case o_orderkey % 3 when 0 then 'Agent' when 1 then 'Branch' else 'Online' end as channel",
            "cast(o_totalprice as decimal(18,2)) as loan_amount",
            "cast(cast(1000 + (o_orderkey * 37) % 2100 as decimal(10,0)) * 0.01 as decimal(5,2)) as interest_rate",
            "cast(6 * (1 + o_orderkey % 7) as int) as tenure_months",
            "cast(550 + (o_orderkey * 7919 + o_custkey * 31) % 251 as int) as risk_score",
            "(o_orderkey * 104729 + o_custkey * 1299709) % 997 as h",
            "o_orderstatus",
            "cast(o_orderdate as date) as origination_date",
        )
        .selectExpr(
            "*",
            tier_by_score.format("'Low'", "'Medium'", "'High'") + " as risk_tier",
            "cast(case when h < 508 then 0 when h < 868 then 1 + h % 30 when h < 928 then 31 + h % 30"
            " when h < 968 then 61 + h % 30 else 91 + h % 30 end as int) as days_past_due",
        )
        .selectExpr(
            "loan_id",
            "customer_id",
            "product_type",
            "channel",
            "loan_amount",
            "interest_rate",
            "tenure_months",
            "risk_score",
            "risk_tier",
            "days_past_due",
            "case when days_past_due = 0 then 'Current' when days_past_due <= 30 then 'PAR 1-30'"
            " when days_past_due <= 60 then 'PAR 31-60' when days_past_due <= 90 then 'PAR 61-90'"
            " else 'PAR 90+' end as par_bucket",
            "case when o_orderstatus = 'F' then 'Closed' when o_orderstatus = 'O' then 'Active'"
            " when days_past_due > 90 then 'Written Off' when days_past_due > 60 then 'Defaulted'"
            " else 'In Collection' end as status",
            "origination_date",
            f"cast(loan_amount * ({tier_by_score.format('0.002', '0.006', '0.012')}) as decimal(18,2)) as expected_loss",
            "cast(case when days_past_due > 60 then loan_amount * 0.100 else 0 end as decimal(18,2)) as actual_loss",
        )
    )


def load_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan table of a test-data directory, derived from its `orders` table."""
    return loans_from_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))
