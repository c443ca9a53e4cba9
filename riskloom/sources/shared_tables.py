"""Loan-book tables and price panels seen through the shared test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import OrderedRows
from ..operators.skew import HOT_ROWS, GroupSizes, lookup_join, measure


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def borrowers(spark: SparkSession, folder: str) -> DataFrame:
    c, n = table(spark, folder, "customer"), table(spark, folder, "nation")
    key = F.col("c_custkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        key.alias("customer_id"),
        F.col("c_name").alias("name"),
        (F.lit(21) + key % 45).cast("int").alias("age"),
        (F.lit(150000) + (key * 7919) % 1350000).cast("double").alias("annual_income"),
        F.floor(F.lit(300.0) + (F.col("c_acctbal") + 1000.0) * 600.0 / 11000.0)
        .cast("int")
        .alias("credit_score"),
        F.col("c_mktsegment").alias("employment_type"),
        F.col("n_name").alias("state"),
        (key % 5).cast("int").alias("existing_loans_count"),
    )


def loans(spark: SparkSession, folder: str) -> DataFrame:
    key, price, status = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    late = F.when(key % 3 == 0, "90+ DPD").when(key % 3 == 1, "30 DPD").otherwise("60 DPD")
    closed = F.when(key % 4 == 0, "Written-Off").when(key % 4 == 1, "NPA").otherwise("Active")
    return table(spark, folder, "orders").select(
        key.alias("loan_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("loan_purpose"),
        price.alias("loan_amount"),
        (price * (F.lit(0.2) + (key % 8) / F.lit(10.0))).alias("outstanding_balance"),
        (F.lit(6.0) + (key % 120) / F.lit(10.0)).alias("interest_rate"),
        F.lit(12).alias("tenure_months"),
        (price / F.lit(12.0)).alias("emi_amount"),
        F.col("o_orderdate").cast("date").alias("disbursal_date"),
        F.when(status == "O", "Active").when(status == "P", late).otherwise(closed).alias(
            "loan_status"
        ),
    )


PAYMENT_ORDER = [
    "l_shipdate",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
]


def repayments(
    spark: SparkSession,
    folder: str,
    *,
    numbered: bool = False,
    sizes: GroupSizes | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Payments per loan. ``numbered`` adds ``payment_month``, the payment's number in its loan.

    ``sizes`` are those of ``payment_sizes`` if the caller has measured them.
    """
    if sizes is None:
        sizes = payment_sizes(spark, folder, hot_rows)
    sizes = sizes.renamed({"loan_id": "l_orderkey"})
    lines = table(spark, folder, "lineitem").select("l_orderkey", *PAYMENT_ORDER, "l_discount")
    if numbered:
        ordered = OrderedRows(
            lines, ["l_orderkey"], PAYMENT_ORDER, hot_rows=hot_rows, sizes=sizes
        )
        lines = ordered.position("_number").rows()
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    due = F.col("l_extendedprice")
    columns = [
        F.concat_ws("-", "l_orderkey", *PAYMENT_ORDER).alias("repayment_id"),
        F.col("l_orderkey").alias("loan_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_shipdate").cast("date").alias("payment_date"),
        (due * (F.lit(1.0) - F.col("l_discount"))).alias("amount_paid"),
        due.alias("emi_due"),
        F.greatest(
            F.lit(0),
            F.date_diff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")),
        ).alias("days_late"),
    ]
    if numbered:
        columns.append(F.col("_number").cast("int").alias("payment_month"))
    on = {"l_orderkey": "o_orderkey"}
    return lookup_join(lines, o, on, sizes=sizes).select(*columns)


def payment_sizes(spark: SparkSession, folder: str, hot_rows: int = HOT_ROWS) -> GroupSizes:
    """Loans with very many payments, counted from the key column alone."""
    keys = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("loan_id"))
    return measure(keys, ["loan_id"], hot_rows)


def event_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly activity per event type; ``date`` is the hour."""
    # date_trunc would pass through the session's zone and shift hours at its clock changes
    hour = F.expr(
        "CAST(ts AS timestamp_ntz)"
        " - make_dt_interval(0, 0, extract(MINUTE FROM ts), extract(SECOND FROM ts))"
    )
    return (
        table(spark, folder, "events")
        .groupBy(hour.alias("date"), F.col("event_type").alias("symbol"))
        .agg(F.sum("value").alias("price"))
    )


def order_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly order value per nation (``N00`` to ``N24``); ``date`` is the Monday of the week."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    week = F.date_trunc("week", F.col("o_orderdate")).cast("date")
    # a customer's week is summed before the join, so a busy customer joins as a few rows
    weekly = o.groupBy("o_custkey", week.alias("date")).agg(F.sum("o_totalprice").alias("_sum"))
    symbol = F.format_string("N%02d", F.col("c_nationkey"))
    return (
        weekly.join(c, weekly.o_custkey == c.c_custkey)
        .groupBy("date", symbol.alias("symbol"))
        .agg(F.sum("_sum").alias("price"))
    )
