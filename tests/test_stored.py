"""Tables stored by key: same rows, no exchange on the key, large keys apart."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators.skew import GroupSizes, measure
from riskloom.operators.staging import release_staged
from riskloom.plans import loan_book as lb
from riskloom.sources.schemas import BORROWERS, LOANS, REPAYMENTS
from riskloom.sources.stored import APART, store_by_key


@pytest.fixture(scope="module")
def book(spark):
    rng = random.Random(2)
    borrowers = [(f"B{i}", "N", 30, 5e5, 600 + i, rng.choice(["Salaried", "Business"]), "S", 1.0, 0) for i in range(9)]
    loans = [
        (f"L{i}", f"B{i % 9}", rng.choice(["Home", "Gold Loan"]), 100.0 + i, 50.0, 9.0, 12, 1.0, dt.date(2021, 1, 1), "Active")
        for i in range(40)
    ]
    payments = []
    for i in range(40):
        for k in range(400 if i == 7 else rng.randint(1, 9)):  # a loan with most of the payments
            day = dt.date(2020, 1, 1) + dt.timedelta(days=30 * k)
            payments.append((f"R{i}-{k}", f"L{i}", f"B{i % 9}", day, float(rng.randint(1, 10)), 10.0, rng.randint(0, 45), k + 1))
    return (
        spark.createDataFrame(loans, LOANS),
        spark.createDataFrame(borrowers, BORROWERS),
        spark.createDataFrame(payments, REPAYMENTS).repartition(5),
    )


def rows(df):
    return sorted(map(repr, df.collect()))


def exchanges(df) -> list[str]:
    """Exchanges by loan in the plan as it is run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return [x for x in re.findall(r"Exchange \w+\(([^)]*)", final) if x.startswith("loan_id")]


@pytest.mark.parametrize("hot_rows", [1_000_000, 50])
def test_reports_from_stored_tables(spark, book, hot_rows):
    loans, borrowers, payments = book
    stored = store_by_key(payments, "loan_id", ["payment_month"], buckets=4, hot_rows=hot_rows)
    book_rows = store_by_key(loans, "loan_id", buckets=4, sizes=GroupSizes()).rows
    assert (APART in stored.rows.columns) == (hot_rows == 50)
    assert rows(stored.rows.select(payments.columns)) == rows(payments)
    known = {"sizes": stored.sizes, "hot_rows": hot_rows}
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables too large to send
    try:
        pairs = [
            (
                lb.cumulative_collections(stored.rows, ordered=False, **known),
                lb.cumulative_collections(payments),
            ),
            (
                lb.late_streak_by_employment(stored.rows, borrowers, **known),
                lb.late_streak_by_employment(payments, borrowers),
            ),
            (lb.partial_payments(stored.rows, book_rows), lb.partial_payments(payments, loans)),
            (
                lb.early_defaults(stored.rows, book_rows, borrowers),
                lb.early_defaults(payments, loans, borrowers),
            ),
            (lb.rolling_collections(stored.rows, book_rows), lb.rolling_collections(payments, loans)),
        ]
        for got, want in pairs:
            assert got.columns == want.columns and rows(got) == rows(want)
        if hot_rows > 400:
            assert [exchanges(got) for got, _ in pairs] == [[]] * 5
            assert all(exchanges(want) for _, want in pairs)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_large_keys_do_not_touch_the_buckets(spark, book):
    """The window over the stored loans keeps their layout also where a loan is kept apart."""
    payments = book[2]
    stored = store_by_key(payments, "loan_id", ["payment_month"], buckets=4, hot_rows=50)
    assert stored.rows.where(APART).select("loan_id").distinct().collect() == [("L7",)]
    cold = stored.sizes.hot.cold(stored.rows)
    counted = cold.groupBy("loan_id").agg(F.count("*").alias("n"))
    assert exchanges(counted) == [] and counted.count() == 39
    assert stored.sizes.hot.hot(stored.rows).count() == 400


def test_stored_tables_of_nothing_and_null_keys(spark, book):
    payments = book[2]
    empty = store_by_key(payments.limit(0), "loan_id", ["payment_month"], buckets=2)
    assert empty.rows.count() == 0 and empty.sizes.hot is None
    some = payments.withColumn("loan_id", F.when(F.col("payment_month") > 3, F.col("loan_id")))
    stored = store_by_key(some, "loan_id", ["payment_month"], buckets=2, hot_rows=60)
    assert measure(some, ["loan_id"], 60).hot.count == 2  # the NULL key and one loan
    assert rows(stored.rows.select(some.columns)) == rows(some)
    assert stored.rows.where(f"not {APART} and loan_id is null").count() == 0


def test_names_go_with_the_files(spark, book):
    stored = store_by_key(book[0], "loan_id", buckets=2, sizes=GroupSizes(), label="gone")
    assert stored.rows.count() == 40
    assert any("_gone_" in t.name for t in spark.catalog.listTables())
    release_staged(spark)
    assert not any("_gone_" in t.name for t in spark.catalog.listTables())
