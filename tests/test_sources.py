import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.operators import staging
from riskloom.sources import files, schemas
from riskloom.sources import shared_tables as src

SMALL = "/root/testdata/sf0.001"


def test_csv_round_trip(spark, tmp_path):
    rows = [("R1", "L1", "C1", dt.date(2020, 1, 2), 1.5, None, 3, 1)]
    df = spark.createDataFrame(rows, schemas.REPAYMENTS)
    files.write_csv(df, str(tmp_path / "repayments.csv"), single_file=True)
    back = files.read_csv(spark, str(tmp_path / "repayments.csv"), schemas.REPAYMENTS)
    assert back.collect() == df.collect()
    assert len(list((tmp_path / "repayments.csv").glob("part-*.csv"))) == 1


def test_malformed_csv_is_an_error(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_text("date,symbol,price\n2020-01-01,a,not a number\n")
    with pytest.raises(Exception, match="MALFORMED|not a number"):
        files.read_csv(spark, str(path), schemas.PRICES).collect()


def test_loan_book_folder(spark, tmp_path):
    for name, schema in (
        ("borrowers", schemas.BORROWERS),
        ("loans", schemas.LOANS),
        ("repayments", schemas.REPAYMENTS),
    ):
        empty = spark.createDataFrame([], schema)
        files.write_csv(empty, str(tmp_path / f"{name}.csv"))
        empty.write.parquet(str(tmp_path / f"{name}.parquet"))
    for fmt in ("csv", "parquet"):
        tables = files.read_loan_book(spark, str(tmp_path), fmt)
        assert [t.columns for t in tables] == [
            s.names for s in (schemas.BORROWERS, schemas.LOANS, schemas.REPAYMENTS)
        ]


def test_assert_schema(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "a", 1.0)], schemas.PRICES)
    assert schemas.assert_schema(df, schemas.PRICES) is df
    with pytest.raises(ValueError, match="price"):
        schemas.assert_schema(df.drop("price"), schemas.PRICES)
    with pytest.raises(ValueError, match="price"):
        schemas.assert_schema(df.withColumn("price", F.lit("x")), schemas.PRICES)
    text = df.withColumn("price", F.lit("x"))
    assert schemas.assert_schema(text, schemas.PRICES, types=False) is text


def test_result_set(spark, tmp_path):
    tables = {"metrics": spark.range(3), "curves": spark.range(5)}
    files.write_result_set(tables, str(tmp_path / "run"))
    back = files.read_result_set(spark, str(tmp_path / "run"), ["metrics", "curves"])
    assert back["curves"].count() == 5


def test_shared_table_distributions(spark):
    """Counts that were established independently when the mapping was designed."""
    status = src.loans(spark, SMALL).groupBy("loan_status").count().collect()
    assert {r.loan_status: r["count"] for r in status} == {
        "Active": 773,
        "30 DPD": 158,
        "60 DPD": 178,
        "90+ DPD": 157,
        "NPA": 119,
        "Written-Off": 115,
    }
    assert src.borrowers(spark, SMALL).count() == 150
    payments = src.repayments(spark, SMALL, numbered=True)
    assert payments.count() == 6000
    assert payments.select("repayment_id").distinct().count() == 6000
    first = payments.where("days_late > 30").groupBy("loan_id").agg(F.min("payment_month").alias("m"))
    timing = {r.m: r["count"] for r in first.groupBy("m").count().collect()}
    assert [timing[i] for i in (1, 2, 3, 4)] == [347, 308, 211, 153]


def test_numbering_is_the_same_when_split(spark):
    plain = src.repayments(spark, SMALL, numbered=True)
    split = src.repayments(spark, SMALL, numbered=True, hot_rows=6)
    assert split.exceptAll(plain).count() == 0 and split.count() == plain.count()


def test_staging_root_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = staging.staging_root(spark)
    assert root == named if named else root
    staged = staging.stage(spark.range(4), "test")
    assert staged.count() == 4 and staged.inputFiles()[0].split("://")[-1].startswith(
        "/" + root.split("://")[-1].strip("/")
    )


def test_hours_do_not_follow_the_session_zone(spark, tmp_path):
    from riskloom.sources.shared_tables import event_prices

    rows = "VALUES (TIMESTAMP_NTZ '2021-03-14 02:30:15.25', 'a', 1.0), (TIMESTAMP_NTZ '2021-03-14 03:10:00', 'a', 2.0)"
    spark.sql(f"SELECT * FROM {rows} AS t(ts, event_type, value)").write.parquet(f"{tmp_path}/events.parquet")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        found = sorted(str(r.date) for r in event_prices(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == ["2021-03-14 02:00:00", "2021-03-14 03:00:00"]
