from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.functions import expr as e
from riskloom.plans.loan_book import debt_to_income, risk_segment


def values(df, column="out"):
    return [r[column] for r in df.collect()]


def test_score_band_edges(spark):
    scores = [499.0, 500.0, 599.0, 599.5, 600.0, 749.0, 750.0, None]
    df = spark.createDataFrame([(s,) for s in scores], "s double").coalesce(1)
    got = values(df.select(e.closed_band("s", fv.SCORE_BANDS, fv.SCORE_BAND_DEFAULT).alias("out")))
    assert got == [
        "300-499 (Poor)",
        "500-599 (Fair)",
        "500-599 (Fair)",
        "750+ (Excellent)",  # between two whole-number ranges
        "600-699 (Good)",
        "700-749 (Very Good)",
        "750+ (Excellent)",
        "750+ (Excellent)",
    ]


def test_null_label_and_inclusive(spark):
    df = spark.createDataFrame([(None,), (6,), (7,)], "v int").coalesce(1)
    cuts = [(6, "early")]
    assert values(df.select(e.band("v", cuts, "late", inclusive=True).alias("out"))) == [
        "late",
        "early",
        "late",
    ]
    assert values(df.select(e.band("v", cuts, "late", null_label="none").alias("out"))) == [
        "none",
        "late",
        "late",
    ]
    assert values(
        df.select(e.closed_band("v", [(None, 6, "a")], "b", null_label="?").alias("out"))
    ) == ["?", "a", "b"]


def test_segment_null_falls_to_last(spark):
    rows = [(720, 8e5), (720, 7e5), (550, 2e5), (None, 9e9), (800, None)]
    df = spark.createDataFrame(rows, "credit_score int, annual_income double").coalesce(1)
    got = [v[:2] for v in values(df.select(risk_segment().alias("out")))]
    assert got == ["P1", "P2", "P3", "P4", "P4"]


def test_zero_income_is_last_dti_band(spark):
    rows = [(100.0, 0.0), (100.0, None), (100.0, 6001.0), (100.0, 6000.0), (100.0, 2400.0)]
    df = spark.createDataFrame(rows, "emi_amount double, annual_income double").coalesce(1)
    got = values(df.select(e.band(debt_to_income(), fv.DTI_BANDS, "last").alias("out")))
    assert got == ["last", "last", "< 20% (Low Risk)", "20-35% (Moderate)", "last"]


def test_rates(spark):
    df = spark.createDataFrame([(True, 0.0), (False, 0.0), (None, 0.0)], "hit boolean, v double")
    row = df.agg(
        e.count_if(F.col("hit")).alias("n"),
        e.rate_pct(F.col("hit")).alias("rate"),
        e.value_rate_pct(F.col("hit"), "v").alias("value_rate"),
    ).first()
    assert (row.n, row.rate, row.value_rate) == (1, 33.33, None)


def test_scaled_and_maps(spark):
    df = spark.createDataFrame([("60 DPD", 12345678.9)], "s string, v double")
    row = df.select(
        e.scaled("v", fv.CRORE).alias("cr"),
        e.scaled("v", fv.LAKH, 1).alias("lakh"),
        e.order_rank("s", fv.STATUS_ORDER).alias("place"),
        e.order_rank(F.lit("other"), fv.STATUS_ORDER).alias("none"),
        e.clean_label(F.lit("ab_cd_ret")).alias("label"),
        e.month_of(F.lit("2020-03-04").cast("date")).alias("month"),
        e.month_start(F.lit("2020-03-04").cast("date")).cast("string").alias("first"),
    ).first()
    assert row.asDict() == {
        "cr": 1.23,
        "lakh": 123.5,
        "place": 3,
        "none": None,
        "label": "ab cd",
        "month": "2020-03",
        "first": "2020-03-01",
    }


def test_weighted_mean_skips_null(spark):
    df = spark.createDataFrame([(10.0, 3), (None, 5), (20.0, 1)], "v double, n int")
    assert df.agg(e.weighted_mean("v", "n").alias("m")).first().m == 12.5
