"""Whole studies from CSV files."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from riskloom import jobs
from riskloom.plans import models as ml
from riskloom.sources import files, schemas
from riskloom.sources import shared_tables as src

SMALL = "/root/testdata/sf0.001"


def test_loan_reports_from_csv(spark, tmp_path):
    """The shared tables as CSV files of the documented shape, then all 23 reports."""
    tables = {
        "borrowers": (src.borrowers(spark, SMALL), schemas.BORROWERS),
        "loans": (src.loans(spark, SMALL), schemas.LOANS),
        "repayments": (src.repayments(spark, SMALL, numbered=True), schemas.REPAYMENTS),
    }
    for name, (df, schema) in tables.items():
        columns = [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
        files.write_csv(df.select(*columns), str(tmp_path / f"{name}.csv"))
    borrowers, loans, repayments = files.read_loan_book(spark, str(tmp_path))
    reports = jobs.loan_reports(loans, borrowers, repayments)
    assert len(reports) == 23
    rows = {name: df.count() for name, df in reports.items()}
    assert rows["portfolio_summary"] == 1 and rows["cumulative_collections"] == 6000
    assert rows["top_exposures"] == 20 and rows["exposure_ranking"] == 50
    assert rows["watchlist"] == 30 and rows["collection_trend"] == 0  # other years


def test_signal_study(spark):
    """A supplier that leads the target by one week is found and traded at a profit."""
    rng = np.random.default_rng(3)
    n = 160
    lead = rng.normal(0, 0.02, n)
    target = np.concatenate([[0.0], lead[:-1]]) + rng.normal(0, 0.004, n)
    series = {"T": target, "S1": lead, "S2": rng.normal(0, 0.02, n)}
    rows = []
    for symbol, r in series.items():
        for i, p in enumerate(100 * np.exp(np.cumsum(r))):
            rows.append((dt.date(2015, 1, 4) + dt.timedelta(days=7 * i), symbol, float(p)))
    prices = spark.createDataFrame(rows, schemas.PRICES).repartition(4)
    tables, fit = jobs.signal_study(prices, "T", ["S1", "S2"], models=[ml.ELASTIC_NET, ml.TREE])
    summary = {r.Model: r for r in tables["summary"].collect()}
    assert tables["summary"].columns == schemas.SUMMARY_COLUMNS
    best = summary[ml.ELASTIC_NET]
    assert best.DirAcc > 0.8 and best.R2 > 0.6 and best.Sharpe > 3 and best.CumReturn > 0
    assert tables["top_coefficients"].orderBy(F.desc("coef")).first().feature == "S1_ret"
    assert tables["curves"].count() == 2 * 37  # 147 complete rows, 110 of them for training
    assert tables["comparison"].where("is_best").count() == 4
    assert len(fit.features) == 8
