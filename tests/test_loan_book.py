"""Hand-written books, expected values worked by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskloom import fixed_values as fv
from riskloom.operators.skew import measure
from riskloom.plans import loan_book as lb
from riskloom.sources.schemas import BORROWERS, LOANS, REPAYMENTS


def borrower(cid, score=700, income=600000.0, age=35, name="N", state="S", emp="Salaried", n=0):
    return (cid, name, age, income, score, emp, state, 1.0, n)


def loan(lid, cid, purpose="Home", amount=100.0, balance=50.0, status="Active", emi=1.0, day=None):
    return (lid, cid, purpose, amount, balance, 10.0, 12, emi, day or dt.date(2021, 1, 5), status)


def payment(rid, lid, cid, number, paid=10.0, due=10.0, late=0, day=None):
    return (rid, lid, cid, day or dt.date(2021, number, 1), paid, due, late, number)


@pytest.fixture(scope="module")
def book(spark):
    borrowers = [
        borrower("B1", 720, 800000.0, 29, "Ann", "X", "Salaried", 2),
        borrower("B2", 549, 300000.0, 30, "Bob", "Y", "Business", 2),
        borrower("B3", 619, 0.0, None, "Bob", "Y", "Business", 1),
        borrower("B4", 649, 500000.0, 55, "Dee", "X", "Salaried", 0),
        borrower("B9", 800, 900000.0, 40, "Zed", "Z", "Other", 0),  # no loan
    ]
    loans = [
        loan("L1", "B1", "Home", 1e7, 1e7, "Active", 1e4, dt.date(2020, 1, 31)),
        loan("L2", "B1", "Personal Loan", 2e7, 0.0, "NPA", 2e4, dt.date(2020, 3, 1)),
        loan("L3", "B2", "Home", 3e7, 2e7, "30 DPD", 5e3, dt.date(2020, 3, 15)),
        loan("L4", "B3", "Home", 1e7, 1e7, "60 DPD", 5e3, dt.date(2021, 6, 1)),
        loan("L5", "B4", "Gold Loan", 3e7, 0.0, "Written-Off", 5e3, dt.date(2021, 6, 30)),
        loan("L6", "B4", "Home", 5e6, 6e7, "30 DPD", 5e3, dt.date(2021, 6, 2)),
        loan("L7", "B7", "Home", 9e9, 9e9, "NPA"),  # borrower unknown
    ]
    repayments = [
        payment("R1", "L1", "B1", 1, 10.0, 10.0, 1),
        payment("R2", "L1", "B1", 2, 9.4, 10.0, 40),
        payment("R3", "L1", "B1", 3, 12.0, 10.0, 2),
        payment("R4", "L1", "B1", 4, 9.5, 10.0, 0),
        payment("R5", "L3", "B2", 1, 5.0, 10.0, 31),
        payment("R6", "L3", "B2", 2, 5.0, 10.0, 30),
        payment("R7", "L4", "B3", 1, 1.0, 10.0, 0),
        payment("R8", "L4", "B3", 3, 2.0, 10.0, 0, dt.date(2024, 1, 1)),
    ]
    return (
        spark.createDataFrame(loans, LOANS),
        spark.createDataFrame(borrowers, BORROWERS),
        spark.createDataFrame(repayments, REPAYMENTS),
    )


def rows(df):
    return [r.asDict() for r in df.collect()]


def column(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_summary_drops_loans_without_borrower(book):
    loans, borrowers, _ = book
    got = rows(lb.portfolio_summary(loans, borrowers))[0]
    assert got["total_loans"] == 6 and got["unique_borrowers"] == 4
    assert got["total_disbursed_cr"] == 10.5
    assert got["avg_credit_score"] == round((720 * 2 + 549 + 619 + 649 * 2) / 6, 1)


def test_breakdowns(book):
    loans, _, _ = book
    by_purpose = lb.breakdown_by_purpose(loans)
    assert sum(column(by_purpose, "loan_purpose", "loan_count").values()) == 7
    assert column(by_purpose, "loan_purpose", "pct_of_portfolio")["Home"] == 71.4
    statuses = [r["loan_status"] for r in rows(lb.breakdown_by_status(loans))]
    assert statuses == ["Active", "30 DPD", "60 DPD", "NPA", "Written-Off"]


def test_unknown_status_comes_first(spark):
    loans = spark.createDataFrame(
        [loan("1", "B"), loan("2", "B", status="Odd"), loan("3", "B", status="NPA")], LOANS
    )
    got = [r["loan_status"] for r in rows(lb.breakdown_by_status(loans))]
    assert got == ["Odd", "Active", "NPA"]


def test_npa_rates(book):
    loans, _, _ = book
    got = {r["loan_purpose"]: r for r in rows(lb.npa_by_purpose(loans))}
    assert got["Home"]["npa_count"] == 1 and got["Home"]["gross_npa_pct"] == 20.0
    assert got["Personal Loan"]["gross_npa_pct"] == 100.0
    assert got["Personal Loan"]["npa_by_value_pct"] is None  # nothing outstanding
    matrix = {r["loan_purpose"]: r for r in rows(lb.status_matrix(loans))}
    assert matrix["Home"] == {
        "loan_purpose": "Home",
        "active": 1,
        "dpd_30": 2,
        "dpd_60": 1,
        "dpd_90_plus": 0,
        "npa": 1,
        "written_off": 0,
    }


def test_bands_and_segments(book):
    loans, borrowers, _ = book
    assert column(lb.npa_by_score_band(loans, borrowers), "credit_band", "loans") == {
        "500-599 (Fair)": 1,
        "600-699 (Good)": 3,
        "700-749 (Very Good)": 2,
    }
    assert column(lb.segment_report(loans, borrowers), "risk_segment", "borrowers") == {
        "P1 - Prime": 2,
        "P3 - Sub-Prime": 2,
        "P4 - Deep Sub-Prime": 2,
    }
    dti = column(lb.dti_report(loans, borrowers), "dti_band", "loan_count")
    # 0.15, 0.3, 0.2, unknown, 0.12, 0.12
    assert dti == {"< 20% (Low Risk)": 3, "20-35% (Moderate)": 2, "> 50% (Very High)": 1}
    ages = column(lb.npa_by_age_group(loans, borrowers), "age_group", "loans")
    assert ages == {"< 30": 2, "30-39": 1, "50+": 3}


def test_collection_trend_closed_range(book):
    _, _, repayments = book
    got = rows(lb.collection_trend(repayments, "2021-02-01", "2021-04-01"))
    assert [r["month"] for r in got] == ["2021-02", "2021-03", "2021-04"]
    assert got[0]["payments_made"] == 2 and got[0]["late_payments"] == 2
    assert got[0]["collection_efficiency_pct"] == 72.0
    assert len(rows(lb.collection_trend(repayments))) == 4  # 2024 is outside the default range


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_cumulative_and_partial_frames(book, hot_rows):
    _, _, repayments = book
    got = rows(lb.cumulative_collections(repayments, ["L1"], hot_rows=hot_rows))
    assert [round(r["cumulative_collected"], 6) for r in got] == [10.0, 19.4, 31.4, 40.9]
    assert [round(r["rolling_3m_avg_payment"], 6) for r in got] == [10.0, 9.7, 10.466667, 10.3]
    assert len(rows(lb.cumulative_collections(repayments, hot_rows=hot_rows))) == 8


@pytest.mark.parametrize("hot_rows", [1, 1000])
def test_late_streak(book, hot_rows):
    _, borrowers, repayments = book
    got = {
        r["employment_type"]: r
        for r in rows(lb.late_streak_by_employment(repayments, borrowers, hot_rows=hot_rows))
    }
    assert got["Salaried"]["loans_with_consec_late"] == 1
    assert got["Business"] == {
        "employment_type": "Business",
        "total_loans": 2,
        "loans_with_consec_late": 0,
        "pct_with_consec_late": 0.0,
    }


def test_partial_payments(book):
    loans, _, repayments = book
    got = rows(lb.partial_payments(repayments, loans))[0]
    assert got["total_payments"] == 8
    assert got["partial_payments"] == 5  # 9.5 of 10 is inside the tolerance
    # shortfalls 0.6 + 0.5 + 5 + 5 + 9 + 8, the overpayment counts as 0
    assert got["total_shortfall_lacs"] == round(28.1 / 1e5, 2)


def test_partial_payments_holds_no_sums_per_loan(book):
    loans, _, repayments = book
    some = repayments.withColumn("repayment_id", F.when(F.col("loan_id") != "L4", F.col("repayment_id")))
    twice = loans.union(loans.where("loan_id = 'L1'"))
    plain = lb.partial_payments(some, twice)
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert len(sums) == 1 and "loan_id" not in sums[0]
    sizes = measure(some, ["loan_id"], 2)
    assert sizes.hot.count == 1 and rows(lb.partial_payments(some, twice, sizes=sizes)) == rows(plain)
    (got,) = rows(plain)  # payments without an id count in the rate only
    assert (got["total_payments"], got["partial_payments"]) == (10, 6)
    assert got["partial_pct"] == 50.0


def test_state_rank_and_exposure(book):
    loans, borrowers, _ = book
    got = column(lb.state_report(loans, borrowers), "state", "portfolio_rank")
    assert got == {"X": 1, "Y": 2}
    top = rows(lb.top_exposures(loans, borrowers, 3))
    assert [r["customer_id"] for r in top] == ["B4", "B2", "B1"]
    assert top[0]["pct_of_portfolio"] == 60.0
    assert top[0]["loan_types"] == "Gold Loan | Home"
    # two borrowers named Bob stay apart
    assert len(rows(lb.top_exposures(loans, borrowers))) == 4


def test_hhi_total(book):
    loans, _, _ = book
    got = column(lb.purpose_hhi(loans), "loan_purpose", "hhi_contribution")
    assert got[fv.HHI_TOTAL_LABEL] == 10000.0 and got["Gold Loan"] == 0.0


def test_vintage_and_cohorts(book):
    loans, borrowers, _ = book
    assert column(lb.npa_by_vintage(loans, borrowers), "vintage_year", "npas") == {
        "2020": 1,
        "2021": 1,
    }
    got = rows(lb.cohort_npa_change(loans))
    assert [r["cohort_month"] for r in got] == ["2020-01", "2020-03", "2021-01", "2021-06"]
    assert [r["prev_month_npa_rate"] for r in got] == [None, 0.0, 50.0, 100.0]
    assert [r["mom_change"] for r in got] == [None, 50.0, 50.0, -66.67]


def test_early_defaults(book):
    loans, borrowers, repayments = book
    got = column(
        lb.early_defaults(repayments, loans, borrowers, cuts=[1, 2, 3], labels=["a", "b", "c"]),
        "default_timing",
        "loan_count",
    )
    assert got == {"a": 1, "b": 1}  # 30 days is not more than 30
    got = column(lb.early_defaults(repayments, loans, borrowers), "default_timing", "loan_count")
    assert got == {"0-6 months (Early Default)": 2}


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_exposure_ranking(book, hot_rows):
    loans, borrowers, _ = book
    got = rows(lb.exposure_ranking(loans, borrowers, hot_rows=hot_rows))
    assert len(got) == 6
    # scores in order: 720 720 | 649 649 | 619 | 549; amounts: L3 L5 | L2 L1 | L4 | L6
    by_id = {(r["customer_id"], r["loan_amount"]): r for r in got}
    assert by_id[("B1", 1e7)]["credit_quartile"] == 1
    assert by_id[("B4", 3e7)]["credit_quartile"] == 2
    assert by_id[("B2", 3e7)]["credit_quartile"] == 4
    assert by_id[("B4", 3e7)]["loan_size_quartile"] == 1
    assert by_id[("B4", 5e6)]["loan_size_quartile"] == 4
    assert by_id[("B2", 3e7)]["credit_score_percentile"] == 1.0
    assert by_id[("B4", 5e6)]["credit_score_percentile"] == 0.4
    assert by_id[("B1", 1e7)]["rank_within_product"] == 2
    assert by_id[("B3", 1e7)]["rank_within_product"] == 2  # equal amounts share a rank
    assert by_id[("B4", 5e6)]["rank_within_product"] == 3


def test_rolling_collections_by_row(book):
    loans, _, repayments = book
    got = rows(lb.rolling_collections(repayments, loans))
    assert [r["payment_month_str"] for r in got][-2:] == ["2021-04", "2024-01"]
    three = [r["monthly_collection"] for r in got][-3:]
    assert got[-1]["rolling_3m_avg"] == round(sum(three) / 3, 2)


def test_rolling_collections_holds_no_sums_per_loan(book):
    loans, _, repayments = book
    plain = lb.rolling_collections(repayments, loans)
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.splitlines() if "Aggregate [" in line]
    assert len(sums) == 1 and "loan_id" not in sums[0]
    sizes = measure(repayments, ["loan_id"], 2)
    assert sizes.hot.count == 1  # L1
    twice = loans.union(loans.where("loan_id IN ('L1', 'L3')"))
    for book_rows in (loans, twice):
        assert rows(lb.rolling_collections(repayments, book_rows, sizes=sizes)) == rows(
            lb.rolling_collections(repayments, book_rows)
        )
    got = rows(lb.rolling_collections(repayments.withColumn("amount_paid", F.lit(1e5)), twice))
    assert [r["monthly_collection"] for r in got] == [5.0, 4.0, 2.0, 2.0, 1.0]


def test_expected_loss(book):
    loans, _, _ = book
    got = {r["loan_purpose"]: r for r in rows(lb.expected_loss(loans.where("customer_id <> 'B7'")))}
    assert got["Gold Loan"]["lgd_assumption"] == 0.6 and got["Home"]["lgd_assumption"] == 0.4
    assert got["Home"]["pd_estimate"] == 0.0 and got["Gold Loan"]["pd_estimate"] == 1.0
    some = rows(lb.expected_loss(loans.where("loan_purpose = 'Home'"), bad=["30 DPD"]))[0]
    assert some["pd_estimate"] == 0.4
    assert some["expected_loss_cr"] == round((1e7 + 2e7 + 1e7 + 6e7 + 9e9) * 0.4 * 0.4 / 1e7, 4)


def test_watchlist(book):
    loans, borrowers, _ = book
    got = rows(lb.watchlist(loans, borrowers))
    assert [(r["loan_id"], r["watch_flag"][:4]) for r in got] == [
        ("L3", "HIGH"),
        ("L4", "MODE"),
        ("L6", "STAN"),
    ]
    assert got[1]["dti_pct"] is None and got[0]["dti_pct"] == 20.0


def test_reports_from_one_pass(book):
    """Reports of sums give the same rows from the loans and from the sums of one pass."""
    loans, borrowers, _ = book
    odd = [
        loan("M1", None, None, 5.0, 5.0, None, 1.0),  # NULL keys in both groupings
        loan("M2", "B1", None, None, None, "NPA", 1.0),
        loan("M3", "B2", "Home", 4.0, None, "Closed", 1.0, dt.date(2019, 12, 31)),
    ]
    loans = loans.unionByName(loans.sparkSession.createDataFrame(odd, LOANS)).repartition(3)
    undated = loans.limit(1).selectExpr("* except (disbursal_date)", "cast(null as date) as disbursal_date")
    loans = loans.unionByName(undated.select(loans.columns))
    sums = lb.BookSums(loans)
    reports = [
        lb.breakdown_by_purpose,
        lb.breakdown_by_status,
        lb.npa_by_purpose,
        lb.status_matrix,
        lb.purpose_hhi,
        lb.cohort_npa_change,
        lb.expected_loss,
    ]
    of_borrowers = [
        lb.portfolio_summary,
        lb.npa_by_score_band,
        lb.segment_report,
        lb.state_report,
        lb.npa_by_age_group,
        lb.npa_by_vintage,
    ]
    for report in reports:
        assert rows(report(sums)) == rows(report(loans)), report.__name__
    for report in of_borrowers:
        assert rows(report(sums, borrowers)) == rows(report(loans, borrowers)), report.__name__
    assert rows(lb.top_exposures(loans, borrowers, sums=sums)) == rows(lb.top_exposures(loans, borrowers))
    assert sums.by_kind.agg({"n": "sum"}).first()[0] == loans.count()
    plan = lb.breakdown_by_purpose(sums)._jdf.queryExecution().toString()
    assert "sums-by-kind" in plan and "LocalTableScan" not in plan  # the loans are not read again
    with pytest.raises(ValueError, match="as bad"):
        lb.npa_by_purpose(sums, ["NPA"])
    with pytest.raises(ValueError, match="no sums"):
        sums.per(["customer_id", "loan_purpose"])


def test_sums_of_no_loans(book):
    loans, borrowers, _ = book
    sums = lb.BookSums(loans.limit(0))
    assert rows(lb.breakdown_by_status(sums)) == [] and rows(lb.npa_by_vintage(sums, borrowers)) == []
    assert rows(lb.portfolio_summary(sums, borrowers)) == rows(lb.portfolio_summary(loans.limit(0), borrowers))


def test_one_borrower_with_a_third_of_all_loans(spark, book):
    """Ratio bands, ranking and watch-list where the loans of a busy borrower are spread."""
    _, borrowers, _ = book
    rng = random.Random(4)
    busy = [loan(f"H{i:03d}", "B2", "Home", 100.0 + i % 7, 1.0, "30 DPD", 9000.0 + i) for i in range(60)]
    rest = [
        loan(f"L{i:03d}", f"B{rng.choice([1, 3, 4, 7])}", rng.choice(["Home", "Gold Loan"]), float(rng.randint(50, 200)), 2.0,
             rng.choice(["Active", "60 DPD", "NPA"]), float(rng.randint(1, 40000)))
        for i in range(120)
    ]
    loans = spark.createDataFrame(busy + rest, LOANS)
    sizes = measure(loans, ["customer_id"], 50)
    assert sizes.hot.values == (("B2",),)
    for report in (lb.dti_report, lb.exposure_ranking, lb.watchlist):
        plain = rows(report(loans, borrowers))
        assert plain and plain == rows(report(loans, borrowers, hot_rows=50)), report.__name__
        assert plain == rows(report(loans, borrowers, hot_rows=50, sizes=sizes)), report.__name__
