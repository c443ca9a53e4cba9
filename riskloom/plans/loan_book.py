"""Reports over a loan book: borrowers, loans and repayments.

Every report takes DataFrames with the columns of ``sources.schemas`` and returns a DataFrame.
Thresholds, labels and the statuses that count as bad are arguments.

Three habits keep the reports flat when one borrower or one loan holds a large part of a table.
Rows are added up per borrower (or loan) *before* they are joined, so the join sees each key a
bounded number of times and moves sums in place of rows. Where sums would be nearly as many as the
rows, the rows are joined and those of large keys spread (``with_product``). Windows over payments go through
``OrderedRows``, which splits a loan that is too long for one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.expr import (
    band,
    closed_band,
    count_if,
    flag,
    mean_of_sums,
    month_of,
    month_start,
    order_rank,
    pct,
    ratio,
    scaled,
    sum_if,
    tier,
    value_pct,
    weighted_mean,
)
from ..operators.ordered import OrderedRows
from ..operators.ranking import attach_ranks, ntile_of, top_k, value_ranks
from ..operators.shares import concentration, joined_text, total_of, with_share
from ..operators.skew import HOT_ROWS, GroupSizes, lookup_join
from ..operators.staging import stage


def is_bad(bad: Sequence[str] = fv.BAD_STATUSES) -> Column:
    return F.col("loan_status").isin(list(bad))


#: Grouping columns that are made from others.
DERIVED = {
    "_year": lambda: F.year("disbursal_date"),
    "_month": lambda: month_start("disbursal_date"),
}


def _named_keys(keys: Sequence[str]) -> list[Column]:
    return [(DERIVED[k]() if k in DERIVED else F.col(k)).alias(k) for k in keys]


def _sums(bad: Column) -> list[Column]:
    amount, rate, balance = F.col("loan_amount"), F.col("interest_rate"), F.col("outstanding_balance")
    return [
        F.count(F.lit(1)).alias("n"),
        count_if(bad).alias("n_bad"),
        F.sum(amount).alias("amount_sum"),
        F.count(amount).alias("amount_n"),
        F.sum(rate).alias("rate_sum"),
        F.count(rate).alias("rate_n"),
        F.sum(balance).alias("balance_sum"),
        F.count(balance).alias("balance_n"),
        sum_if(bad, balance).alias("bad_balance"),
    ]


SUMS = ["n", "n_bad", "amount_sum", "amount_n", "rate_sum", "rate_n", "balance_sum", "balance_n", "bad_balance"]


class BookSums:
    """Sums of a loan book, by kind of loan and by borrower, from one pass over its rows.

    Reports that need sums only take it in place of ``loans``; their rows are the same. The pass
    groups every row by both sets of keys and stages the sums: those by kind (purpose, status and month
    of disbursal) are few, those by borrower (and year) as many as borrowers with loans.
    """

    KIND = ["loan_purpose", "loan_status", "_month"]
    BORROWER = ["customer_id", "_year"]

    def __init__(self, loans: DataFrame, bad: Sequence[str] = fv.BAD_STATUSES):
        self.bad = list(bad)
        every = [*self.KIND, *self.BORROWER]
        rows = loans.select(
            *_named_keys(every),
            is_bad(self.bad).alias("_bad"),
            "loan_amount",
            "interest_rate",
            "outstanding_balance",
        )
        sums = rows.groupingSets(
            [[F.col(k) for k in self.KIND], [F.col(k) for k in self.BORROWER]], *[F.col(k) for k in every]
        ).agg(F.grouping("customer_id").cast("boolean").alias("_by_kind"), *_sums(F.col("_bad")))
        self.table = stage(sums, "book-sums")
        self.by_kind = stage(self.table.where("_by_kind").drop("_by_kind", *self.BORROWER), "sums-by-kind")
        self.by_borrower = self.table.where("not _by_kind").drop("_by_kind", *self.KIND)

    def per(self, keys: Sequence[str], bad: Sequence[str] | None = None) -> DataFrame:
        """The sums added up by fewer keys, all of them of a kind or all of a borrower."""
        if bad is not None and list(bad) != self.bad:
            raise ValueError(f"these sums count {self.bad} as bad, not {list(bad)}")
        if set(keys) <= set(self.KIND):
            of = self.by_kind
        elif set(keys) <= set(self.BORROWER):
            of = self.by_borrower
        else:
            raise ValueError(f"no sums by {list(keys)}")
        return of.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def sums_per(
    loans: DataFrame | BookSums, keys: Sequence[str], bad: Sequence[str] | None = None
) -> DataFrame:
    """Partial sums of a loan book per key; reports drop the ones they do not use."""
    if isinstance(loans, BookSums):
        return loans.per(keys, bad)
    return loans.groupBy(*_named_keys(keys)).agg(*_sums(is_bad(bad or ())))


def book_per_borrower(
    loans: DataFrame | BookSums,
    borrowers: DataFrame,
    bad: Sequence[str] = fv.BAD_STATUSES,
    extra: Sequence[str] = (),
) -> DataFrame:
    """One row per borrower (and ``extra`` key) with loan sums and the borrower's attributes."""
    return sums_per(loans, ["customer_id", *extra], bad).join(borrowers, "customer_id")


def with_borrowers(
    loans: DataFrame,
    borrowers: DataFrame,
    *,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Loans with their borrower's attributes; the loans of a borrower with very many are spread."""
    table = borrowers.withColumnRenamed("customer_id", "_borrower")
    pairs = {"customer_id": "_borrower"}
    return lookup_join(loans, table, pairs, hot_rows=hot_rows, sizes=sizes).drop("_borrower")


def with_product(
    repayments: DataFrame,
    loans: DataFrame,
    columns: Sequence[str | Column],
    *,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """``columns`` of the payments with their loan's product; those of a loan with very many are spread.

    Payments meet their loan as rows: sums per loan would not be much fewer, and a task would hold them all.
    """
    kept = sizes.flags() if sizes is not None else []
    product = loans.select(F.col("loan_id").alias("_loan"), "loan_purpose")
    rows = repayments.select("loan_id", *columns, *kept)
    return lookup_join(rows, product, {"loan_id": "_loan"}, hot_rows=hot_rows, sizes=sizes)


def _npa_pct() -> Column:
    return pct(F.sum("n_bad"), F.sum("n"), 2)


# -- overview ------------------------------------------------------------------------------


def portfolio_summary(loans: DataFrame | BookSums, borrowers: DataFrame) -> DataFrame:
    """One row for the whole book. Averages weigh every loan once."""
    return book_per_borrower(loans, borrowers).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_loans"),
        F.count_distinct("customer_id").alias("unique_borrowers"),
        scaled(F.sum("amount_sum"), fv.CRORE).alias("total_disbursed_cr"),
        scaled(F.sum("balance_sum"), fv.CRORE).alias("total_outstanding_cr"),
        F.round(mean_of_sums("amount_sum", "amount_n"), 0).alias("avg_loan_amount"),
        F.round(weighted_mean("credit_score", "n"), 1).alias("avg_credit_score"),
        F.round(mean_of_sums("rate_sum", "rate_n"), 2).alias("avg_interest_rate"),
    )


def breakdown_by_purpose(loans: DataFrame | BookSums) -> DataFrame:
    sums = sums_per(loans, ["loan_purpose"])
    grouped = sums.select(
        "loan_purpose",
        F.col("n").alias("loan_count"),
        scaled("amount_sum", fv.CRORE).alias("disbursed_cr"),
        F.round(ratio("amount_sum", "amount_n"), 0).alias("avg_ticket_size"),
        F.round(ratio("rate_sum", "rate_n"), 2).alias("avg_rate"),
    )
    total = total_of(sums, F.sum("n"))
    return with_share(grouped, "loan_count", total, "pct_of_portfolio", 1).orderBy(
        F.col("disbursed_cr").desc(), "loan_purpose"
    )


def breakdown_by_status(
    loans: DataFrame | BookSums, status_order: Sequence[str] = fv.STATUS_ORDER
) -> DataFrame:
    """Statuses in business order; a status outside the list comes first."""
    sums = sums_per(loans, ["loan_status"])
    grouped = sums.select(
        "loan_status",
        F.col("n").alias("count"),
        scaled("balance_sum", fv.CRORE).alias("outstanding_cr"),
        F.round(ratio("balance_sum", "balance_n"), 0).alias("avg_outstanding"),
    )
    total = total_of(sums, F.sum("n"))
    return with_share(grouped, "count", total, "pct", 2).orderBy(
        order_rank("loan_status", status_order), "loan_status"
    )


# -- delinquency ---------------------------------------------------------------------------


def npa_by_purpose(loans: DataFrame | BookSums, bad: Sequence[str] = fv.BAD_STATUSES) -> DataFrame:
    """Bad-loan rate per purpose, by number of loans and by outstanding value."""
    return (
        sums_per(loans, ["loan_purpose"], bad)
        .select(
            "loan_purpose",
            F.col("n").alias("total_loans"),
            F.col("n_bad").alias("npa_count"),
            pct("n_bad", "n").alias("gross_npa_pct"),
            value_pct("bad_balance", "balance_sum").alias("npa_by_value_pct"),
        )
        .orderBy(F.col("gross_npa_pct").desc(), "loan_purpose")
    )


def status_matrix(
    loans: DataFrame | BookSums, statuses: dict[str, str] = fv.STATUS_COLUMNS
) -> DataFrame:
    """Loans per purpose and status. A count at one date: it holds no moves between statuses."""
    sums = sums_per(loans, ["loan_purpose", "loan_status"])
    # naming the values spares the job that would look them up
    counts = sums.groupBy("loan_purpose").pivot("loan_status", list(statuses)).agg(F.sum("n"))
    return counts.select(
        "loan_purpose",
        *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(name) for s, name in statuses.items()],
    ).orderBy("loan_purpose")


def npa_by_score_band(
    loans: DataFrame | BookSums,
    borrowers: DataFrame,
    bad: Sequence[str] = fv.BAD_STATUSES,
    bands=fv.SCORE_BANDS,
    default: str = fv.SCORE_BAND_DEFAULT,
) -> DataFrame:
    book = book_per_borrower(loans, borrowers, bad)
    return (
        book.groupBy(closed_band("credit_score", bands, default).alias("credit_band"))
        .agg(
            F.sum("n").alias("loans"),
            F.round(weighted_mean("credit_score", "n"), 0).alias("avg_score"),
            _npa_pct().alias("npa_rate_pct"),
            F.round(mean_of_sums("amount_sum", "amount_n"), 0).alias("avg_loan_amount"),
        )
        .orderBy("avg_score", "credit_band")
    )


# -- segmentation --------------------------------------------------------------------------


def risk_segment(segments=fv.RISK_SEGMENTS, default: str = fv.RISK_SEGMENT_DEFAULT) -> Column:
    """Segment of a borrower by least credit score and least income."""
    score, income = F.col("credit_score"), F.col("annual_income")
    return tier([((score >= s) & (income >= i), label) for s, i, label in segments], default)


def segment_report(
    loans: DataFrame | BookSums,
    borrowers: DataFrame,
    bad: Sequence[str] = fv.BAD_STATUSES,
    segment: Column | None = None,
) -> DataFrame:
    """Per risk segment. ``borrowers`` counts loans, and the averages weigh every loan once."""
    book = book_per_borrower(loans, borrowers, bad)
    return (
        book.groupBy((risk_segment() if segment is None else segment).alias("risk_segment"))
        .agg(
            F.sum("n").alias("borrowers"),
            F.round(weighted_mean("credit_score", "n"), 0).alias("avg_credit_score"),
            F.round(weighted_mean("annual_income", "n"), 0).alias("avg_income"),
            _npa_pct().alias("npa_rate_pct"),
            scaled(F.sum("balance_sum"), fv.CRORE).alias("outstanding_cr"),
        )
        .orderBy("risk_segment")
    )


def debt_to_income() -> Column:
    return ratio(F.col("emi_amount") * 12, "annual_income")


def dti_report(
    loans: DataFrame,
    borrowers: DataFrame,
    bad: Sequence[str] = fv.BAD_STATUSES,
    cuts=fv.DTI_BANDS,
    default: str = fv.DTI_BAND_DEFAULT,
    *,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Per debt-to-income band. An unknown ratio (income zero or missing) is in the last band.

    The band needs both sides of every loan, so rows are joined; those of a borrower with very
    many loans are spread.
    """
    return (
        with_borrowers(loans, borrowers, hot_rows=hot_rows, sizes=sizes)
        .groupBy(band(debt_to_income(), cuts, default).alias("dti_band"))
        .agg(
            F.count(F.lit(1)).alias("loan_count"),
            pct(count_if(is_bad(bad)), F.count(F.lit(1))).alias("npa_rate_pct"),
            F.round(F.avg("loan_amount"), 0).alias("avg_loan_amount"),
            F.round(F.avg("credit_score"), 0).alias("avg_credit_score"),
        )
        .orderBy("npa_rate_pct", "dti_band")
    )


# -- repayment behaviour -------------------------------------------------------------------


def collection_trend(
    repayments: DataFrame,
    date_from: str = fv.COLLECTION_FROM,
    date_to: str = fv.COLLECTION_TO,
) -> DataFrame:
    """Payments per month inside a closed date range."""
    day = F.col("payment_date")
    inside = day.between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))
    return (
        repayments.where(inside)
        .groupBy(month_start(day).alias("_month"))
        .agg(
            F.count(F.lit(1)).alias("payments_made"),
            scaled(F.sum("amount_paid"), fv.CRORE, 3).alias("collection_cr"),
            scaled(F.sum("emi_due"), fv.CRORE, 3).alias("demand_cr"),
            value_pct(F.sum("amount_paid"), F.sum("emi_due")).alias("collection_efficiency_pct"),
            count_if(F.col("days_late") > 0).alias("late_payments"),
        )
        .select(month_of("_month").alias("month"), "*")
        .drop("_month")
        .orderBy("month")
    )


def cumulative_collections(
    repayments: DataFrame,
    loan_ids: Sequence | None = None,
    *,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
    position: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Running total and three-payment mean per loan, for some loans or for all of them.

    ``sizes`` of the loans and ``position``, where payments are numbered without gaps, are
    handed to ``OrderedRows``; neither changes a result. Unless ``ordered``, the rows of payments that
    are stored by loan leave without any exchange.
    """
    kept = sizes.flags() if sizes is not None else []
    shown = ["loan_id", "payment_month", "payment_date", "amount_paid"]
    rows = repayments.select(*shown, *kept)
    if loan_ids is not None:
        rows = rows.where(F.col("loan_id").isin(list(loan_ids)))
    paid = F.col("amount_paid")
    by_loan = OrderedRows(
        rows,
        ["loan_id"],
        ["payment_month"],
        hot_rows=hot_rows,
        sizes=sizes,
        position=position,
    )
    done = (
        (by_loan.by_range() if ordered else by_loan)
        .running({"cumulative_collected": ("sum", paid)})
        .nearby(
            {"rolling_3m_avg_payment": lambda w: F.avg(paid).over(w.rowsBetween(-2, 0))}, back=2
        )
        .rows()
        .drop(*kept)
    )
    return done.orderBy("loan_id", "payment_month") if ordered else done


def late_streak_by_employment(
    repayments: DataFrame,
    borrowers: DataFrame,
    streak: int = fv.LATE_STREAK,
    *,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
    position: str | None = None,
) -> DataFrame:
    """Share of loans with at least ``streak`` late payments in a row, per employment type."""
    kept = sizes.flags() if sizes is not None else []
    flagged = with_streak(
        repayments.select("customer_id", "loan_id", "payment_month", "days_late", *kept),
        ["loan_id"],
        ["payment_month"],
        F.col("days_late") > 0,
        streak,
        "_streak",
        hot_rows=hot_rows,
        sizes=sizes,
        position=position,
    )
    per_loan = flagged.groupBy("customer_id", "loan_id").agg(F.max("_streak").alias("has_streak"))
    per_borrower = per_loan.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("has_streak").alias("n_streak")
    )
    return (
        per_borrower.join(borrowers, "customer_id")
        .groupBy("employment_type")
        .agg(
            F.sum("n").alias("total_loans"),
            F.sum("n_streak").alias("loans_with_consec_late"),
            pct(F.sum("n_streak"), F.sum("n")).alias("pct_with_consec_late"),
        )
        .orderBy(F.col("pct_with_consec_late").desc(), "employment_type")
    )


def with_streak(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rule: Column,
    length: int,
    name: str,
    *,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
    position: str | None = None,
) -> DataFrame:
    """Add 1 where this row and the ``length - 1`` rows before it all fulfil the rule, else 0."""

    def streak(w):
        frame = w.rowsBetween(-(length - 1), 0)
        return flag((F.min("_hit").over(frame) == 1) & (F.count("_hit").over(frame) == length))

    rows = OrderedRows(
        df.withColumn("_hit", flag(rule)),
        keys,
        order,
        hot_rows=hot_rows,
        sizes=sizes,
        position=position,
    )
    return rows.nearby({name: streak}, back=length - 1).rows().drop("_hit")


def partial_payments(
    repayments: DataFrame,
    loans: DataFrame,
    tolerance: float = fv.PARTIAL_TOLERANCE,
    *,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Payments below the tolerated part of the amount due, and the total shortfall."""
    paid, due = F.col("amount_paid"), F.col("emi_due")
    shown = ["amount_paid", "emi_due", F.col("repayment_id").isNotNull().alias("_named")]
    n_partial = count_if(paid < due * F.lit(tolerance))
    return (
        with_product(repayments, loans, shown, hot_rows=hot_rows, sizes=sizes)
        .groupBy("loan_purpose")
        .agg(
            count_if(F.col("_named")).alias("total_payments"),
            n_partial.alias("partial_payments"),
            pct(n_partial, F.count(F.lit(1))).alias("partial_pct"),
            scaled(F.sum(F.greatest(due - paid, F.lit(0.0))), fv.LAKH).alias("total_shortfall_lacs"),
        )
        .orderBy(F.col("partial_pct").desc(), "loan_purpose")
    )


# -- geography and age ---------------------------------------------------------------------


def state_report(
    loans: DataFrame | BookSums, borrowers: DataFrame, bad: Sequence[str] = fv.BAD_STATUSES
) -> DataFrame:
    """Per state, ranked by disbursed amount before rounding."""
    grouped = (
        book_per_borrower(loans, borrowers, bad)
        .groupBy("state")
        .agg(
            F.sum("n").alias("total_loans"),
            F.sum("amount_sum").alias("_amount"),
            _npa_pct().alias("npa_rate_pct"),
            F.round(weighted_mean("credit_score", "n"), 0).alias("avg_credit_score"),
            F.round(weighted_mean(F.col("annual_income") / 100000.0, "n"), 2).alias(
                "avg_income_lacs"
            ),
        )
    )
    # one row per state at this point
    by_amount = Window.orderBy(F.col("_amount").desc())
    return grouped.select(
        "state",
        "total_loans",
        scaled("_amount", fv.CRORE).alias("disbursed_cr"),
        "npa_rate_pct",
        "avg_credit_score",
        "avg_income_lacs",
        F.rank().over(by_amount).cast("long").alias("portfolio_rank"),
    ).orderBy(F.col("disbursed_cr").desc(), "state")


def npa_by_age_group(
    loans: DataFrame | BookSums,
    borrowers: DataFrame,
    bad: Sequence[str] = fv.BAD_STATUSES,
    bands=fv.AGE_BANDS,
    default: str = fv.AGE_BAND_DEFAULT,
) -> DataFrame:
    """Per age group, in text order of the labels."""
    return (
        book_per_borrower(loans, borrowers, bad)
        .groupBy(closed_band("age", bands, default).alias("age_group"))
        .agg(
            F.sum("n").alias("loans"),
            F.round(mean_of_sums("amount_sum", "amount_n"), 0).alias("avg_loan"),
            F.round(weighted_mean("credit_score", "n"), 0).alias("avg_score"),
            _npa_pct().alias("npa_rate_pct"),
        )
        .orderBy("age_group")
    )


# -- concentration -------------------------------------------------------------------------


def top_exposures(
    loans: DataFrame,
    borrowers: DataFrame,
    k: int = fv.TOP_EXPOSURES,
    sums: BookSums | None = None,
) -> DataFrame:
    """Borrowers with the largest outstanding sums and their share of the whole book.

    The share is of all borrowers. Purposes are listed for the ``k`` shown borrowers only.
    """
    shown = ["customer_id", "name", "state", "credit_score"]
    book = book_per_borrower(loans if sums is None else sums, borrowers).select(
        *shown, F.col("n").alias("num_loans"), "balance_sum"
    )
    total = total_of(book, F.sum("balance_sum"))
    ranked = with_share(book, "balance_sum", total, "pct_of_portfolio", 3).withColumn(
        "total_exposure_lacs", scaled("balance_sum", fv.LAKH)
    )
    order = ["-total_exposure_lacs", "customer_id"]
    top = stage(top_k(ranked, order, k).drop("balance_sum"), "top")  # k rows
    theirs = loans.join(F.broadcast(top.select("customer_id")), "customer_id", "left_semi")
    types = joined_text(theirs, ["customer_id"], "loan_purpose", "loan_types")
    return top_k(top.join(types, "customer_id", "left"), order, k)


def purpose_hhi(loans: DataFrame | BookSums) -> DataFrame:
    """Share of outstanding value per purpose, and one row with the index over all of them."""
    shares = concentration(sums_per(loans, ["loan_purpose"]), "loan_purpose", "balance_sum")
    detail = shares.select(
        "loan_purpose",
        F.round("share", 2).alias("share_pct"),
        F.round("squared", 4).alias("hhi_contribution"),
    )
    total = shares.agg(F.sum("squared").alias("_hhi")).select(
        F.lit(fv.HHI_TOTAL_LABEL).alias("loan_purpose"),
        F.lit(None).cast("double").alias("share_pct"),
        F.round("_hhi", 2).alias("hhi_contribution"),
    )
    return detail.unionByName(total).orderBy(F.col("hhi_contribution").desc(), "loan_purpose")


# -- vintages ------------------------------------------------------------------------------


def npa_by_vintage(
    loans: DataFrame | BookSums, borrowers: DataFrame, bad: Sequence[str] = fv.BAD_STATUSES
) -> DataFrame:
    """Per year of disbursal. The score is the borrower's stored one, not a score of that year."""
    return (
        book_per_borrower(loans, borrowers, bad, ["_year"])
        .groupBy("_year")
        .agg(
            F.sum("n").alias("loans_disbursed"),
            scaled(F.sum("amount_sum"), fv.CRORE).alias("disbursed_cr"),
            F.sum("n_bad").alias("npas"),
            _npa_pct().alias("npa_rate_pct"),
            F.round(weighted_mean("credit_score", "n"), 0).alias(
                "avg_credit_score_at_origination"
            ),
        )
        .select(F.lpad(F.col("_year").cast("string"), 4, "0").alias("vintage_year"), "*")
        .drop("_year")
        .orderBy("vintage_year")
    )


def early_defaults(
    repayments: DataFrame,
    loans: DataFrame,
    borrowers: DataFrame,
    days_late: int = fv.DEFAULT_DAYS_LATE,
    cuts: Sequence[int] = fv.DEFAULT_TIMING_CUTS,
    labels: Sequence[str] = fv.DEFAULT_TIMING_LABELS,
    default: str = fv.DEFAULT_TIMING_DEFAULT,
) -> DataFrame:
    """Loans by the number of their first payment that was more than ``days_late`` days late."""
    first = (
        repayments.where(F.col("days_late") > days_late)
        .groupBy("loan_id")
        .agg(F.min("payment_month").alias("first_default_month"))
        .where(F.col("first_default_month").isNotNull())
    )
    timing = band(
        "first_default_month", list(zip(cuts, labels, strict=True)), default, inclusive=True
    )
    per_borrower = (
        first.join(loans.select("loan_id", "customer_id", "loan_amount"), "loan_id")
        .groupBy("customer_id", timing.alias("default_timing"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("loan_amount").alias("amount_sum"),
            F.count("loan_amount").alias("amount_n"),
        )
    )
    return (
        per_borrower.join(borrowers, "customer_id")
        .groupBy("default_timing")
        .agg(
            F.sum("n").alias("loan_count"),
            F.round(weighted_mean("credit_score", "n"), 0).alias("avg_credit_score"),
            F.round(weighted_mean("annual_income", "n"), 0).alias("avg_income"),
            F.round(mean_of_sums("amount_sum", "amount_n"), 0).alias("avg_loan_amount"),
        )
        .orderBy("default_timing")
    )


# -- windows over report rows --------------------------------------------------------------


def cohort_npa_change(loans: DataFrame | BookSums, bad: Sequence[str] = fv.BAD_STATUSES) -> DataFrame:
    """Bad-loan rate per disbursal month and its change from the month before that has loans."""
    cohorts = (
        sums_per(loans, ["_month"], bad)
        .select(
            month_of("_month").alias("cohort_month"),
            F.col("n").alias("total_loans"),
            F.col("n_bad").alias("npa_loans"),
            pct("n_bad", "n").alias("npa_rate_pct"),
        )
    )
    # one row per month at this point
    before = F.lag("npa_rate_pct").over(Window.orderBy("cohort_month"))
    return (
        cohorts.withColumn("prev_month_npa_rate", before)
        .withColumn("mom_change", F.round(F.col("npa_rate_pct") - F.col("prev_month_npa_rate"), 2))
        .orderBy("cohort_month")
    )


def exposure_ranking(
    loans: DataFrame,
    borrowers: DataFrame,
    k: int = fv.TOP_RANKED,
    groups: int = 4,
    *,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Quartiles, percentile and rank within product; first ``k`` loans by both quartiles.

    Quartiles order all loans, with ``loan_id`` deciding ties. Loans meet their borrowers once. Only the narrow sort keys are
    sorted; the wide rows get their quartile by comparison with the cut rows. The percentile and
    the dense rank are looked up for the ``k`` shown loans.
    """
    by_score, by_amount = ["-credit_score", "loan_id"], ["-loan_amount", "loan_id"]
    shown = ["customer_id", "name", "credit_score", "annual_income"]
    shown += ["loan_amount", "loan_status", "loan_purpose", "loan_id"]
    joined = with_borrowers(loans, borrowers, hot_rows=hot_rows, sizes=sizes)
    scored = stage(joined.select(*shown), "scored")
    rows = scored.select(
        *shown,
        ntile_of(scored, groups, by_score).alias("credit_quartile"),
        ntile_of(scored, groups, by_amount).alias("loan_size_quartile"),
    )
    order = ["credit_quartile", "loan_size_quartile", "loan_id"]
    top = stage(top_k(rows, order, k), "top")  # k rows
    scores = value_ranks(
        scored.groupBy("credit_score").agg(F.count(F.lit(1)).alias("n")),
        "-credit_score",
        weight="n",
        hot_rows=hot_rows,
    )
    top_scored = attach_ranks(
        top, scores, ["credit_score"], {"percent_rank": "credit_score_percentile"}, bound=k
    )
    # a dense rank counts the distinct amounts above, so smaller amounts need no sorting
    least = top.groupBy(F.col("loan_purpose").alias("_purpose")).agg(
        F.min("loan_amount").alias("_least")
    )
    pairs = (
        scored.join(F.broadcast(least), F.col("loan_purpose").eqNullSafe(F.col("_purpose")))
        .where(F.col("_least").isNull() | (F.col("loan_amount") >= F.col("_least")))
        .select("loan_purpose", "loan_amount")
    )
    in_product = value_ranks(pairs, "-loan_amount", keys=["loan_purpose"], hot_rows=hot_rows)
    done = attach_ranks(
        top_scored,
        in_product,
        ["loan_purpose", "loan_amount"],
        {"dense_rank": "rank_within_product"},
        bound=k,
    )
    return top_k(done, order, k).drop("loan_purpose", "loan_id")


def rolling_collections(
    repayments: DataFrame,
    loans: DataFrame,
    *,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Monthly collection per product and its mean over three present months.

    The mean is over rows, so a month without payments is skipped; it works on the rounded sums.
    """
    paid = ["payment_date", "amount_paid"]
    monthly = (
        with_product(repayments, loans, paid, hot_rows=hot_rows, sizes=sizes)
        .groupBy("loan_purpose", month_start("payment_date").alias("_month"))
        .agg(scaled(F.sum("amount_paid"), fv.LAKH).alias("monthly_collection"))
        .select("loan_purpose", month_of("_month").alias("payment_month_str"), "monthly_collection")
    )
    # one row per product and month at this point
    three = Window.partitionBy("loan_purpose").orderBy("payment_month_str").rowsBetween(-2, 0)
    return monthly.withColumn(
        "rolling_3m_avg", F.round(F.avg("monthly_collection").over(three), 2)
    ).orderBy("loan_purpose", "payment_month_str")


# -- loss and watch-list -------------------------------------------------------------------


def expected_loss(
    loans: DataFrame | BookSums,
    bad: Sequence[str] = fv.BAD_STATUSES,
    unsecured: Sequence[str] = fv.UNSECURED_PURPOSES,
    lgd_unsecured: float = fv.LGD_UNSECURED,
    lgd_secured: float = fv.LGD_SECURED,
) -> DataFrame:
    """Expected loss = default rate * loss given default * exposure, per purpose.

    The loss uses the default rate before rounding.
    """
    grouped = sums_per(loans, ["loan_purpose"], bad).select(
        "loan_purpose",
        F.col("n").alias("loans"),
        F.col("n_bad").alias("_bad"),
        F.col("balance_sum").alias("_ead"),
    )
    lgd = F.when(F.col("loan_purpose").isin(list(unsecured)), F.lit(lgd_unsecured))
    return (
        grouped.withColumn("_pd", ratio("_bad", "loans"))
        .withColumn("lgd_assumption", lgd.otherwise(F.lit(lgd_secured)))
        .select(
            "loan_purpose",
            "loans",
            scaled("_ead", fv.CRORE).alias("ead_cr"),
            F.round("_pd", 4).alias("pd_estimate"),
            "lgd_assumption",
            scaled(F.col("_ead") * F.col("_pd") * F.col("lgd_assumption"), fv.CRORE, 4).alias(
                "expected_loss_cr"
            ),
        )
        .orderBy(F.col("expected_loss_cr").desc(), "loan_purpose")
    )


def watch_flag(watched: Sequence[str] = fv.WATCH_STATUSES) -> Column:
    score, late = F.col("credit_score"), F.col("loan_status").isin(list(watched))
    several = F.col("existing_loans_count") >= fv.WATCH_HIGH_MIN_LOANS
    return tier(
        [
            ((score < fv.WATCH_HIGH_SCORE_BELOW) & late & several, fv.WATCH_HIGH),
            ((score < fv.WATCH_MODERATE_SCORE_BELOW) & late, fv.WATCH_MODERATE),
        ],
        fv.WATCH_STANDARD,
    )


def watchlist(
    loans: DataFrame,
    borrowers: DataFrame,
    k: int = fv.TOP_WATCHLIST,
    watched: Sequence[str] = fv.WATCH_STATUSES,
    score_below: int = fv.WATCH_SCORE_BELOW,
    *,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Late loans of low-score borrowers, most urgent first."""
    late = loans.where(F.col("loan_status").isin(list(watched)))
    low = borrowers.where(F.col("credit_score") < score_below)
    rows = with_borrowers(late, low, hot_rows=hot_rows, sizes=sizes).select(
        "loan_id",
        "name",
        "credit_score",
        "loan_purpose",
        "outstanding_balance",
        "loan_status",
        "existing_loans_count",
        F.round(debt_to_income() * 100, 1).alias("dti_pct"),
        watch_flag(watched).alias("watch_flag"),
    )
    return top_k(rows, ["watch_flag", "credit_score", "loan_id"], k)
