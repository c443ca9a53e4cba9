"""Whole studies, from files to result tables.

    python -m riskloom.jobs loans  <folder with borrowers, loans, repayments>  <out folder>
    python -m riskloom.jobs signal <price file>  <out folder>  <target>  <supplier> ...

Run them through ``spark-submit`` on a cluster; the session it provides is used as it is.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators.skew import GroupSizes, measure
from .operators.staging import release_staged, stage
from .plans import backtest as bt
from .plans import loan_book as lb
from .plans import models as ml
from .plans import panel as pn
from .sources import files, schemas
from .sources.stored import store_by_key


def loan_reports(
    loans: DataFrame, borrowers: DataFrame, repayments: DataFrame
) -> dict[str, DataFrame]:
    """The 23 reports by name.

    Those made of sums share one pass over the loans. Loans and payments are stored by loan first, so
    windows, sums and joins on it need no exchange.
    """
    one_each = GroupSizes()  # a loan is one row
    loans = store_by_key(loans, "loan_id", sizes=one_each, label="loans").rows
    payments = store_by_key(repayments, "loan_id", ["payment_month"], label="payments")
    repayments, sizes = payments.rows, payments.sizes
    sums = lb.BookSums(loans)
    busy = measure(loans, ["customer_id"])
    return {
        "portfolio_summary": lb.portfolio_summary(sums, borrowers),
        "breakdown_by_purpose": lb.breakdown_by_purpose(sums),
        "breakdown_by_status": lb.breakdown_by_status(sums),
        "npa_by_purpose": lb.npa_by_purpose(sums),
        "status_matrix": lb.status_matrix(sums),
        "npa_by_score_band": lb.npa_by_score_band(sums, borrowers),
        "segment_report": lb.segment_report(sums, borrowers),
        "dti_report": lb.dti_report(loans, borrowers, sizes=busy),
        "collection_trend": lb.collection_trend(repayments),
        "cumulative_collections": lb.cumulative_collections(repayments, sizes=sizes),
        "late_streak": lb.late_streak_by_employment(repayments, borrowers, sizes=sizes),
        "partial_payments": lb.partial_payments(repayments, loans, sizes=sizes),
        "state_report": lb.state_report(sums, borrowers),
        "npa_by_age_group": lb.npa_by_age_group(sums, borrowers),
        "top_exposures": lb.top_exposures(loans, borrowers, sums=sums),
        "purpose_hhi": lb.purpose_hhi(sums),
        "npa_by_vintage": lb.npa_by_vintage(sums, borrowers),
        "early_defaults": lb.early_defaults(repayments, loans, borrowers),
        "cohort_npa_change": lb.cohort_npa_change(sums),
        "exposure_ranking": lb.exposure_ranking(loans, borrowers, sizes=busy),
        "rolling_collections": lb.rolling_collections(repayments, loans, sizes=sizes),
        "expected_loss": lb.expected_loss(sums),
        "watchlist": lb.watchlist(loans, borrowers, sizes=busy),
    }


def signal_study(
    prices: DataFrame,
    target: str,
    suppliers: Sequence[str],
    *,
    step: str = "7 days",
    lags: Sequence[int] = (0,),
    horizon: int = 1,
    models: Sequence[str] = ml.MODEL_ORDER,
    sizing: str = "expanding",
    **fit_options,
) -> tuple[dict[str, DataFrame], ml.Fit]:
    """Prices to features, four models, backtest and every report table."""
    calendar = pn.calendar_of(prices, step=step)
    bound = calendar.length
    returns = pn.log_returns(pn.densify(prices, calendar), bound=bound)
    rows = pn.make_features(
        returns, [target], suppliers, lags=lags, horizon=horizon, bound=bound
    )
    names = pn.feature_names(suppliers, lags)
    split = stage(pn.chrono_split(rows, bound=bound), "features")
    scaled = stage(pn.standardise(split, names), "standardised")
    fit = ml.fit_models(scaled, names, models, **fit_options)
    predictions = stage(fit.predictions, "predictions")
    curves = stage(bt.backtest(predictions, sizing=sizing, bound=bound), "curves")
    summary = bt.model_summary(predictions, curves)
    linear = ml.ELASTIC_NET if ml.ELASTIC_NET in models else models[0]
    coefs = ml.coefficients(fit, prices.sparkSession, linear)
    return {
        "metrics": bt.forecast_metrics(predictions),
        "curves": curves,
        "features": coefs.select("feature"),
        "coefficients": coefs,
        "top_coefficients": ml.top_coefficients(coefs),
        "summary": summary.select(*schemas.SUMMARY_COLUMNS),
        "comparison": bt.metric_comparison(summary, models),
        "curve_table": bt.curve_table(curves),
        "scatter": bt.scatter_table(predictions),
        "axis_limits": bt.axis_limits(predictions),
        "rolling_sharpe": bt.rolling_sharpe_table(curves),
        "drawdown": bt.drawdown_table(curves),
    }, fit


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)
    loans = jobs.add_parser("loans")
    loans.add_argument("source")
    loans.add_argument("out")
    loans.add_argument("--format", choices=["csv", "parquet"], default="csv")
    signal = jobs.add_parser("signal")
    signal.add_argument("source")
    signal.add_argument("out")
    signal.add_argument("target")
    signal.add_argument("suppliers", nargs="+")
    signal.add_argument("--step", default="7 days")
    signal.add_argument("--horizon", type=int, default=1)
    signal.add_argument("--lags", type=int, nargs="+", default=[0], help="weeks back of each supplier")
    signal.add_argument("--sizing", choices=["expanding", "full"], default="expanding")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("riskloom").getOrCreate()
    try:
        _run(spark, args)
    finally:
        release_staged(spark)


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "loans":
        borrowers, book, repayments = files.read_loan_book(spark, args.source, args.format)
        for name, report in loan_reports(book, borrowers, repayments).items():
            files.write_csv(report, f"{args.out}/{name}")
        return
    prices = files.read_csv(spark, args.source, schemas.PRICES)
    tables, fit = signal_study(
        prices,
        args.target,
        args.suppliers,
        step=args.step,
        horizon=args.horizon,
        lags=args.lags,
        sizing=args.sizing,
    )
    files.write_result_set(tables, args.out)
    files.write_csv(tables["summary"], f"{args.out}/summary_csv", single_file=True)
    ml.save_models(fit, f"{args.out}/models")


if __name__ == "__main__":
    main()
