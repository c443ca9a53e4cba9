"""Every registered query over the shared tables: name -> function(spark, folder) -> DataFrame.

Dates leave as ISO text and unrounded doubles are rounded, so that results compare across
engines; the reports themselves return dates and unrounded values.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import BooleanType, DateType, DoubleType, TimestampNTZType

from .. import fixed_values as fv
from ..functions import expr as e
from ..operators import by_value as bv
from ..operators import distinct as dc
from ..operators import ranking, shares
from ..operators.ordered import OrderedRows
from ..operators.skew import HOT_ROWS, GroupSizes, lookup_join
from ..operators.staging import new_path, stage
from ..sources import files, schemas
from ..sources import shared_tables as src
from ..sources.stored import store_by_key
from . import backtest as bt
from . import loan_book as lb
from . import many_targets as mt
from . import models as ml
from . import panel as pn

Query = Callable[[SparkSession, str], DataFrame]

# Choices for the shared tables, which have other dates, purposes and loan lengths.
UNSECURED = ["1-URGENT", "2-HIGH"]
DATE_FROM, DATE_TO = "1990-01-01", "2010-12-31"
TIMING = {
    "cuts": [1, 2, 4],
    "labels": ["1st payment", "2nd payment", "3rd-4th payment"],
    "default": "later",
}
EVENT_TARGETS = ["purchase"]  # all other event types are its suppliers
MANY_SWEEPS = 2000  # the SQL repeats every one of them
RETURN_UNIT = 0.01  # activity is far noisier than prices; a hundredth looks like weekly returns


def tidy(df: DataFrame, digits: int = 8) -> DataFrame:
    """Comparable values: dates as text, flags as 0/1, doubles rounded, no negative zero."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, DoubleType):
            c = F.round(c, digits) + F.lit(0.0)
        elif isinstance(f.dataType, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, BooleanType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


# -- loan-book reports ---------------------------------------------------------------------


def _on_loans(report) -> Query:
    return lambda spark, folder: tidy(report(src.loans(spark, folder)))


def _on_book(report) -> Query:
    return lambda spark, folder: tidy(
        report(src.loans(spark, folder), src.borrowers(spark, folder))
    )


def _payments(spark, folder, numbered=False):
    """Payments, with their number in the loan if asked, and the sizes of the loans."""
    sizes = src.payment_sizes(spark, folder)
    return src.repayments(spark, folder, numbered=numbered, sizes=sizes), sizes


def _numbered(spark, folder):
    """Numbered payments, and what the windows over them may take for granted."""
    payments, sizes = _payments(spark, folder, numbered=True)
    return payments, {"sizes": sizes, "position": "payment_month"}


def _collection_trend(spark, folder):
    return tidy(lb.collection_trend(_payments(spark, folder)[0], DATE_FROM, DATE_TO))


def _cumulative(spark, folder):
    payments, known = _numbered(spark, folder)
    return tidy(lb.cumulative_collections(payments, **known), 6)


def _late_streak(spark, folder):
    payments, known = _numbered(spark, folder)
    return tidy(lb.late_streak_by_employment(payments, src.borrowers(spark, folder), **known))


def _partial_payments(spark, folder):
    payments, sizes = _payments(spark, folder)
    return tidy(lb.partial_payments(payments, src.loans(spark, folder), sizes=sizes))


def _early_defaults(spark, folder):
    payments, _ = _numbered(spark, folder)
    book = src.loans(spark, folder), src.borrowers(spark, folder)
    return tidy(lb.early_defaults(payments, *book, **TIMING))


def _rolling_collections(spark, folder):
    payments, sizes = _payments(spark, folder)
    return tidy(lb.rolling_collections(payments, src.loans(spark, folder), sizes=sizes))


REPORTS: dict[str, Query] = {
    "q01_portfolio_summary": _on_book(lb.portfolio_summary),
    "q02_breakdown_by_purpose": _on_loans(lb.breakdown_by_purpose),
    "q03_breakdown_by_status": _on_loans(lb.breakdown_by_status),
    "q04_npa_by_purpose": _on_loans(lb.npa_by_purpose),
    "q05_status_matrix": _on_loans(lb.status_matrix),
    "q06_npa_by_score_band": _on_book(lb.npa_by_score_band),
    "q07_segment_report": _on_book(lb.segment_report),
    "q08_dti_report": _on_book(lb.dti_report),
    "q09_collection_trend": _collection_trend,
    "q10_cumulative_collections": _cumulative,
    "q11_late_streak": _late_streak,
    "q12_partial_payments": _partial_payments,
    "q13_state_report": _on_book(lb.state_report),
    "q14_npa_by_age_group": _on_book(lb.npa_by_age_group),
    "q15_top_exposures": _on_book(lb.top_exposures),
    "q16_purpose_hhi": _on_loans(lb.purpose_hhi),
    "q17_npa_by_vintage": _on_book(lb.npa_by_vintage),
    "q18_early_defaults": _early_defaults,
    "q19_cohort_npa_change": _on_loans(lb.cohort_npa_change),
    "q20_exposure_ranking": _on_book(lb.exposure_ranking),
    "q21_rolling_collections": _rolling_collections,
    "q22_expected_loss": _on_loans(partial(lb.expected_loss, unsecured=UNSECURED)),
    "q23_watchlist": _on_book(lb.watchlist),
}



def _stored(spark, folder, hot_rows):
    """Payments and loans stored by loan; the payments of loans above ``hot_rows`` apart."""
    payments = src.repayments(spark, folder, numbered=True)
    payments = store_by_key(payments, "loan_id", ["payment_month"], hot_rows=hot_rows, label="payments")
    loans = store_by_key(src.loans(spark, folder), "loan_id", sizes=GroupSizes(), label="loans")
    return payments, loans.rows


def _stored_collections(spark, folder, hot_rows=6):
    payments, _ = _stored(spark, folder, hot_rows)
    known = {"sizes": payments.sizes, "position": "payment_month", "hot_rows": hot_rows}
    return tidy(lb.cumulative_collections(payments.rows, ordered=False, **known), 6)


def _stored_defaults(spark, folder, hot_rows=6):
    payments, loans = _stored(spark, folder, hot_rows)
    return tidy(lb.early_defaults(payments.rows, loans, src.borrowers(spark, folder), **TIMING))


def _book_sums(spark, folder):
    """All sums of the one pass that feeds the reports: by kind of loan, and by borrower and year."""
    table = lb.BookSums(src.loans(spark, folder)).table
    kind = F.when(F.col("_by_kind"), "kind").otherwise("borrower")
    month = e.month_of("_month").alias("month")
    keys = [kind.alias("sums_by"), "loan_purpose", "loan_status", month, "customer_id", F.col("_year").alias("year")]
    return tidy(table.select(*keys, *lb.SUMS), 4)  # amounts have up to three digits


# -- building blocks on the raw tables -----------------------------------------------------


def _table(name: str):
    return lambda spark, folder: src.table(spark, folder, name)


_orders, _lines, _customers = _table("orders"), _table("lineitem"), _table("customer")
ORDER_BY = ["o_orderdate", "o_orderkey"]
SPLIT_ROWS = 2_000  # rows of a group from which the entries named ..._split divide it


def _csv_round_trip(spark, folder):
    """The whole loan table written as CSV, read back with its schema, and counted."""
    path = new_path(spark, "csv")
    written = src.loans(spark, folder)
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.LOANS.fields]
    files.write_csv(written.select(*typed), path)
    back = schemas.assert_schema(files.read_csv(spark, path, schemas.LOANS), schemas.LOANS)
    return tidy(
        back.groupBy("loan_status").agg(
            F.count("loan_id").alias("n"),
            F.round(F.sum("loan_amount"), 2).alias("amount"),
            F.min("disbursal_date").alias("first_day"),
            F.max("disbursal_date").alias("last_day"),
        )
    )


def _csv_rejects(spark, folder):
    """Orders as CSV lines, of which some have a bad amount, a bad day or too few columns; what was read."""
    key, path = F.col("o_orderkey"), new_path(spark, "csv")
    price = F.when(key % 50 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    day = F.when(key % 75 == 0, F.lit("soon")).otherwise(F.col("o_orderdate").cast("date").cast("string"))
    line = F.when(key % 33 == 0, key.cast("string")).otherwise(F.concat_ws(",", key, price, day))
    _orders(spark, folder).select(line.alias("line")).write.text(path)
    schema = T.StructType.fromDDL("key bigint, price double, day date")
    good, rejects = files.read_csv_rejects(spark, path, schema, header=False)
    kept = good.select(F.lit("read").alias("outcome"), F.col("key"))
    lost = rejects.select("reason", F.substring_index("line", ",", 1).cast("long"))
    return kept.union(lost).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


def _published(spark, folder):
    """Order counts by status, published, then those of one status published anew; what is shown."""
    path = new_path(spark, "published")
    counts = _orders(spark, folder).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    files.publish(counts, path, partition="o_orderstatus")
    again = counts.where("o_orderstatus = 'O'").withColumn("n", F.col("n") * 10)
    files.publish(again, path, partition="o_orderstatus")
    return files.read_published(spark, path)


def _rolling_months(spark, folder, key="o_custkey", hot_rows=HOT_ROWS):
    """Sums over three calendar months, whether each of them has orders or not."""
    month = bv.month_number(F.col("o_orderdate")).alias("month")
    orders = _orders(spark, folder).select("o_orderkey", key, month, "o_totalprice")
    price = F.col("o_totalprice")
    columns = {
        "sum_3": lambda w: F.sum(price).over(w),
        "n_3": lambda w: F.count(price).over(w),
        "max_3": lambda w: F.max(price).over(w),
    }
    done = bv.within(orders, [key], "month", columns, back=2, hot_rows=hot_rows)
    return tidy(done.drop("o_totalprice"), 2)


def _distinct_by_month(spark, folder):
    """Distinct customers of each month and of the half-year to it: exact, and whether sketches are close."""
    month = bv.month_number(F.col("o_orderdate")).alias("month")
    orders = _orders(spark, folder).select("o_custkey", month)
    sketches = stage(dc.distinct_sketches(orders, ["month"], "o_custkey"), "sketches")
    half = dc.rolling_distinct(sketches, [], "month", 5)
    spread = orders.distinct().select("o_custkey", F.explode(F.sequence("month", F.col("month") + 5)).alias("month"))
    exact = orders.groupBy("month").agg(F.count_distinct("o_custkey").alias("customers"))
    exact_half = spread.groupBy("month").agg(F.count_distinct("o_custkey").alias("half_year"))
    share = F.lit(4 * dc.standard_error())

    def close(name, sketch):
        return (F.abs(dc.estimate(sketch) - F.col(name)) <= F.col(name) * share + 1).cast("long")

    return (
        exact.join(exact_half, "month")
        .join(sketches, "month")
        .join(half.withColumnRenamed("sketch", "half"), "month")
        .select(
            "month",
            "customers",
            "half_year",
            close("customers", "sketch").alias("close"),
            close("half_year", "half").alias("half_close"),
        )
    )


def _band_count(spark, folder):
    cuts = [(0.0, "negative"), (2500.0, "low"), (5000.0, "middle"), (7500.0, "high")]
    label = e.band("c_acctbal", cuts, "top")
    return _customers(spark, folder).groupBy(label.alias("band")).agg(F.count("*").alias("n"))


def _tier_count(spark, folder):
    big, urgent = F.col("o_totalprice") >= 300000.0, F.col("o_orderpriority") == "1-URGENT"
    label = e.tier([(big & urgent, "A"), (big | urgent, "B")], "C")
    return _orders(spark, folder).groupBy(label.alias("tier")).agg(F.count("*").alias("n"))


def _conditional_rate(spark, folder):
    late = F.col("l_returnflag") == "R"
    return _lines(spark, folder).groupBy("l_linestatus").agg(
        e.count_if(late).alias("n_hit"), e.rate_pct(late, 4).alias("rate_pct")
    )


def _value_rate(spark, folder):
    late = F.col("l_returnflag") == "R"
    return _lines(spark, folder).groupBy("l_linestatus").agg(
        e.value_rate_pct(late, "l_extendedprice", 4).alias("value_rate_pct")
    )


def _listed(df, column) -> list:
    """The distinct values of a column that becomes columns, in order."""
    return [r[0] for r in df.select(column).distinct().where(F.col(column).isNotNull()).orderBy(column).collect()]


def _pivot_counts(spark, folder):
    orders = _orders(spark, folder)
    statuses = _listed(orders, "o_orderstatus")
    wide = orders.groupBy("o_orderpriority").pivot("o_orderstatus", statuses)
    return wide.count().na.fill(0, statuses)


def _share_of_total(spark, folder):
    return shares.count_share(_orders(spark, folder), "o_orderpriority", "pct", 4)


def _hhi(spark, folder):
    return tidy(shares.hhi(_orders(spark, folder), "o_custkey", "o_totalprice"), 6)


def _top_k_share(spark, folder):
    orders = _orders(spark, folder)
    sums = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("value"))
    total = shares.total_of(sums, F.sum("value"))
    shared = shares.with_share(sums, "value", total, "pct", 6)
    shared = shared.withColumn("value", F.round("value", 2))
    return ranking.top_k(shared, ["-value", "o_custkey"], 25)


def _string_list(spark, folder):
    return shares.joined_text(_orders(spark, folder), ["o_custkey"], "o_orderpriority", "listed")


def _ordered(spark, folder, key, hot_rows) -> OrderedRows:
    rows = _orders(spark, folder).select("o_orderkey", key, "o_orderdate", "o_totalprice")
    return OrderedRows(rows, [key], ORDER_BY, hot_rows=hot_rows)


def _running(spark, folder, key="o_custkey", hot_rows=HOT_ROWS):
    price = F.col("o_totalprice")
    done = _ordered(spark, folder, key, hot_rows).running(
        {"running_sum": ("sum", price), "running_max": ("max", price), "n_so_far": ("count", price)}
    )
    return tidy(done.rows().drop("o_orderdate", "o_totalprice"), 4)


def _rolling(spark, folder, key="o_custkey", hot_rows=HOT_ROWS):
    price = F.col("o_totalprice")
    done = _ordered(spark, folder, key, hot_rows).nearby(
        {
            "mean_partial": lambda w: F.avg(price).over(w.rowsBetween(-2, 0)),
            "mean_full": pn.rolling_full(F.avg, price, 4),
            "std_full": pn.rolling_full(F.stddev_samp, price, 4),
            "sum_full": pn.rolling_full(F.sum, price, 3),
        },
        back=3,
    )
    return tidy(done.rows().drop("o_orderdate", "o_totalprice"), 4)


def _lag_change(spark, folder, key="o_custkey", hot_rows=HOT_ROWS):
    price = F.col("o_totalprice")
    done = _ordered(spark, folder, key, hot_rows).nearby(
        {
            "change": lambda w: price - F.lag("o_totalprice").over(w),
            "first_zero": lambda w: price - F.coalesce(F.lag("o_totalprice").over(w), price),
            "two_back": lambda w: F.lag("o_totalprice", 2, 0.0).over(w),
        },
        back=2,
    )
    return tidy(done.rows().drop("o_orderdate", "o_totalprice"), 4)


def _streak(spark, folder, key="o_custkey", hot_rows=HOT_ROWS):
    big = F.col("o_totalprice") > 150000.0
    rows = _orders(spark, folder)
    flagged = lb.with_streak(rows, [key], ORDER_BY, big, 3, "streak", hot_rows=hot_rows)
    return flagged.groupBy(key).agg(
        F.max("streak").cast("long").alias("has_streak"), F.sum("streak").alias("streak_rows")
    )


def _rank_within_group(spark, folder, hot_rows=HOT_ROWS):
    rows = _lines(spark, folder).select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity")
    names = {"rank": "rank_in_flag", "dense_rank": "dense_in_flag"}
    return ranking.with_value_ranks(
        rows, "-l_quantity", names, keys=["l_returnflag"], hot_rows=hot_rows
    )


def _percent_rank(spark, folder, hot_rows=HOT_ROWS):
    rows = _lines(spark, folder).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    names = {"percent_rank": "price_percentile", "rank": "price_rank"}
    return tidy(ranking.with_value_ranks(rows, "-l_extendedprice", names, hot_rows=hot_rows))


def _ntile(spark, folder, groups=7, hot_rows=HOT_ROWS):
    rows = _orders(spark, folder).select("o_orderkey", "o_totalprice")
    order = ["-o_totalprice", "o_orderkey"]
    return ranking.ntile(rows, groups, order, "bucket", hot_rows=hot_rows)


def _row_number(spark, folder):
    rows = _orders(spark, folder).select("o_orderkey", "o_orderdate")
    done = OrderedRows(rows, [], ["o_orderdate", "-o_orderkey"], hot_rows=SPLIT_ROWS)
    return done.position("rn").rows().select("o_orderkey", "rn")


def _look_ahead_split(spark, folder):
    done = _ordered(spark, folder, "o_orderpriority", SPLIT_ROWS).nearby(
        {
            "before": lambda w: F.lag("o_totalprice", 3).over(w),
            "after": lambda w: F.lead("o_totalprice", 2).over(w),
        },
        back=3,
        ahead=2,
    )
    return done.rows().drop("o_orderdate", "o_totalprice")


def _whole_split(spark, folder):
    price = F.col("o_totalprice")
    done = _ordered(spark, folder, "o_orderpriority", SPLIT_ROWS).position("place")
    done = done.whole({"group_n": F.count(F.lit(1)), "group_sum": F.sum(price)})
    return tidy(done.rows().drop("o_orderdate", "o_totalprice"), 2)


def _drawdown_split(spark, folder):
    """Wealth that moves with the order value, its peak so far, and the fall from the peak."""
    move = 1 + (F.col("o_totalprice") - 150_000.0) / 73_180_319
    done = _ordered(spark, folder, "o_orderpriority", SPLIT_ROWS)
    done = done.running({"wealth": ("product", move)})
    done = done.running({"peak": ("max", F.col("wealth"))})
    done = done.with_columns({"drawdown": F.col("wealth") / F.col("peak") - 1})
    return tidy(done.rows().drop("o_orderdate", "o_totalprice"), 6)


def _lookup_split(keys, hot_rows):
    """Lines with the line count of their key, by a join that spreads keys above ``hot_rows``."""

    def run(spark, folder):
        lines = _lines(spark, folder)
        names = {k: f"of_{k}" for k in keys}
        counts = lines.groupBy(*[F.col(k).alias(n) for k, n in names.items()])
        table = counts.agg(F.count(F.lit(1)).alias("lines_of_key"))
        columns = dict.fromkeys(["l_orderkey", "l_linenumber", *keys])
        joined = lookup_join(lines.select(*columns), table, names, hot_rows=hot_rows)
        return joined.drop(*names.values())

    return run


def _two_ended(spark, folder):
    rows = _customers(spark, folder).select("c_custkey", "c_acctbal")
    return ranking.two_ended_top(rows, "c_acctbal", "c_custkey", 12, 8)


def _business_order(spark, folder):
    loans = src.loans(spark, folder)
    place = e.order_rank("loan_status", fv.STATUS_ORDER).cast("long")
    return loans.groupBy("loan_status", place.alias("place")).agg(F.count("*").alias("n"))


BLOCKS: dict[str, Query] = {
    "book_sums": _book_sums,
    "stored_collections_split": _stored_collections,
    "stored_defaults_split": _stored_defaults,
    "csv_round_trip": _csv_round_trip,
    "csv_rejects": _csv_rejects,
    "published_read_back": _published,
    "distinct_by_month": _distinct_by_month,
    "rolling_months": _rolling_months,
    "band_count": _band_count,
    "tier_count": _tier_count,
    "business_order": _business_order,
    "conditional_rate": _conditional_rate,
    "value_rate": _value_rate,
    "pivot_counts": _pivot_counts,
    "share_of_total": _share_of_total,
    "hhi": _hhi,
    "top_k_share": _top_k_share,
    "string_agg_sorted": _string_list,
    "running_total": _running,
    "rolling_windows": _rolling,
    "lag_change": _lag_change,
    "streak": _streak,
    "rank_within_group": _rank_within_group,
    "percent_rank_scaled": _percent_rank,
    "ntile_scaled": _ntile,
    "row_number_scaled": _row_number,
    "two_ended_top": _two_ended,
}

# the same steps where groups are divided: the way that hot keys take at scale
BY_PRIORITY = {"key": "o_orderpriority", "hot_rows": SPLIT_ROWS}
BLOCKS |= {
    "rolling_months_split": partial(_rolling_months, **BY_PRIORITY),
    "running_total_split": partial(_running, **BY_PRIORITY),
    "rolling_windows_split": partial(_rolling, **BY_PRIORITY),
    "lag_change_split": partial(_lag_change, **BY_PRIORITY),
    "streak_split": partial(_streak, **BY_PRIORITY),
    "look_ahead_split": _look_ahead_split,
    "whole_group_split": _whole_split,
    "drawdown_split": _drawdown_split,
    "rank_within_group_split": partial(_rank_within_group, hot_rows=20),
    "percent_rank_split": partial(_percent_rank, hot_rows=SPLIT_ROWS),
    "ntile_many_split": partial(_ntile, groups=300, hot_rows=SPLIT_ROWS),
    "lookup_by_value_split": _lookup_split(["l_returnflag"], SPLIT_ROWS),
    "lookup_by_tuple_split": _lookup_split(["l_returnflag", "l_linestatus"], SPLIT_ROWS),
    "lookup_by_join_split": _lookup_split(["l_quantity"], 1_000),
    "lookup_by_staged_keys_split": _lookup_split(["l_partkey"], 20),
}

# -- panels --------------------------------------------------------------------------------


def event_panel(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Hourly returns per event type, and the calendar length that bounds each series."""
    prices = stage(src.event_prices(spark, folder), "event-prices")
    calendar = pn.calendar_of(prices, step="1 hour")
    returns = pn.log_returns(pn.densify(prices, calendar), bound=calendar.length)
    return stage(returns, "event-returns"), calendar.length


def order_panel(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Weekly returns per nation, and the calendar length that bounds each series."""
    prices = stage(src.order_prices(spark, folder), "order-prices")
    calendar = pn.calendar_of(prices, step="7 days")
    return pn.log_returns(pn.densify(prices, calendar), bound=calendar.length), calendar.length


def _calendar(spark, folder):
    prices = stage(src.order_prices(spark, folder), "order-prices")
    return tidy(pn.densify(prices, pn.calendar_of(prices)), 2)


def _calendar_last(spark, folder):
    """Order values off the grid and several a day, put onto weeks that begin on Sundays."""
    prices = _orders(spark, folder).select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").alias("price"),
    )
    calendar = pn.calendar_of(prices, anchor="2024-01-07")
    return tidy(pn.densify(prices, calendar), 2)


def _event_returns(spark, folder):
    return tidy(event_panel(spark, folder)[0])


def _order_returns(spark, folder):
    return tidy(order_panel(spark, folder)[0])


def _lags(spark, folder):
    returns, bound = order_panel(spark, folder)
    return tidy(pn.lagged(returns, [1, 2, 3, 4], bound=bound))


def _cross_section(spark, folder):
    return tidy(pn.cross_section(order_panel(spark, folder)[0]))


def _own_features(spark, folder):
    returns, bound = order_panel(spark, folder)
    return tidy(pn.own_features(returns, bound=bound).drop("ret"))


def event_features(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str], int]:
    returns, bound = event_panel(spark, folder)
    suppliers = [s for s in _listed(returns, "symbol") if s not in EVENT_TARGETS]
    rows = pn.make_features(returns, EVENT_TARGETS, suppliers, lags=[0, 1, 2, 3], bound=bound)
    return rows, pn.feature_names(suppliers, [0, 1, 2, 3]), bound


def order_features(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str], int]:
    returns, bound = order_panel(spark, folder)
    returns = stage(returns, "order-returns")
    nations = _listed(returns, "symbol")
    rows = pn.make_features(returns, nations, nations, bound=bound)
    return rows, pn.feature_names(nations), bound


def _features(build):
    return lambda spark, folder: tidy(build(spark, folder)[0])


def _split(spark, folder):
    rows, _, bound = order_features(spark, folder)
    return tidy(pn.chrono_split(rows.select("target", "date", "label"), bound=bound))


def standard_rows(build, spark, folder) -> tuple[DataFrame, list[str]]:
    """Feature rows split by date and scaled with training statistics."""
    rows, names, bound = build(spark, folder)
    rows = stage(pn.chrono_split(rows, bound=bound), "features")
    return pn.standardise(rows, names), names


def _standardise(spark, folder):
    return tidy(standard_rows(event_features, spark, folder)[0], 6)


PANELS: dict[str, Query] = {
    "calendar_densify": _calendar,
    "calendar_last_price": _calendar_last,
    "log_returns_events": _event_returns,
    "log_returns_orders": _order_returns,
    "lag_features": _lags,
    "cross_section_stats": _cross_section,
    "own_features": _own_features,
    "features_events": _features(event_features),
    "features_orders": _features(order_features),
    "chrono_split": _split,
    "standardise": _standardise,
}

# -- backtests of two rule-based forecasts -------------------------------------------------

RULES = {"short trend": "ma4", "long trend": "ma13"}


def rule_predictions(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """Test rows of every nation with its short and its long mean return as forecasts."""
    returns, bound = order_panel(spark, folder)
    rows = pn.own_features(returns, bound=bound).withColumnRenamed("symbol", "target")
    rows = rows.na.drop(subset=["label", *pn.OWN_FEATURES])
    test = pn.chrono_split(rows, bound=bound).where(~F.col("is_train"))
    unit = F.lit(RETURN_UNIT)
    rule = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("model"), (F.col(c) * unit).alias("pred"))
                for m, c in RULES.items()
            ]
        )
    )
    test = test.withColumn("r", rule).withColumn("actual", F.col("label") * unit)
    return test.select("r.model", "target", "date", "r.pred", "actual"), bound


def _curves(spark, folder, **options):
    predictions, bound = rule_predictions(spark, folder)
    return bt.backtest(predictions, bound=bound, **options)


def _positions(sizing):
    def run(spark, folder):
        predictions, bound = rule_predictions(spark, folder)
        done = bt.positions(predictions, sizing=sizing, bound=bound).rows()
        return tidy(done.select(*bt.SERIES, "date", "pos", "side", "turnover", "cost", "strat"))

    return run


def _curve_columns(*columns, **options):
    return lambda spark, folder: tidy(
        _curves(spark, folder, **options).select(*bt.SERIES, "date", *columns)
    )


def _on_curves(report, digits=8):
    return lambda spark, folder: tidy(report(_curves(spark, folder)), digits)


def _on_predictions(report):
    return lambda spark, folder: tidy(report(rule_predictions(spark, folder)[0]))


def _model_summary(spark, folder):
    predictions, bound = rule_predictions(spark, folder)
    staged = stage(predictions, "predictions")
    return bt.model_summary(staged, bt.backtest(staged, bound=bound))


def _comparison(spark, folder):
    return tidy(bt.metric_comparison(_model_summary(spark, folder), list(RULES)))


BACKTESTS: dict[str, Query] = {
    "bt_positions": _positions("full"),
    "bt_positions_expanding": _positions("expanding"),
    "bt_curves": _curve_columns("strat", "wealth", "bnh_wealth", "cum", "bnh"),
    "bt_rescaled": _curve_columns("strat", "cum", rescale_to={"short trend": 0.05}),
    "bt_summary": _on_curves(bt.backtest_summary),
    "bt_curve_table": _on_curves(bt.curve_table, 6),
    "forecast_metrics": _on_predictions(bt.forecast_metrics),
    "scatter_table": _on_predictions(bt.scatter_table),
    "axis_limits": _on_predictions(bt.axis_limits),
    "rolling_sharpe": _on_curves(bt.rolling_sharpe_table, 6),
    "drawdown": _on_curves(bt.drawdown_table, 6),
    "model_summary": lambda spark, folder: tidy(_model_summary(spark, folder)),
    "metric_comparison": _comparison,
}

# -- fitted models (no SQL counterpart) ----------------------------------------------------


def _fit(names, build=event_features):
    def run(spark, folder):
        rows, features = standard_rows(build, spark, folder)
        rows = stage(rows, "standardised")
        return ml.fit_models(rows, features, names)

    return run


def _forecasts(name, digits=8):
    fitted = _fit([name])
    return lambda spark, folder: tidy(fitted(spark, folder).predictions, digits)


def _coef_top(spark, folder):
    fit = _fit([ml.ELASTIC_NET])(spark, folder)
    return tidy(ml.top_coefficients(ml.coefficients(fit, spark)), 6)


def _many(build):
    """Training rows of all targets, their fits, and all rows."""

    def run(spark, folder):
        rows, features = standard_rows(build, spark, folder)
        rows = stage(rows, "standardised")
        train = rows.where("is_train")
        fits = stage(mt.fit_many_targets(train, features, max_iter=MANY_SWEEPS), "fits")
        return rows, features, fits

    return run


def _many_coefficients(build):
    def run(spark, folder):
        _, features, fits = _many(build)(spark, folder)
        return tidy(mt.coefficient_rows(fits, features), 6)

    return run


def _many_forecasts(build):
    def run(spark, folder):
        rows, features, fits = _many(build)(spark, folder)
        done = mt.predict_many(rows.where(~F.col("is_train")), fits, features)
        return tidy(done.select("target", "date", "pred", F.col("label").alias("actual")), 6)

    return run


def _fitted_summary(spark, folder):
    fit = _fit(ml.MODEL_ORDER)(spark, folder)
    staged = stage(fit.predictions, "predictions")
    return tidy(bt.model_summary(staged, bt.backtest(staged)))


def _fitted_facts(spark, folder):
    """What must hold of any forecasts: rows, outcomes, and no forecast far outside the known labels."""
    rows, features = standard_rows(event_features, spark, folder)
    rows = stage(rows, "standardised")
    fit = ml.fit_models(rows, features, ml.MODEL_ORDER, rounds=20, trees=20)
    known = rows.where("is_train").groupBy("target").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    room = F.when(F.col("model").isin(ml.TREE, ml.FOREST), 0.0).otherwise(F.col("hi") - F.col("lo"))
    inside = F.col("pred").between(F.col("lo") - room - 1e-9, F.col("hi") + room + 1e-9)
    done = fit.predictions.join(known, "target").groupBy("model", "target")
    return tidy(
        done.agg(
            F.count("*").alias("n"),
            F.sum("actual").alias("actual_sum"),
            F.min("date").alias("first_day"),
            F.count_if(inside).alias("n_inside"),
        ),
        6,
    )


MODELS: dict[str, Query] = {
    "fitted_model_facts": _fitted_facts,
    "fit_elastic_net": _forecasts(ml.ELASTIC_NET, 6),
    "fit_tree": _forecasts(ml.TREE),
    "fit_gbt": _forecasts(ml.BOOSTING),
    "fit_forest": _forecasts(ml.FOREST),
    "coef_top": _coef_top,
    "fit_many_targets": _many_coefficients(order_features),
    "predict_many_targets": _many_forecasts(order_features),
    "fitted_model_summary": _fitted_summary,
}

QUERIES: dict[str, Query] = {**REPORTS, **BLOCKS, **PANELS, **BACKTESTS, **MODELS}
