"""Building blocks over the raw tables."""

from __future__ import annotations

from .loan_book import REPORTS, TABLES
from .text import rnd, with_tables

ORDERED = "(PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def full(agg: str, n: int) -> str:
    """Aggregate over n rows, NULL while there are fewer."""
    frame = f"OVER {ORDERED} ROWS {n - 1} PRECEDING)"
    return rnd(f"CASE WHEN COUNT(*) {frame} = {n} THEN {agg}(o_totalprice) {frame} END", 4)


BLOCKS = {
    "csv_round_trip": with_tables(
        TABLES,
        f"""
SELECT loan_status, COUNT(*) AS n, {rnd('SUM(loan_amount)', 2)} AS amount,
       strftime(MIN(disbursal_date), '%Y-%m-%d') AS first_day,
       strftime(MAX(disbursal_date), '%Y-%m-%d') AS last_day
FROM l GROUP BY loan_status""",
    ),
    "band_count": """
SELECT CASE WHEN c_acctbal >= 7500 THEN 'top' WHEN c_acctbal >= 5000 THEN 'high'
            WHEN c_acctbal >= 2500 THEN 'middle' WHEN c_acctbal >= 0 THEN 'low'
            ELSE 'negative' END AS band, COUNT(*) AS n
FROM customer GROUP BY band""",
    "tier_count": """
SELECT ['C', 'B', 'A'][1 + CAST(o_totalprice >= 300000 AS INTEGER)
                         + CAST(o_orderpriority = '1-URGENT' AS INTEGER)] AS tier, COUNT(*) AS n
FROM orders GROUP BY tier""",
    "business_order": with_tables(
        TABLES,
        """
SELECT loan_status, CAST(list_position(['Active', '30 DPD', '60 DPD', '90+ DPD', 'NPA',
       'Written-Off'], loan_status) AS BIGINT) AS place, COUNT(*) AS n
FROM l GROUP BY loan_status""",
    ),
    "conditional_rate": f"""
SELECT l_linestatus, COUNT(*) FILTER (l_returnflag = 'R') AS n_hit,
       {rnd("100e0 * (COUNT(*) FILTER (l_returnflag = 'R')) / COUNT(*)", 4)} AS rate_pct
FROM lineitem GROUP BY ALL""",
    "value_rate": f"""
SELECT l_linestatus,
       {rnd("100e0 * (SUM(l_extendedprice) FILTER (l_returnflag = 'R')) / SUM(l_extendedprice)", 4)}
         AS value_rate_pct
FROM lineitem GROUP BY ALL""",
    "pivot_counts": """
SELECT o_orderpriority, COUNT(*) FILTER (o_orderstatus = 'F') AS "F",
       COUNT(*) FILTER (o_orderstatus = 'O') AS "O", COUNT(*) FILTER (o_orderstatus = 'P') AS "P"
FROM orders GROUP BY ALL""",
    "share_of_total": f"""
SELECT o_orderpriority, COUNT(*) AS n,
       {rnd('100e0 * COUNT(*) / (SELECT COUNT(*) FROM orders)', 4)} AS pct
FROM orders GROUP BY ALL""",
    "hhi": f"""
SELECT {rnd('SUM(s * s)', 6)} AS hhi
FROM (SELECT 100e0 * SUM(o_totalprice) / (SELECT SUM(o_totalprice) FROM orders) AS s
      FROM orders GROUP BY o_custkey)""",
    "top_k_share": f"""
SELECT o_custkey, {rnd('SUM(o_totalprice)', 2)} AS value,
       {rnd('100e0 * SUM(o_totalprice) / (SELECT SUM(o_totalprice) FROM orders)', 6)} AS pct
FROM orders GROUP BY o_custkey ORDER BY value DESC, o_custkey LIMIT 25""",
    "string_agg_sorted": """
SELECT o_custkey, string_agg(o_orderpriority, ' | ' ORDER BY o_orderpriority) AS listed
FROM orders GROUP BY o_custkey""",
    "running_total": f"""
SELECT o_orderkey, o_custkey,
       {rnd(f'SUM(o_totalprice) OVER {ORDERED} ROWS UNBOUNDED PRECEDING)', 4)} AS running_sum,
       {rnd(f'MAX(o_totalprice) OVER {ORDERED} ROWS UNBOUNDED PRECEDING)', 4)} AS running_max,
       COUNT(*) OVER {ORDERED} ROWS UNBOUNDED PRECEDING) AS n_so_far
FROM orders""",
    "rolling_windows": f"""
SELECT o_orderkey, o_custkey,
       {rnd(f'AVG(o_totalprice) OVER {ORDERED} ROWS 2 PRECEDING)', 4)} AS mean_partial,
       {full('AVG', 4)} AS mean_full, {full('STDDEV_SAMP', 4)} AS std_full,
       {full('SUM', 3)} AS sum_full
FROM orders""",
    "lag_change": f"""
SELECT o_orderkey, o_custkey,
       {rnd(f'o_totalprice - LAG(o_totalprice) OVER {ORDERED})', 4)} AS change,
       {rnd(f'o_totalprice - LAG(o_totalprice, 1, o_totalprice) OVER {ORDERED})', 4)} AS first_zero,
       {rnd(f'LAG(o_totalprice, 2, 0) OVER {ORDERED})', 4)} AS two_back
FROM orders""",
    "streak": f"""
WITH x AS (SELECT o_custkey, o_totalprice > 150000 AND LAG(o_totalprice) OVER {ORDERED}) > 150000
             AND LAG(o_totalprice, 2) OVER {ORDERED}) > 150000 AS hit FROM orders)
SELECT o_custkey, CAST(MAX(COALESCE(hit, FALSE)::INT) AS BIGINT) AS has_streak,
       COUNT(*) FILTER (hit) AS streak_rows
FROM x GROUP BY o_custkey""",
    "rank_within_group": """
SELECT l_orderkey, l_partkey, l_returnflag, l_quantity,
       RANK() OVER w AS rank_in_flag, DENSE_RANK() OVER w AS dense_in_flag
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC)""",
    "percent_rank_scaled": f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice,
       {rnd('PERCENT_RANK() OVER w', 8)} AS price_percentile, RANK() OVER w AS price_rank
FROM lineitem WINDOW w AS (ORDER BY l_extendedprice DESC)""",
    "ntile_scaled": """
SELECT o_orderkey, o_totalprice, NTILE(7) OVER (ORDER BY o_totalprice DESC, o_orderkey) AS bucket
FROM orders""",
    "row_number_scaled": """
SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey DESC) AS rn FROM orders""",
    "two_ended_top": """
(SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12)
UNION ALL
(SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 8)""",
}

# the divided forms: other groups, the same definitions
BY_PRIORITY = {
    f"{name}_split": BLOCKS[name].replace("o_custkey", "o_orderpriority")
    for name in ("running_total", "rolling_windows", "lag_change", "streak")
}
PRIORITY = "OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey"


def lines_of(*keys: str) -> str:
    names = ", ".join(keys)
    shown = ", ".join(dict.fromkeys(["l_orderkey", "l_linenumber", *keys]))
    return f"SELECT {shown}, COUNT(*) OVER (PARTITION BY {names}) AS lines_of_key FROM lineitem"


BLOCKS |= {
    **BY_PRIORITY,
    "look_ahead_split": f"""
SELECT o_orderkey, o_orderpriority, LAG(o_totalprice, 3) {PRIORITY}) AS before,
       LEAD(o_totalprice, 2) {PRIORITY}) AS after
FROM orders""",
    "whole_group_split": f"""
SELECT o_orderkey, o_orderpriority, ROW_NUMBER() {PRIORITY}) AS place,
       COUNT(*) OVER (PARTITION BY o_orderpriority) AS group_n,
       {rnd('SUM(o_totalprice) OVER (PARTITION BY o_orderpriority)', 2)} AS group_sum
FROM orders""",
    "drawdown_split": f"""
WITH x AS (SELECT *, PRODUCT(1 + (o_totalprice - 150000e0) / 73180319)
                         {PRIORITY} ROWS UNBOUNDED PRECEDING) AS w FROM orders),
     y AS (SELECT *, MAX(w) {PRIORITY} ROWS UNBOUNDED PRECEDING) AS p FROM x)
SELECT o_orderkey, o_orderpriority, {rnd('w', 6)} AS wealth, {rnd('p', 6)} AS peak,
       {rnd('w / p - 1', 6)} AS drawdown
FROM y""",
    "rank_within_group_split": BLOCKS["rank_within_group"],
    "percent_rank_split": BLOCKS["percent_rank_scaled"],
    "ntile_many_split": BLOCKS["ntile_scaled"].replace("NTILE(7)", "NTILE(300)"),
    "lookup_by_value_split": lines_of("l_returnflag"),
    "lookup_by_tuple_split": lines_of("l_returnflag", "l_linestatus"),
    "lookup_by_join_split": lines_of("l_quantity"),
    "lookup_by_staged_keys_split": lines_of("l_partkey"),
}

MONTH = "(year(o_orderdate) * 12 + month(o_orderdate) - 1)"


def months(key: str) -> str:
    frame = f"OVER (PARTITION BY {key} ORDER BY {MONTH} RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)"
    return f"""
SELECT o_orderkey, {key}, {MONTH}::INT AS month, {rnd(f'SUM(o_totalprice) {frame}', 2)} AS sum_3,
       COUNT(o_totalprice) {frame} AS n_3, {rnd(f'MAX(o_totalprice) {frame}', 2)} AS max_3
FROM orders"""


BLOCKS |= {
    "rolling_months": months("o_custkey"),
    "rolling_months_split": months("o_orderpriority"),
    "csv_rejects": """
SELECT CASE WHEN o_orderkey % 33 = 0 THEN 'number of columns'
            WHEN o_orderkey % 150 = 0 THEN 'price, day' WHEN o_orderkey % 50 = 0 THEN 'price'
            WHEN o_orderkey % 75 = 0 THEN 'day' ELSE 'read' END AS outcome,
       COUNT(*) AS n, SUM(o_orderkey)::BIGINT AS keys
FROM orders GROUP BY outcome""",
    "published_read_back": """
SELECT o_orderstatus, o_orderpriority, COUNT(*) * CASE WHEN o_orderstatus = 'O' THEN 10 ELSE 1 END AS n
FROM orders GROUP BY o_orderstatus, o_orderpriority""",
    "distinct_by_month": f"""
WITH o AS (SELECT DISTINCT o_custkey, {MONTH}::INT AS month FROM orders)
SELECT m.month, COUNT(DISTINCT CASE WHEN o.month = m.month THEN o_custkey END) AS customers,
       COUNT(DISTINCT o_custkey) AS half_year, 1::BIGINT AS close, 1::BIGINT AS half_close
FROM (SELECT DISTINCT month FROM o) m JOIN o ON o.month BETWEEN m.month - 5 AND m.month
GROUP BY m.month""",
}

# both groupings of the pass that feeds the reports of sums
BLOCKS["book_sums"] = with_tables(
    TABLES,
    f"""
SELECT IF(GROUPING(customer_id) = 1, 'kind', 'borrower') AS sums_by, loan_purpose, loan_status,
       strftime(month_of, '%Y-%m') AS month, customer_id, year_of AS year,
       COUNT(*) AS n, COUNT(*) FILTER (bad) AS n_bad,
       {rnd('SUM(loan_amount)', 4)} AS amount_sum, COUNT(loan_amount) AS amount_n,
       {rnd('SUM(interest_rate)', 4)} AS rate_sum, COUNT(interest_rate) AS rate_n,
       {rnd('SUM(outstanding_balance)', 4)} AS balance_sum, COUNT(outstanding_balance) AS balance_n,
       {rnd('SUM(IF(bad, outstanding_balance, 0e0))', 4)} AS bad_balance
FROM (SELECT *, date_trunc('month', disbursal_date) AS month_of, year(disbursal_date) AS year_of FROM l)
GROUP BY GROUPING SETS ((loan_purpose, loan_status, month_of), (customer_id, year_of))""",
)

# the same reports from tables stored by loan, long loans apart
BLOCKS["stored_collections_split"] = REPORTS["q10_cumulative_collections"]
BLOCKS["stored_defaults_split"] = REPORTS["q18_early_defaults"]
