"""Loan-book reports, written over three views of the shared tables."""

from __future__ import annotations

from .text import rnd, rnd_decimal, with_tables

TABLES = {
    "b": """
      SELECT c_custkey AS customer_id, c_name AS name, n_name AS state,
             c_mktsegment AS employment_type,
             CAST(21 + c_custkey % 45 AS INTEGER) AS age,
             CAST(150000 + (c_custkey * 7919) % 1350000 AS DOUBLE) AS annual_income,
             CAST(FLOOR(300e0 + (c_acctbal + 1000e0) * 600e0 / 11000e0) AS INTEGER) AS credit_score,
             CAST(c_custkey % 5 AS INTEGER) AS existing_loans_count
      FROM customer INNER JOIN nation ON n_nationkey = c_nationkey""",
    "l0": """
      SELECT o_orderkey AS loan_id, o_custkey AS customer_id, o_orderpriority AS loan_purpose,
             o_totalprice AS loan_amount, CAST(o_orderdate AS DATE) AS disbursal_date,
             o_totalprice * (2e-1 + (o_orderkey % 8) / 1e1) AS outstanding_balance,
             6e0 + (o_orderkey % 120) / 1e1 AS interest_rate,
             o_totalprice / 12e0 AS emi_amount,
             CASE o_orderstatus
               WHEN 'O' THEN 'Active'
               WHEN 'P' THEN ['90+ DPD', '30 DPD', '60 DPD'][o_orderkey % 3 + 1]
               ELSE ['Written-Off', 'NPA', 'Active', 'Active'][o_orderkey % 4 + 1]
             END AS loan_status
      FROM orders""",
    "l": "SELECT *, loan_status = 'NPA' OR loan_status = 'Written-Off' AS bad FROM l0",
    "r": """
      SELECT l_orderkey AS loan_id, o_custkey AS customer_id, CAST(l_shipdate AS DATE) AS paid_on,
             l_extendedprice * (1e0 - l_discount) AS amount_paid, l_extendedprice AS emi_due,
             GREATEST(0, CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE)) AS days_late,
             ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber,
                                l_partkey, l_suppkey, l_extendedprice) AS seq
      FROM lineitem INNER JOIN orders ON o_orderkey = l_orderkey""",
    "lb": "SELECT * FROM l INNER JOIN b USING (customer_id)",
}

BAD_PCT = rnd("100e0 * (COUNT(*) FILTER (bad)) / COUNT(*)", 2)
DTI = "emi_amount * 12 / NULLIF(annual_income, 0)"


def q(body: str) -> str:
    return with_tables(TABLES, body)


REPORTS = {
    "q01_portfolio_summary": q(f"""
SELECT COUNT(loan_id) AS total_loans, COUNT(DISTINCT customer_id) AS unique_borrowers,
       {rnd('SUM(loan_amount) / 1e7', 2)} AS total_disbursed_cr,
       {rnd('SUM(outstanding_balance) / 1e7', 2)} AS total_outstanding_cr,
       {rnd('AVG(loan_amount)', 0)} AS avg_loan_amount,
       {rnd('AVG(credit_score)', 1)} AS avg_credit_score,
       {rnd('AVG(interest_rate)', 2)} AS avg_interest_rate
FROM lb"""),
    "q02_breakdown_by_purpose": with_tables(
        {
            **TABLES,
            "g": """SELECT loan_purpose, COUNT(*) AS loan_count, SUM(loan_amount) AS amount,
                    AVG(loan_amount) AS ticket, AVG(interest_rate) AS rate FROM l GROUP BY ALL""",
        },
        f"""
SELECT loan_purpose, loan_count,
       {rnd('loan_count * 100e0 / (SELECT COUNT(*) FROM l)', 1)} AS pct_of_portfolio,
       {rnd('amount / 1e7', 2)} AS disbursed_cr, {rnd('ticket', 0)} AS avg_ticket_size,
       {rnd('rate', 2)} AS avg_rate
FROM g""",
    ),
    "q03_breakdown_by_status": q(f"""
SELECT loan_status, COUNT(*) AS count,
       {rnd('COUNT(*) * 100e0 / (SELECT COUNT(*) FROM l)', 2)} AS pct,
       {rnd('SUM(outstanding_balance) / 1e7', 2)} AS outstanding_cr,
       {rnd('AVG(outstanding_balance)', 0)} AS avg_outstanding
FROM l GROUP BY ALL"""),
    "q04_npa_by_purpose": q(f"""
SELECT loan_purpose, COUNT(*) AS total_loans, COUNT(*) FILTER (bad) AS npa_count,
       {BAD_PCT} AS gross_npa_pct,
       {rnd('100e0 * (SUM(outstanding_balance) FILTER (bad)) / SUM(outstanding_balance)', 2)}
         AS npa_by_value_pct
FROM l GROUP BY ALL"""),
    "q05_status_matrix": q("""
SELECT loan_purpose,
       COUNT(*) FILTER (loan_status = 'Active') AS active,
       COUNT(*) FILTER (loan_status = '30 DPD') AS dpd_30,
       COUNT(*) FILTER (loan_status = '60 DPD') AS dpd_60,
       COUNT(*) FILTER (loan_status = '90+ DPD') AS dpd_90_plus,
       COUNT(*) FILTER (loan_status = 'NPA') AS npa,
       COUNT(*) FILTER (loan_status = 'Written-Off') AS written_off
FROM l GROUP BY ALL"""),
    "q06_npa_by_score_band": q(f"""
SELECT CASE WHEN credit_score >= 750 THEN '750+ (Excellent)'
            WHEN credit_score >= 700 THEN '700-749 (Very Good)'
            WHEN credit_score >= 600 THEN '600-699 (Good)'
            WHEN credit_score >= 500 THEN '500-599 (Fair)'
            ELSE '300-499 (Poor)' END AS credit_band,
       COUNT(*) AS loans, {rnd('AVG(credit_score)', 0)} AS avg_score,
       {BAD_PCT} AS npa_rate_pct, {rnd('AVG(loan_amount)', 0)} AS avg_loan_amount
FROM lb GROUP BY credit_band"""),
    "q07_segment_report": q(f"""
SELECT CASE WHEN credit_score >= 720 AND annual_income >= 8e5 THEN 'P1 - Prime'
            WHEN credit_score >= 650 AND annual_income >= 4e5 THEN 'P2 - Near-Prime'
            WHEN credit_score >= 550 AND annual_income >= 2e5 THEN 'P3 - Sub-Prime'
            ELSE 'P4 - Deep Sub-Prime' END AS risk_segment,
       COUNT(*) AS borrowers, {rnd('AVG(credit_score)', 0)} AS avg_credit_score,
       {rnd('AVG(annual_income)', 0)} AS avg_income, {BAD_PCT} AS npa_rate_pct,
       {rnd('SUM(outstanding_balance) / 1e7', 2)} AS outstanding_cr
FROM lb GROUP BY risk_segment"""),
    "q08_dti_report": with_tables(
        {**TABLES, "d": f"SELECT *, {DTI} AS dti FROM lb"},
        f"""
SELECT CASE WHEN dti >= 5e-1 OR dti IS NULL THEN '> 50% (Very High)'
            WHEN dti >= 35e-2 THEN '35-50% (High)'
            WHEN dti >= 2e-1 THEN '20-35% (Moderate)'
            ELSE '< 20% (Low Risk)' END AS dti_band,
       COUNT(*) AS loan_count, {BAD_PCT} AS npa_rate_pct,
       {rnd('AVG(loan_amount)', 0)} AS avg_loan_amount,
       {rnd('AVG(credit_score)', 0)} AS avg_credit_score
FROM d GROUP BY dti_band""",
    ),
    "q09_collection_trend": q(f"""
SELECT strftime(paid_on, '%Y-%m') AS month, COUNT(*) AS payments_made,
       {rnd('SUM(amount_paid) / 1e7', 3)} AS collection_cr,
       {rnd('SUM(emi_due) / 1e7', 3)} AS demand_cr,
       {rnd('100e0 * SUM(amount_paid) / SUM(emi_due)', 2)} AS collection_efficiency_pct,
       COUNT(*) FILTER (days_late > 0) AS late_payments
FROM r WHERE paid_on BETWEEN DATE '1990-01-01' AND DATE '2010-12-31' GROUP BY month"""),
    "q10_cumulative_collections": q(f"""
SELECT loan_id, CAST(seq AS INTEGER) AS payment_month,
       strftime(paid_on, '%Y-%m-%d') AS payment_date, {rnd('amount_paid', 6)} AS amount_paid,
       {rnd('SUM(amount_paid) OVER (w ROWS UNBOUNDED PRECEDING)', 6)} AS cumulative_collected,
       {rnd('AVG(amount_paid) OVER (w ROWS 2 PRECEDING)', 6)} AS rolling_3m_avg_payment
FROM r WINDOW w AS (PARTITION BY loan_id ORDER BY seq)"""),
    "q11_late_streak": with_tables(
        {
            **TABLES,
            "runs": """SELECT customer_id, loan_id, seq - ROW_NUMBER() OVER
                       (PARTITION BY loan_id ORDER BY seq) AS run FROM r WHERE days_late > 0""",
            "long_runs": """SELECT DISTINCT loan_id FROM
                            (SELECT loan_id, run FROM runs GROUP BY ALL HAVING COUNT(*) >= 3)""",
            "per_loan": """SELECT x.customer_id, x.loan_id, g.loan_id IS NOT NULL AS streak
                           FROM (SELECT DISTINCT customer_id, loan_id FROM r) x
                           LEFT JOIN long_runs g ON g.loan_id = x.loan_id""",
        },
        f"""
SELECT employment_type, COUNT(*) AS total_loans,
       COUNT(*) FILTER (streak) AS loans_with_consec_late,
       {rnd('100e0 * (COUNT(*) FILTER (streak)) / COUNT(*)', 2)} AS pct_with_consec_late
FROM per_loan INNER JOIN b USING (customer_id) GROUP BY ALL""",
    ),
    "q12_partial_payments": q(f"""
SELECT loan_purpose, COUNT(*) AS total_payments,
       COUNT(*) FILTER (amount_paid < emi_due * 95e-2) AS partial_payments,
       {rnd('100e0 * (COUNT(*) FILTER (amount_paid < emi_due * 95e-2)) / COUNT(*)', 2)}
         AS partial_pct,
       {rnd('SUM(CASE WHEN emi_due > amount_paid THEN emi_due - amount_paid ELSE 0 END) / 1e5', 2)}
         AS total_shortfall_lacs
FROM r INNER JOIN l USING (loan_id) GROUP BY ALL"""),
    "q13_state_report": with_tables(
        {
            **TABLES,
            "g": f"""SELECT state, COUNT(*) AS n, SUM(loan_amount) AS amount, {BAD_PCT} AS bad_pct,
                     AVG(credit_score) AS score, AVG(annual_income) / 1e5 AS income
                     FROM lb GROUP BY ALL""",
        },
        f"""
SELECT state, n AS total_loans, {rnd('amount / 1e7', 2)} AS disbursed_cr, bad_pct AS npa_rate_pct,
       {rnd('score', 0)} AS avg_credit_score, {rnd('income', 2)} AS avg_income_lacs,
       1 + (SELECT COUNT(*) FROM g AS other WHERE other.amount > g.amount) AS portfolio_rank
FROM g""",
    ),
    "q14_npa_by_age_group": q(f"""
SELECT CASE WHEN age >= 50 THEN '50+' WHEN age >= 40 THEN '40-49'
            WHEN age >= 30 THEN '30-39' ELSE '< 30' END AS age_group,
       COUNT(*) AS loans, {rnd('AVG(loan_amount)', 0)} AS avg_loan,
       {rnd('AVG(credit_score)', 0)} AS avg_score, {BAD_PCT} AS npa_rate_pct
FROM lb GROUP BY age_group"""),
    "q15_top_exposures": with_tables(
        {
            **TABLES,
            "g": """SELECT customer_id, COUNT(*) AS num_loans, SUM(outstanding_balance) AS exposure,
                    string_agg(loan_purpose, ' | ' ORDER BY loan_purpose) AS loan_types
                    FROM lb GROUP BY customer_id""",
        },
        f"""
SELECT customer_id, name, state, credit_score, num_loans,
       {rnd('exposure / 1e5', 2)} AS total_exposure_lacs,
       {rnd('100e0 * exposure / (SELECT SUM(exposure) FROM g)', 3)} AS pct_of_portfolio, loan_types
FROM g INNER JOIN b USING (customer_id)
ORDER BY total_exposure_lacs DESC, customer_id LIMIT 20""",
    ),
    "q16_purpose_hhi": with_tables(
        {
            **TABLES,
            "s": """SELECT loan_purpose, 100e0 * SUM(outstanding_balance)
                    / (SELECT SUM(outstanding_balance) FROM l) AS share FROM l GROUP BY ALL""",
        },
        f"""
SELECT loan_purpose, {rnd('share', 2)} AS share_pct, {rnd('share ** 2', 4)} AS hhi_contribution
FROM s
UNION ALL
SELECT 'TOTAL HHI INDEX', CAST(NULL AS DOUBLE), {rnd('SUM(share ** 2)', 2)} FROM s""",
    ),
    "q17_npa_by_vintage": q(f"""
SELECT strftime(disbursal_date, '%Y') AS vintage_year, COUNT(*) AS loans_disbursed,
       {rnd('SUM(loan_amount) / 1e7', 2)} AS disbursed_cr, COUNT(*) FILTER (bad) AS npas,
       {BAD_PCT} AS npa_rate_pct,
       {rnd('AVG(credit_score)', 0)} AS avg_credit_score_at_origination
FROM lb GROUP BY vintage_year"""),
    "q18_early_defaults": with_tables(
        {
            **TABLES,
            "f": "SELECT loan_id, MIN(seq) AS first_late FROM r WHERE days_late > 30 GROUP BY ALL",
        },
        f"""
SELECT CASE WHEN first_late > 4 THEN 'later' WHEN first_late > 2 THEN '3rd-4th payment'
            WHEN first_late = 2 THEN '2nd payment' ELSE '1st payment' END AS default_timing,
       COUNT(*) AS loan_count, {rnd('AVG(credit_score)', 0)} AS avg_credit_score,
       {rnd('AVG(annual_income)', 0)} AS avg_income, {rnd('AVG(loan_amount)', 0)} AS avg_loan_amount
FROM f INNER JOIN lb USING (loan_id) GROUP BY default_timing""",
    ),
    "q19_cohort_npa_change": with_tables(
        {
            **TABLES,
            "m": f"""SELECT strftime(disbursal_date, '%Y-%m') AS cohort_month, COUNT(*) AS total_loans,
                     COUNT(*) FILTER (bad) AS npa_loans, {BAD_PCT} AS npa_rate_pct
                     FROM l GROUP BY cohort_month""",
            "p": "SELECT *, LAG(npa_rate_pct) OVER (ORDER BY cohort_month) AS prior FROM m",
        },
        f"""
SELECT cohort_month, total_loans, npa_loans, npa_rate_pct, prior AS prev_month_npa_rate,
       {rnd('npa_rate_pct - prior', 2)} AS mom_change
FROM p""",
    ),
    "q20_exposure_ranking": with_tables(
        {
            **TABLES,
            "x": """SELECT *, NTILE(4) OVER by_score AS credit_quartile,
                    NTILE(4) OVER by_amount AS loan_size_quartile,
                    PERCENT_RANK() OVER (ORDER BY credit_score DESC) AS percentile,
                    DENSE_RANK() OVER (PARTITION BY loan_purpose ORDER BY loan_amount DESC) AS place
                    FROM lb
                    WINDOW by_score AS (ORDER BY credit_score DESC, loan_id),
                           by_amount AS (ORDER BY loan_amount DESC, loan_id)""",
        },
        f"""
SELECT customer_id, name, credit_score, annual_income, loan_amount, loan_status, credit_quartile,
       loan_size_quartile, {rnd('percentile', 8)} AS credit_score_percentile,
       place AS rank_within_product
FROM x ORDER BY credit_quartile, loan_size_quartile, loan_id LIMIT 50""",
    ),
    "q21_rolling_collections": with_tables(
        {
            **TABLES,
            "m": f"""SELECT loan_purpose, strftime(paid_on, '%Y-%m') AS payment_month_str,
                     {rnd('SUM(amount_paid) / 1e5', 2)} AS monthly_collection
                     FROM r INNER JOIN l USING (loan_id) GROUP BY loan_purpose, payment_month_str""",
        },
        f"""
SELECT loan_purpose, payment_month_str, monthly_collection,
       {rnd_decimal('AVG(monthly_collection) OVER (w ROWS 2 PRECEDING)', 2)} AS rolling_3m_avg
FROM m WINDOW w AS (PARTITION BY loan_purpose ORDER BY payment_month_str)""",
    ),
    "q22_expected_loss": with_tables(
        {
            **TABLES,
            "g": """SELECT loan_purpose, COUNT(*) AS loans, SUM(outstanding_balance) AS ead,
                    (COUNT(*) FILTER (bad)) / COUNT(*) AS pd,
                    IF(loan_purpose IN ('1-URGENT', '2-HIGH'), 6e-1, 4e-1) AS lgd
                    FROM l GROUP BY loan_purpose""",
        },
        f"""
SELECT loan_purpose, loans, {rnd('ead / 1e7', 2)} AS ead_cr, {rnd('pd', 4)} AS pd_estimate,
       lgd AS lgd_assumption, {rnd('ead * pd * lgd / 1e7', 4)} AS expected_loss_cr
FROM g""",
    ),
    "q23_watchlist": q(f"""
SELECT loan_id, name, credit_score, loan_purpose, {rnd('outstanding_balance', 8)} AS outstanding_balance,
       loan_status, existing_loans_count, {rnd(f'100e0 * {DTI}', 1)} AS dti_pct,
       CASE WHEN credit_score >= 620 THEN 'STANDARD MONITORING'
            WHEN credit_score < 550 AND existing_loans_count > 1
              THEN 'HIGH RISK - Watch Immediately'
            ELSE 'MODERATE RISK - Monitor Closely' END AS watch_flag
FROM lb WHERE credit_score < 650 AND loan_status IN ('30 DPD', '60 DPD')
ORDER BY watch_flag, credit_score, loan_id LIMIT 30"""),
}
