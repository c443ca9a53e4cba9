"""Every registered query against its SQL, and the shape of the plans."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import canonical, connect
from riskloom.operators.ordered import OrderedRows
from riskloom.operators.skew import measure
from riskloom.plans import catalogue
from riskloom.sources import shared_tables as src

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "ArrowEvalPython" not in text and "BatchEvalPython" not in text
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    rows = cursor.fetchall()
    want = canonical([d[0] for d in cursor.description], rows)
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert [repr(r) for r in got[1]] == [repr(r) for r in want[1]]


def test_only_tree_models_have_no_sql():
    missing = set(catalogue.QUERIES) - set(SQL)
    assert missing == {"fit_tree", "fit_gbt", "fit_forest", "fitted_model_summary"}
    assert not set(SQL) - set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 5


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_level_ranks_and_shares_need_no_window(spark):
    """Quartiles, percentiles and shares never move raw rows to one partition."""
    for name in ("ntile_scaled", "percent_rank_scaled", "share_of_total", "hhi", "q15_top_exposures"):
        assert "Window [" not in plan(QUERIES[name](spark, SMALL))


def test_scans_read_only_needed_columns(spark):
    text = plan(QUERIES["q04_npa_by_purpose"](spark, SMALL))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "o_orderkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderpriority",
    }


def test_filter_reaches_the_scan(spark):
    from riskloom.plans.loan_book import cumulative_collections
    from riskloom.sources.shared_tables import repayments

    rows = repayments(spark, SMALL, numbered=True)
    text = plan(cumulative_collections(rows, [1, 2, 3]))
    assert re.search(r"PushedFilters: \[[^\]]*In\(l_orderkey, \[1,2,3\]\)", text)


def test_cumulative_report_needs_one_exchange_after_numbering(spark):
    text = plan(QUERIES["q10_cumulative_collections"](spark, SMALL))
    assert len(re.findall(r"Exchange rangepartitioning", text)) == 1
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_split_entries_divide_their_groups(spark):
    """At the scale of the SQL check the entries named ..._split do take the divided way."""
    folder = "/root/testdata/sf0.01"
    lines = src.table(spark, folder, "lineitem")
    rows = catalogue._ordered(spark, folder, "o_orderpriority", catalogue.SPLIT_ROWS)
    assert rows.hot is not None and rows.hot.count() > catalogue.SPLIT_ROWS
    by_value = measure(lines, ["l_returnflag"], catalogue.SPLIT_ROWS).hot
    by_tuple = measure(lines, ["l_returnflag", "l_linestatus"], catalogue.SPLIT_ROWS).hot
    assert by_value.values and by_tuple.values
    by_join = measure(lines, ["l_quantity"], 1_000).hot
    staged = measure(lines, ["l_partkey"], 20).hot
    assert by_join.values is None and by_join.count <= 1_000 < staged.count


def test_orders_over_a_table_are_placed_at_any_size(spark):
    few = spark.createDataFrame([(3,), (1,), (2,)], "v int")
    for rows, want in ((few, [(1, 1), (2, 2), (3, 3)]), (few.where("v > 9"), [])):
        ordered = OrderedRows(rows, [], ["v"])
        assert ordered.cold is None
        assert sorted(tuple(r) for r in ordered.position("n").rows().collect()) == want
