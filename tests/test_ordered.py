"""The split form of ordered windows must give what the plain form and brute force give."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.operators.ordered import OrderedRows
from riskloom.operators.skew import lookup_join, measure
from riskloom.plans.loan_book import with_streak
from riskloom.plans.panel import rolling_full


def skewed(n=300, seed=3):
    """Half of the rows in one group, some in a NULL group, the others spread out."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c", "d"], n)).astype(object)
    key[rng.random(n) < 0.15] = None
    value = rng.normal(size=n).round(3)
    value[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"k": key, "t": rng.permutation(n), "v": value})


def frame(spark, pdf):
    rows = [
        (r.k, int(r.t), None if math.isnan(r.v) else float(r.v)) for r in pdf.itertuples(index=False)
    ]
    return spark.createDataFrame(rows, "k string, t long, v double").repartition(5)


def steps(rows: OrderedRows) -> OrderedRows:
    v = F.col("v")
    return (
        rows.position("rn")
        .whole({"top": F.max("v"), "n": F.count(F.lit(1))})
        .running(
            {
                "total": ("sum", v),
                "seen": ("count", v),
                "high": ("max", v),
                "low": ("min", v),
                "growth": ("product", F.lit(1.0) + v / 10),
            }
        )
        .nearby(
            {
                "mean3": lambda w: F.avg(v).over(w.rowsBetween(-2, 0)),
                "full4": rolling_full(F.avg, v, 4),
                "std4": rolling_full(F.stddev_samp, v, 4),
                "lag2": lambda w: F.lag("t", 2, -1).over(w),
                "next1": lambda w: F.lead("t", 1).over(w),
            },
            back=3,
            ahead=1,
        )
        .with_columns({"double_rn": F.col("rn") * 2})
    )


def table(df):
    out = df.toPandas().sort_values("t").reset_index(drop=True)
    return out[sorted(out.columns)]


@pytest.mark.parametrize("hot_rows,order", [(1, ["t"]), (7, ["-t"]), (40, ["t"]), (100, ["-t"])])
def test_split_equals_plain(spark, hot_rows, order):
    df = frame(spark, skewed())
    plain = OrderedRows(df, ["k"], order)
    assert plain.hot is None
    split = OrderedRows(df, ["k"], order, hot_rows=hot_rows)
    assert split.hot is not None and split.groups >= 1
    pd.testing.assert_frame_equal(
        table(steps(split).rows()), table(steps(plain).rows()), check_exact=False, rtol=1e-12
    )


def test_whole_table_as_one_group(spark):
    df = frame(spark, skewed(200, 8))
    plain, split = OrderedRows(df, [], ["t"]), OrderedRows(df, [], ["t"], hot_rows=16)
    assert split.cold is None
    pd.testing.assert_frame_equal(
        table(steps(split).rows()), table(steps(plain).rows()), check_exact=False, rtol=1e-12
    )


def test_against_pandas(spark):
    pdf = skewed(400, 11)
    got = table(steps(OrderedRows(frame(spark, pdf), ["k"], ["t"], hot_rows=25)).rows())
    pdf = pdf.sort_values("t").reset_index(drop=True)
    by = pdf.assign(k=pdf.k.fillna("?")).groupby("k", sort=False)
    assert (got.rn == by.cumcount() + 1).all()
    want = by.v.transform(lambda s: s.rolling(4).mean())
    np.testing.assert_allclose(got.full4.astype(float), want, rtol=1e-9, atol=1e-12)
    want = by.v.transform(lambda s: s.rolling(4).std())
    np.testing.assert_allclose(got.std4.astype(float), want, rtol=1e-7, atol=1e-9)
    want = by.v.transform(lambda s: s.rolling(3, min_periods=1).mean())
    np.testing.assert_allclose(got.mean3.astype(float), want, rtol=1e-9, atol=1e-12)
    want = by.v.transform(lambda s: s.fillna(0).cumsum())
    seen = got.seen > 0
    np.testing.assert_allclose(got.total[seen], want[seen], rtol=1e-9, atol=1e-12)
    want = by.v.transform(lambda s: (1 + s.fillna(0) / 10).cumprod())
    np.testing.assert_allclose(got.growth[seen], want[seen], rtol=1e-9)


def test_depth_larger_than_block(spark):
    """A frame longer than a block still sees all its rows."""
    df = spark.range(60).select(F.lit("x").alias("k"), F.col("id").alias("t"))
    mean = {"m": lambda w: F.avg("t").over(w.rowsBetween(-19, 0))}
    got = OrderedRows(df, ["k"], ["t"], hot_rows=5).nearby(mean, back=19).rows().toPandas()
    want = pd.Series(range(60)).rolling(20, min_periods=1).mean()
    assert list(got.sort_values("t").m) == list(want)


def test_bound_skips_the_check(spark):
    df = frame(spark, skewed(50))
    assert OrderedRows(df, ["k"], ["t"], hot_rows=10, bound=10).hot is None


def test_empty_input(spark):
    df = frame(spark, skewed(20)).where("t < 0")
    for keys in (["k"], []):
        assert steps(OrderedRows(df, keys, ["t"], hot_rows=5)).rows().count() == 0
    assert measure(df, ["k"], 0).hot is None


def test_sizes_are_handed_on(spark):
    """One count serves several steps, also where the key has another name."""
    df = frame(spark, skewed())
    sizes = measure(df, ["k"], 40)
    renamed = df.withColumnRenamed("k", "key")
    split = OrderedRows(
        renamed, ["key"], ["t"], hot_rows=40, sizes=sizes.renamed({"k": "key"})
    ).position("rn")
    assert split.hot is not None
    numbered = split.rows()
    plain = OrderedRows(renamed, ["key"], ["t"]).position("rn").rows()
    assert numbered.exceptAll(plain).count() == 0
    again = OrderedRows(
        numbered.withColumnRenamed("key", "k"),
        ["k"],
        ["rn"],
        hot_rows=40,
        sizes=sizes,
        position="rn",
    )
    got = again.running({"total": ("sum", F.col("t"))}).rows().drop("rn")
    want = OrderedRows(df, ["k"], ["t"]).running({"total": ("sum", F.col("t"))}).rows()
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 300


@pytest.mark.parametrize("null_safe", [True, False])
@pytest.mark.parametrize("keys_on_driver", [0, 1000])
def test_lookup_join(spark, monkeypatch, null_safe, keys_on_driver):
    monkeypatch.setattr("riskloom.operators.skew.DRIVER_KEYS", keys_on_driver)
    df = frame(spark, skewed())
    table = spark.createDataFrame(
        [("hot", 1), ("a", 2), (None, 3), ("zzz", 4)], "name string, x int"
    )
    pairs = {"k": "name"}
    plain = lookup_join(df, table, pairs, null_safe=null_safe)
    split = lookup_join(df, table, pairs, null_safe=null_safe, hot_rows=20)
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0
    assert plain.where("x = 3").isEmpty() != null_safe


@settings(
    max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    flags=st.lists(st.booleans(), min_size=1, max_size=40),
    length=st.integers(1, 5),
    hot_rows=st.integers(1, 50),
)
def test_streak_property(spark, flags, length, hot_rows):
    rows = [(1, i, f) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "k int, t int, hit boolean")
    out = with_streak(df, ["k"], ["t"], F.col("hit"), length, "s", hot_rows=hot_rows)
    got = [r.s for r in out.orderBy("t").collect()]
    want = [int(i + 1 >= length and all(flags[i + 1 - length : i + 1])) for i in range(len(flags))]
    assert got == want


def test_streak_needs_enough_rows(spark):
    rows = [("a", i, d) for i, d in enumerate([5, 1, 2])]
    rows += [("b", i, d) for i, d in enumerate([5, 1, 0])]
    rows += [("c", i, d) for i, d in enumerate([5, 1])]
    df = spark.createDataFrame(rows, "loan string, n int, days int")
    out = with_streak(df, ["loan"], ["n"], F.col("days") > 0, 3, "s")
    got = {r.loan: r.m for r in out.groupBy("loan").agg(F.max("s").alias("m")).collect()}
    assert got == {"a": 1, "b": 0, "c": 0}
