import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.operators import ranking as rk
from riskloom.operators.shares import concentration, count_share, hhi, joined_text


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share one value; some values are NULL."""
    rng = np.random.default_rng(5)
    out = []
    for i in range(400):
        v = 7.0 if rng.random() < 0.33 else float(rng.integers(0, 60))
        out.append((i, "hot" if rng.random() < 0.6 else str(i % 3), None if i % 37 == 0 else v))
    return spark.createDataFrame(out, "id long, g string, v double").repartition(6).persist()


def same(a, b, *cols):
    x = a.select("id", *cols).orderBy("id").collect()
    y = b.select("id", *cols).orderBy("id").collect()
    assert x == y


@pytest.mark.parametrize("order", ["v", "-v"])
@pytest.mark.parametrize("hot_rows", [9, 10_000])
def test_value_ranks(rows, order, hot_rows):
    names = {"rank": "r", "dense_rank": "d", "percent_rank": "p"}
    key = F.col("v").desc() if order == "-v" else F.col("v").asc()
    for keys in ([], ["g"]):
        got = rk.with_value_ranks(rows, order, names, keys=keys, hot_rows=hot_rows)
        w = W.partitionBy(*keys).orderBy(key)
        want = rows.select(
            "*",
            F.rank().over(w).cast("long").alias("r"),
            F.dense_rank().over(w).cast("long").alias("d"),
            F.percent_rank().over(w).alias("p"),
        )
        same(got, want, "r", "d", "p")


@pytest.mark.parametrize("groups", [1, 4, 7, 300, 450])
@pytest.mark.parametrize("order", [["v", "id"], ["-v", "id"], ["g", "-v", "-id"]])
def test_ntile(rows, groups, order):
    by = rk.sort_columns(order)
    want = rows.withColumn("n", F.ntile(groups).over(W.orderBy(*by)).cast("long"))
    got = rk.ntile(rows, groups, order, "n", hot_rows=50)
    same(got, want, "n")
    sizes = [r["count"] for r in got.groupBy("n").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_row_number(rows):
    got = rk.row_number(rows, ["-v", "id"], "n", hot_rows=30)
    want = rows.withColumn("n", F.row_number().over(W.orderBy(F.desc("v"), "id")).cast("long"))
    same(got, want, "n")


def test_rows_at_returns_positions(rows):
    keys = rk.rows_at(rows, ["id"], lambda n: [1, 200, n])
    assert [k.id for k in keys] == [0, 199, 399]


def test_top_k_ties_are_decided(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(10)], "id int, v double").repartition(4)
    assert [r.id for r in rk.top_k(df, ["-v", "id"], 3).collect()] == [0, 1, 2]


def test_two_ended_keeps_repeats(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "f string, v double")
    got = [r.f for r in rk.two_ended_top(df, "v", "f", 2, 2).collect()]
    assert got == ["a", "b", "b", "c"]


def test_joined_text_sorted_with_repeats(spark):
    rows = [(1, "b"), (1, "a"), (1, "b"), (2, None), (2, "x"), (3, None)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(3)
    got = {r.k: r.s for r in joined_text(df, ["k"], "t", "s").collect()}
    assert got == {1: "a | b | b", 2: "x"}


def test_shares_add_up(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), ("b", 5.0), ("c", 2.0)], "k string, v double"
    )
    shares = [r.share for r in concentration(df, "k", "v").collect()]
    assert abs(sum(shares) - 100) < 1e-9
    assert hhi(df, "k", "v").first().hhi == pytest.approx(30**2 + 50**2 + 20**2)
    assert {r.k: r.pct for r in count_share(df, "k").collect()} == {"a": 50.0, "b": 25.0, "c": 25.0}
    one = df.where("k = 'a'")
    assert hhi(one, "k", "v").first().hhi == pytest.approx(10_000)


def test_zero_total_gives_null_share(spark):
    df = spark.createDataFrame([("a", 0.0)], "k string, v double")
    assert concentration(df, "k", "v").first().share is None
