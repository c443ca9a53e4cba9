"""Frames by value, mergeable distinct counts, rejected lines and results published at once."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators import by_value as bv
from riskloom.operators import distinct as dc
from riskloom.sources import files

COLUMNS = {
    "n": lambda w: F.count(F.lit(1)).over(w),
    "s": lambda w: F.sum("x").over(w),
    "top": lambda w: F.max("x").over(w),
}


def plain(rows, back, ahead):
    out = []
    for k, v, x in rows:
        near = [
            z for g, u, z in rows if g == k and (u is None if v is None else u is not None and v - back <= u <= v + ahead)
        ]
        seen = [z for z in near if z is not None]
        out.append((k, v, x, len(near), sum(seen) if seen else None, max(seen, default=None)))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, x int").repartition(4)


@pytest.mark.parametrize("back,ahead", [(2, 0), (0, 0), (3, 2), (0, 4), (500, 0)])
@pytest.mark.parametrize("hot_rows", [5, 40, 10_000])
def test_frames_equal_plain(spark, back, ahead, hot_rows):
    rng = random.Random(back * 7 + ahead)
    rows = [("hot", rng.choice([1, 2, 3, 40, 41, 300]) + rng.randrange(3), i) for i in range(60)]
    rows += [("gaps", i * 5, 1) for i in range(12)] + [("one", 7, None), (None, 3, 4), (None, 5, 4), ("hot", None, 5), ("hot", None, 6)]
    got = bv.within(table(spark, rows), ["k"], "v", COLUMNS, back=back, ahead=ahead, hot_rows=hot_rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, back, ahead)


def test_frames_without_keys_and_empty(spark):
    rows = [("a", i // 3, i) for i in range(50)]
    got = bv.within(table(spark, rows), [], "v", COLUMNS, back=1, hot_rows=8)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, 1, 0)
    assert bv.within(table(spark, rows).limit(0), ["k"], "v", COLUMNS, back=1).count() == 0
    with pytest.raises(ValueError):
        bv.within(table(spark, rows), ["k"], "v", COLUMNS, back=-1)


def test_missing_months_count(spark):
    """The quarter to April holds nothing of January, though it is the row before."""
    days = [date(2024, 1, 5), date(2024, 4, 5), date(2023, 12, 31)]
    df = spark.createDataFrame([(d, 1) for d in days], "d date, x int").withColumn("m", bv.month_number(F.col("d")))
    got = bv.within(df, [], "m", {"s": lambda w: F.sum("x").over(w)}, back=2)
    assert {(r.d.month, r.s) for r in got.collect()} == {(1, 2), (4, 1), (12, 1)}


def test_sketches_merge_to_what_one_sketch_says(spark):
    df = spark.range(60_000).select((F.col("id") % 12).alias("month"), (F.col("id") * 7919 % 20_011).alias("who"))
    parts = dc.distinct_sketches(df, ["month"], "who").persist()
    year = dc.merged(parts, []).select(dc.estimate("sketch")).first()[0]
    whole = dc.distinct_sketches(df, [], "who").select(dc.estimate("sketch")).first()[0]
    assert year == whole
    assert abs(whole - 20_011) <= 4 * dc.standard_error() * 20_011
    half = {r.month: r.e for r in dc.rolling_distinct(parts, [], "month", 5).select("month", dc.estimate("sketch").alias("e")).collect()}
    for month in (0, 3, 11):
        exact = df.where(F.col("month").between(month - 5, month)).select("who").distinct().count()
        assert abs(half[month] - exact) <= 4 * dc.standard_error() * exact + 1
    assert set(half) == set(range(12))


def test_few_values_are_exact_and_nulls_do_not_count(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 1)), ("a", date(2024, 1, 2)), ("a", None), ("b", None)], "k string, d date")
    got = {r.k: r.e for r in dc.distinct_sketches(df, ["k"], "d").select("k", dc.estimate("sketch").alias("e")).collect()}
    assert got == {"a": 2, "b": 0}


SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("amount", T.DoubleType()), T.StructField("day", T.DateType())]
)


def test_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,amount,day\n1,2.5,2024-01-02\nx,2.5,2024-01-02\n2,,\n3,1e3\n")
    (tmp_path / "b.csv").write_text('id,amount,day\n4,oops,someday\n5,"1",2024-02-30\n6,1,2024-02-28,more\n')
    good, rejects = files.read_csv_rejects(spark, str(tmp_path), SCHEMA)
    assert sorted(tuple(r) for r in good.collect()) == [(1, 2.5, date(2024, 1, 2)), (2, None, None)]
    got = {(r.file[-5:], r.line, r.reason) for r in rejects.collect()}
    assert got == {
        ("a.csv", "x,2.5,2024-01-02", "id"),
        ("a.csv", "3,1e3", "number of columns"),
        ("b.csv", "4,oops,someday", "amount, day"),
        ("b.csv", '5,"1",2024-02-30', "day"),
        ("b.csv", "6,1,2024-02-28,more", "number of columns"),
    }


def test_publish_shows_whole_results_only(spark, tmp_path):
    at = str(tmp_path / "result")
    with pytest.raises(FileNotFoundError):
        files.read_published(spark, at)
    first = spark.range(5).select("id", (F.col("id") % 2).alias("p"))
    files.publish(first, at)
    broken = spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("long").alias("id"), F.lit(0).cast("long").alias("p"))
    with pytest.raises(Exception, match="lost"):
        files.publish(broken.repartition(4), at)
    assert files.read_published(spark, at).count() == 5  # the old result is still shown
    files.publish(first.where("id < 2"), at)
    assert files.read_published(spark, at).count() == 2
    assert files.retire(spark, at) >= 1
    assert files.read_published(spark, at).count() == 2


def test_publish_replaces_only_its_partitions(spark, tmp_path):
    at = str(tmp_path / "parts")
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("null", 4)], "p string, x int")
    one = files.publish(rows, at, partition="p")
    files.publish(spark.createDataFrame([("b", 20), ("c", 30)], "p string, x int"), at, partition="p")
    shown = {(r.p, r.x) for r in files.read_published(spark, at).collect()}
    assert shown == {("a", 1), ("b", 20), ("c", 30), (None, 3), ("null", 4)}
    assert files.published(spark, at)["=a"] == one
    assert files.retire(spark, at) == 0  # both runs are still shown
