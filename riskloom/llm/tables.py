"""Reading the shared tables and splitting labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, by modulus (null ids: the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: str, per_class: str, rows_per_class: int) -> DataFrame:
    """At most ``rows_per_class`` keys of each class, each once, the same on every run (smallest hashes).

    However many classes there are: rows are numbered per class after every task has cut its own rows
    to the limit, so a class with most of the rows moves no more than that from a task.
    """
    known = df.select(key, per_class).distinct()
    order = Window.partitionBy(per_class).orderBy(F.xxhash64(F.lit(17), F.col(key)), F.col(key))
    return known.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= rows_per_class).drop("_nth")


def one_text_each(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row of each of ``keys``, the one with the least hash of its text: what bounds a sample in rows."""
    least = F.min(F.struct(F.xxhash64(text).alias("hash"), F.col(text).alias("text")))
    return rows.groupBy(*keys).agg(least.alias("_least")).select(*keys, F.col("_least.text").alias(text))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, folds: int = 5
) -> DataFrame:
    """``doc_id, text, label`` of a bounded sample of labelled rows outside the held-out fold.

    The held-out fold is remainder 0. An id with several labels gives a row for each, an id with several
    texts the one of the least hash, an id without a text none. The ids of the sample (``rows_per_class``
    of each class at most) are broadcast, so the documents are read once, and only the sample moves.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull()
    )
    known = known.where(remainder(F.col("doc_id"), folds) != 0)
    chosen = bounded_sample(known, "doc_id", "label", rows_per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return one_text_each(rows, ["doc_id", "label"])
