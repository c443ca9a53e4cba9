"""Shares of a grand total, concentration, and text lists per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ratio


def total_of(df: DataFrame, value: Column) -> Column:
    """Grand total as a scalar subquery: a two-step aggregate, no window over all rows."""
    return df.agg(value.alias("total")).scalar()


def with_share(df: DataFrame, part: str, total: Column, name: str, digits: int | None) -> DataFrame:
    """Add ``part`` in percent of ``total``; ``digits=None`` leaves it unrounded."""
    share = ratio(F.col(part), total) * F.lit(100.0)
    return df.withColumn(name, share if digits is None else F.round(share, digits))


def count_share(df: DataFrame, key: str, name: str = "pct", digits: int = 2) -> DataFrame:
    """Rows per key and their share of all rows."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counted, "n", total_of(df, F.count(F.lit(1))), name, digits)


def concentration(df: DataFrame, key: str, value: str) -> DataFrame:
    """Share of ``value`` per key in percent (``share``) and its square (``squared``)."""
    sums = df.groupBy(key).agg(F.sum(value).alias("_sum"))
    # the total adds up the groups, so that both read one exchange of sums
    shares = with_share(sums, "_sum", total_of(sums, F.sum("_sum")), "share", None)
    return shares.select(key, "share", (F.col("share") * F.col("share")).alias("squared"))


def hhi(df: DataFrame, key: str, value: str) -> DataFrame:
    """Herfindahl-Hirschman index on the 0 to 10,000 scale."""
    return concentration(df, key, value).agg(F.sum("squared").alias("hhi"))


def joined_text(
    df: DataFrame, keys: Sequence[str], text: str, name: str, separator: str = " | "
) -> DataFrame:
    """Sorted text list per group, repeats kept.

    Rows are counted per (group, text) before anything is gathered, and each text is repeated
    inside the final string; so a group is gathered as its distinct texts, never as its rows.
    """
    counted = (
        df.where(F.col(text).isNotNull())
        .groupBy(*keys, text)
        .agg(F.count(F.lit(1)).cast("int").alias("_n"))
    )
    listed = F.array_sort(F.collect_list(F.struct(F.col(text).alias("t"), F.col("_n").alias("n"))))
    pieces = F.transform(
        listed,
        lambda e: F.concat(e["t"], F.repeat(F.concat(F.lit(separator), e["t"]), e["n"] - 1)),
    )
    return counted.groupBy(*keys).agg(F.array_join(pieces, separator).alias(name))
