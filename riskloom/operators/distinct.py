"""Approximate distinct counts that merge: an opt-in beside the exact ``count_distinct``.

A sketch of fixed size is kept per group and period. Any span of periods, any roll-up of groups, is then
a merge of sketches: the rows are not read again. Up to some hundreds of values a sketch is nearly exact;
beyond that its relative standard error is ``standard_error(precision)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECISION = 14  # 2 ** 14 registers, about 16 kB a sketch


def standard_error(precision: int = PRECISION) -> float:
    return 1.04 / 2 ** (precision / 2)


def distinct_sketches(
    df: DataFrame, keys: Sequence[str | Column], value: str, name: str = "sketch", precision: int = PRECISION
) -> DataFrame:
    """One sketch of the distinct non-null values per group; partial sketches are merged before the shuffle."""
    # longs and texts are what sketches take; other types are counted by their text
    kind = df.schema[value].dataType.simpleString()
    column = F.col(value) if kind in ("int", "bigint", "string", "binary") else F.col(value).cast("string")
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, F.lit(precision)).alias(name))


def merged(sketches: DataFrame, keys: Sequence[str | Column], name: str = "sketch") -> DataFrame:
    """Sketches of larger groups: the union of their parts' sketches."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg(name).alias(name))


def rolling_distinct(
    sketches: DataFrame, keys: Sequence[str], period: str, back: int, name: str = "sketch"
) -> DataFrame:
    """Sketches over the periods from ``period - back`` to ``period``, for every period that has one.

    Each sketch is copied to the periods whose span it belongs to, so the work is ``back + 1`` sketches a
    period, whatever the rows.
    """
    spread = sketches.select(
        *keys, F.explode(F.sequence(F.col(period), F.col(period) + back)).alias(period), name
    )
    there = sketches.select(*keys, period)
    return merged(spread.join(there, [*keys, period], "left_semi"), [*keys, period], name)


def estimate(sketch: str | Column) -> Column:
    return F.hll_sketch_estimate(sketch)
