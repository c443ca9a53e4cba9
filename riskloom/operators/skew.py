"""Keys that hold too many rows for one task, and joins that spread them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    IntegralType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from .staging import stage

HOT_ROWS = 2_000_000  # rows of one key that one task may handle
BROADCAST_ROWS = 1_000_000  # rows of a narrow table that may be broadcast
DRIVER_KEYS = 1_000  # hot keys known by value; more of them are staged
LISTED_TUPLES = 50  # hot keys of several columns that are written out as a predicate
PLAIN_KEYS = (IntegralType, StringType, DateType)
GROUP = "_group"


def small_enough(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a narrow table whose counted rows are below the bound, else no hint."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def key_match(
    left: DataFrame, right: DataFrame, pairs: Mapping[str, str], *, null_safe: bool = True
) -> Column:
    """Equality of key columns; NULL equals NULL if ``null_safe``."""
    each = [
        left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in pairs.items()
    ]
    return reduce(and_, each)


@dataclass(frozen=True)
class HotKeys:
    """Keys with more than the allowed rows: at most all rows / allowed rows of them.

    A few keys are known by value; they become plain predicates, which Catalyst pushes through
    windows, unions and joins into the scans. More of them are joined.
    """

    table: DataFrame  # _key_<name> columns and _group, a number per key
    names: dict[str, str]
    count: int
    rows: int
    values: tuple | None = None  # key tuples, if few
    flag: str | None = None  # column that is true for rows of these keys, where rows have it

    def cold(self, df: DataFrame) -> DataFrame:
        if self.flag in df.columns:
            return df.where(~F.col(self.flag))
        if self.values is not None:
            return df.where(~self.is_hot())
        return df.join(self.small(), key_match(df, self.table, self.names), "left_anti")

    def hot(self, df: DataFrame) -> DataFrame:
        """Rows of hot keys with their ``_group``."""
        if self.flag in df.columns:
            rows = df.where(F.col(self.flag))
        else:
            rows = df if self.values is None else df.where(self.is_hot())
        joined = rows.join(self.small(), key_match(rows, self.table, self.names), "inner")
        return joined.drop(*self.names.values())

    def is_hot(self) -> Column:
        """True for a listed key, else false, never NULL."""
        if len(self.names) > 1:
            each = [
                reduce(and_, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(self.names, key, strict=True)])
                for key in self.values
            ]
            return reduce(or_, each)
        (column,) = (F.col(k) for k in self.names)
        known = [key[0] for key in self.values if key[0] is not None]
        listed = column.isNotNull() & column.isin(known)
        return listed if len(known) == len(self.values) else column.isNull() | column.isin(known)

    def small(self) -> DataFrame:
        return small_enough(self.table, self.count)


@dataclass(frozen=True)
class GroupSizes:
    """What one count of the rows per key has shown; hand it on to every step on these keys.

    Filters and lookups only make groups smaller, so it stays valid along a chain of steps.
    """

    hot: HotKeys | None = None  # None: every group is small

    def flags(self) -> list[str]:
        """The column that rows must keep for their hot keys to be told by it, if there is one."""
        return [self.hot.flag] if self.hot is not None and self.hot.flag else []

    def renamed(self, columns: Mapping[str, str]) -> GroupSizes:
        """The same sizes where key columns have new names."""
        if self.hot is None:
            return self
        names = {columns.get(k, k): n for k, n in self.hot.names.items()}
        return GroupSizes(replace(self.hot, names=names))


def measure(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> GroupSizes:
    """Count rows per key, with map-side partial counts, and keep the keys above ``hot_rows``."""
    names = {k: f"_key_{k}" for k in keys}
    sizes = (
        df.groupBy(*[F.col(k).alias(n) for k, n in names.items()])
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > hot_rows)
    )
    # the largest first: a bounded top-k that runs over all partitions at once
    few = sizes.orderBy(F.col("_rows").desc()).limit(DRIVER_KEYS + 1).collect()
    if not few:
        return GroupSizes()
    values = None
    if len(few) <= DRIVER_KEYS:
        schema = StructType([*sizes.schema.fields, StructField(GROUP, LongType())])
        table = df.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(few)], schema)
        count, rows = len(few), sum(r["_rows"] for r in few)
        plain = all(isinstance(sizes.schema[n].dataType, PLAIN_KEYS) for n in names.values())
        if plain and (len(names) == 1 or count <= LISTED_TUPLES):
            values = tuple(tuple(r)[:-1] for r in few)
    else:
        table = stage(sizes.withColumn(GROUP, F.monotonically_increasing_id()), "hot-keys")
        count, rows = table.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    return GroupSizes(HotKeys(table.drop("_rows"), names, count, rows, values))


def sizes_of(
    df: DataFrame,
    keys: Sequence[str],
    hot_rows: int,
    bound: int | None = None,
    sizes: GroupSizes | None = None,
) -> GroupSizes:
    """Sizes as given, as implied by a known bound, or counted."""
    if sizes is not None:
        return sizes
    if bound is not None and bound <= hot_rows:
        return GroupSizes()
    return measure(df, keys, hot_rows)


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    pairs: Mapping[str, str],
    *,
    null_safe: bool = False,
    hot_rows: int = HOT_ROWS,
    bound: int | None = None,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """Inner join of many rows to a table that has each key about once.

    Catalyst picks the join. Where a key of ``df`` has more than ``hot_rows`` rows, the rows of
    such keys stay where they are and meet the few table rows of these keys by broadcast; all
    other rows are joined as usual. ``bound`` or ``sizes`` spare the count of rows per key.
    """
    hot = sizes_of(df, list(pairs), hot_rows, bound, sizes).hot
    if hot is None:
        return df.join(table, key_match(df, table, pairs, null_safe=null_safe))
    theirs = replace(hot, names={pairs[k]: n for k, n in hot.names.items()})
    few = theirs.hot(table).drop(GROUP)
    mine = hot.hot(df).drop(GROUP)
    spread = mine.join(
        small_enough(few, few.count()), key_match(mine, few, pairs, null_safe=null_safe)
    )
    rest = hot.cold(df)
    return spread.unionByName(rest.join(table, key_match(rest, table, pairs, null_safe=null_safe)))
