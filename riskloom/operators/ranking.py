"""Ranks, percentiles and quantile groups over whole tables, without one-task windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .ordered import OrderedRows, plain_name, sort_columns
from .skew import HOT_ROWS, lookup_join
from .staging import stage

CUT_GROUPS = 256  # quantile groups up to which the cut rows are fetched one by one
_LOCAL_BITS = 33


def top_k(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """First ``k`` rows. End ``order`` with a unique column, or ties at the limit are arbitrary."""
    return df.orderBy(*sort_columns(order)).limit(k)


def two_ended_top(df: DataFrame, value: str, tie: str, largest: int, smallest: int) -> DataFrame:
    """The ``largest`` biggest and ``smallest`` smallest rows, stacked without removing repeats."""
    high = top_k(df, [f"-{value}", tie], largest)
    low = top_k(df, [value, tie], smallest)
    return high.unionByName(low).orderBy(value, tie)


def row_number(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    *,
    keys: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Row number from 1 in a unique order, over the table or per group."""
    return OrderedRows(df, keys, order, hot_rows=hot_rows).position(name).rows()


def value_ranks(
    df: DataFrame,
    order: str,
    *,
    keys: Sequence[str] = (),
    weight: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per (keys, value): rank, dense_rank, percent_rank and the rows that share it.

    Equal values share every one of these ranks, so they depend only on how many rows each
    distinct value has. Rows are counted per value first; ordered work then sees each value once.
    ``weight`` names a column of row counts if ``df`` is already counted.
    """
    value = plain_name(order)
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = stage(df.groupBy(*keys, value).agg(n.cast("long").alias("rows_here")), "values")
    return (
        # the staged row count bounds every group; only beyond it are groups measured
        OrderedRows(counted, keys, [order], hot_rows=hot_rows, bound=counted.count())
        .running({"_upto": ("sum", F.col("rows_here"))})
        .position("dense_rank")
        .whole({"rows_in_group": F.sum("rows_here")})
        .with_columns({"rank": F.col("_upto") - F.col("rows_here") + 1})
        .with_columns(
            {
                "percent_rank": F.when(
                    F.col("rows_in_group") > 1,
                    (F.col("rank") - 1) / (F.col("rows_in_group") - 1),
                ).otherwise(F.lit(0.0))
            }
        )
        .rows()
        .drop("_upto")
    )


def with_value_ranks(
    df: DataFrame,
    order: str,
    names: dict[str, str],
    *,
    keys: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add chosen ranks to every row; ``names`` maps rank, dense_rank, percent_rank to columns."""
    ranks = stage(value_ranks(df, order, keys=keys, hot_rows=hot_rows), "ranks")
    bound = ranks.agg(F.max("rows_here")).first()[0] or 0
    on = [*keys, plain_name(order)]
    return attach_ranks(df, ranks, on, names, hot_rows=hot_rows, bound=bound)


def attach_ranks(
    df: DataFrame,
    ranks: DataFrame,
    on: Sequence[str],
    names: dict[str, str],
    *,
    hot_rows: int = HOT_ROWS,
    bound: int | None = None,
) -> DataFrame:
    """Join ranks per value back to rows, NULL values included.

    ``bound`` is the most rows of ``df`` that share a value.
    """
    pairs = {c: f"_on_{c}" for c in on}
    right = ranks.select(
        *[F.col(c).alias(n) for c, n in pairs.items()],
        *[F.col(r).alias(n) for r, n in names.items()],
    )
    joined = lookup_join(df, right, pairs, null_safe=True, hot_rows=hot_rows, bound=bound)
    return joined.drop(*pairs.values())


def rows_at(df: DataFrame, order: Sequence[str], positions) -> list[Row]:
    """Sort keys of the rows at some 1-based positions of the whole table's order.

    ``positions`` is a function of the row count. Only the key columns move: they are
    range-partitioned and staged once, the part sizes (one number per shuffle partition) give the
    place of each position, and the staged files are read again for these few rows alone.
    """
    names = [plain_name(c) for c in order]
    by = sort_columns(order)
    # as many parts as the session's shuffles have; adaptive execution merges small neighbours
    keys = stage(
        df.select(*names)
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_serial", F.monotonically_increasing_id()),
        "sort-keys",
    )
    part = F.shiftright(F.col("_serial"), _LOCAL_BITS)
    sizes = keys.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = sorted((r["part"], r["n"]) for r in sizes)
    total = sum(n for _, n in sizes)
    serials = {}
    for p in sorted(set(positions(total))):
        before = 0
        for number, n in sizes:
            if p <= before + n:
                serials[(number << _LOCAL_BITS) + p - before - 1] = p
                break
            before += n
    found = keys.where(F.col("_serial").isin(list(serials))).collect()
    return [row for _, row in sorted((serials[r["_serial"]], r) for r in found)]


def _last_of_groups(total: int, groups: int) -> list[int]:
    """Last position of each quantile group but the final one; the first ones hold the extra."""
    size, extra = divmod(total, groups)
    ends = [size * i + min(i, extra) for i in range(1, groups)]
    return [e for e in ends if 0 < e < total]


def _beyond(column: str, value) -> Column:
    """True where the row's value sorts strictly after ``value``, else false.

    NULL comes first in ascending and last in descending order, as in Spark's sort.
    """
    c = F.col(plain_name(column))
    if column.startswith("-"):
        return F.lit(False) if value is None else (c.isNull() | (c < F.lit(value)))
    return c.isNotNull() if value is None else F.coalesce(c > F.lit(value), F.lit(False))


def _after(order: Sequence[str], row: Row) -> Column:
    """True where the row sorts after ``row``: equal in some first columns, beyond in the next."""
    steps = []
    for i, column in enumerate(order):
        same = [F.col(plain_name(c)).eqNullSafe(F.lit(row[plain_name(c)])) for c in order[:i]]
        steps.append(reduce(and_, [*same, _beyond(column, row[plain_name(column)])]))
    return reduce(or_, steps)


def ntile_of(df: DataFrame, groups: int, order: Sequence[str]) -> Column:
    """Quantile group, from 1, as a row-wise expression over the columns of ``order``.

    The groups are cut from ``df`` once; the expression can then be used on any table that has
    the order columns, so wide rows are neither sorted nor moved. ``order`` must be unique.
    """
    cuts = rows_at(df, order, lambda total: _last_of_groups(total, groups))
    out = F.lit(1)
    for cut in cuts:
        out = out + F.when(_after(order, cut), F.lit(1)).otherwise(F.lit(0))
    return out.cast("long")


def ntile(
    df: DataFrame, groups: int, order: Sequence[str], name: str, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the quantile group of each row in a unique order over the whole table."""
    if groups <= CUT_GROUPS:
        return df.withColumn(name, ntile_of(df, groups, order))
    done = (
        OrderedRows(df, [], order, hot_rows=hot_rows)
        .position("_rn")
        .whole({"_n": F.count(F.lit(1))})
    )
    size, extra = F.floor(F.col("_n") / groups), F.col("_n") % groups
    wide = extra * (size + 1)
    place = F.when(F.col("_rn") <= wide, F.floor((F.col("_rn") - 1) / (size + 1)) + 1).otherwise(
        extra + F.floor((F.col("_rn") - wide - 1) / F.greatest(size, F.lit(1))) + 1
    )
    return done.with_columns({name: place.cast("long")}).rows().drop("_rn", "_n")
