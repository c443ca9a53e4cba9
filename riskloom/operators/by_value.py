"""Windows whose frame is a distance in the order column, not a number of rows.

A rolling quarter over months counts a month without rows as a month: the frame of a row at value ``v``
holds the rows from ``v - back`` to ``v + ahead``. Plain windows do this for groups that one task may
handle. Larger groups are cut into blocks of values; a row is copied into the blocks whose frames may
reach it, the windows run inside the blocks, and each row is kept from its own block.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .ordered import BLOCK, HOME
from .skew import GROUP, HOT_ROWS, GroupSizes, sizes_of, small_enough


def month_number(date: Column) -> Column:
    """Months since year 0: neighbouring months differ by one."""
    return F.year(date) * 12 + F.month(date) - 1


def within(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    *,
    back: int,
    ahead: int = 0,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
) -> DataFrame:
    """``df`` with window columns over the rows of the group from ``value - back`` to ``value + ahead``.

    ``value`` is a whole number, such as a day or :func:`month_number`. A block of a divided group
    spans at least ``back + ahead + 1`` values, so a row has at most three copies; it holds about
    ``hot_rows`` rows, more only where so many rows lie within one frame. Rows without a value form a
    frame of their own.
    """
    if back < 0 or ahead < 0:
        raise ValueError("distances are not negative")
    frame = Window.orderBy(value).rangeBetween(-back, ahead)
    hot = sizes_of(df, keys, hot_rows, None, sizes).hot if keys else None
    plain = frame.partitionBy(*keys) if keys else None
    if keys and hot is None:
        return df.withColumns({n: f(plain) for n, f in columns.items()})
    if keys:
        rows, groups = hot.hot(df), hot.count
        cold = hot.cold(df).withColumns({n: f(plain) for n, f in columns.items()})
    else:
        rows, groups, cold = df.withColumn(GROUP, F.lit(0).cast("long")), 1, None
    v = F.col(value).cast("long")
    span = rows.groupBy(F.col(GROUP).alias("_g")).agg(
        F.min(v).alias("_low"), F.max(v).alias("_high"), F.count(F.lit(1)).alias("_n")
    )
    parts = F.ceil(F.col("_n") / F.lit(hot_rows))
    width = F.ceil((F.col("_high") - F.col("_low") + 1) / parts)
    span = span.select("_g", "_low", F.greatest(width, F.lit(back + ahead + 1)).cast("long").alias("_width"))
    placed = rows.join(small_enough(span, groups), F.col(GROUP) == F.col("_g"))
    home = F.floor((v - F.col("_low")) / F.col("_width")).cast("long")
    first = F.floor((v - ahead - F.col("_low")) / F.col("_width")).cast("long")
    last = F.floor((v + back - F.col("_low")) / F.col("_width")).cast("long")
    seen_in = F.when(v.isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(first, last))
    block = Window.partitionBy(GROUP, BLOCK).orderBy(value).rangeBetween(-back, ahead)
    done = (
        placed.withColumn(HOME, F.coalesce(home, F.lit(-1).cast("long")))
        .withColumn(BLOCK, F.explode(seen_in))
        .withColumns({n: f(block) for n, f in columns.items()})
        .where(F.col(BLOCK) == F.col(HOME))
        .select(*df.columns, *columns)
    )
    return done if cold is None else cold.select(*df.columns, *columns).unionByName(done)
