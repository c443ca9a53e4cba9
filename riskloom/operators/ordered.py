"""Ordered windows that stay distributed when one group is too big for one task.

A plain Spark window sorts a whole group inside one task. That is the best plan for many small
groups and the worst one for a group that holds a third of the table. ``OrderedRows`` counts the
groups once and keeps the plain window for those below ``hot_rows``. The rows of larger groups, and
all rows of an order over the whole table, whatever its size, are range-partitioned by (group,
order), so that a group spreads over many tasks, and get their exact position in the group. Windows
then run over blocks of consecutive positions:

* look-back and look-ahead frames see copies of the neighbouring rows of the next block,
* running aggregates add what the earlier blocks of the group carry over,
* whole-group aggregates are ordinary two-step aggregates.

The order columns must be unique within a group; both forms then give the same values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .skew import GROUP, HOT_ROWS, GroupSizes, sizes_of, small_enough
from .staging import stage

SERIAL, POS, BLOCK, HOME = "_serial", "_pos", "_block", "_home"
_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row number below

_RUNNING = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "product": F.product}
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "product": F.product}


def sort_columns(order: Sequence[str]) -> list[Column]:
    """``"name"`` sorts ascending, ``"-name"`` descending."""
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def plain_name(column: str) -> str:
    return column.removeprefix("-")


def _merged(how: str, carried: Column, local: Column) -> Column:
    if how == "max":
        return F.greatest(carried, local)
    if how == "min":
        return F.least(carried, local)
    both = carried * local if how == "product" else carried + local
    return F.coalesce(both, local, carried)


class OrderedRows:
    """Rows of ``df`` in groups of ``keys``, each group ordered by ``order``.

    ``bound`` is an upper limit of group size that the caller has already checked, for instance
    the length of a calendar or the rows of a counted table; it makes the size check needless
    within ``hot_rows`` and without ``keys``. ``sizes``
    hands on a check that was made before. ``position`` names a column that already holds the
    row's position in its group, from 1 without gaps; big groups then need no placement.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        *,
        hot_rows: int = HOT_ROWS,
        bound: int | None = None,
        sizes: GroupSizes | None = None,
        position: str | None = None,
    ):
        self.keys = list(keys)
        self.order = list(order)
        self.hot_rows = hot_rows
        self.columns = df.columns
        self.groups = 0
        self.cold: DataFrame | None = df
        self.hot: DataFrame | None = None
        if self.keys:
            self._split(df, sizes_of(df, self.keys, hot_rows, bound, sizes), position)
        else:
            self.groups, self.cold = 1, None
            whole = df.withColumn(GROUP, F.lit(0).cast("long"))
            self.hot = self._place(whole, df.count() if bound is None else bound)

    # -- preparation -----------------------------------------------------------------------

    def _split(self, df: DataFrame, sizes: GroupSizes, position: str | None) -> None:
        if sizes.hot is None:
            return
        self.groups, self.cold = sizes.hot.count, sizes.hot.cold(df)
        rows = sizes.hot.hot(df)
        if position is None:
            self.hot = self._place(rows, sizes.hot.rows)
        else:
            self.hot = rows.withColumn(POS, F.col(position).cast("long") - 1)

    def _place(self, df: DataFrame, total: int) -> DataFrame:
        parts = math.ceil(total / self.hot_rows) + 1
        by = [F.col(GROUP).asc(), *sort_columns(self.order)]
        placed = stage(
            df.repartitionByRange(parts, *by)
            .sortWithinPartitions(*by)
            .withColumn(SERIAL, F.monotonically_increasing_id()),
            "placed",
        )
        part = F.shiftright(F.col(SERIAL), _LOCAL_BITS)
        local = F.col(SERIAL).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
        # one row per range partition
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts_before = (
            placed.groupBy(part.alias("_part"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        )
        parts_before = small_enough(parts_before, parts)
        # one row per big group
        first = placed.groupBy(GROUP).agg(F.min(SERIAL).alias(SERIAL))
        first = first.join(parts_before, part == F.col("_part")).select(
            F.col(GROUP).alias("_first_group"), (F.col("_before") + local).alias("_first")
        )
        return (
            placed.join(parts_before, part == F.col("_part"))
            .join(small_enough(first, self.groups), F.col(GROUP) == F.col("_first_group"))
            .withColumn(POS, F.col("_before") + local - F.col("_first"))
            .drop("_part", "_before", "_first_group", "_first", SERIAL)
        )

    # -- steps -----------------------------------------------------------------------------

    def _next(self, cold: DataFrame | None, hot: DataFrame | None, names) -> OrderedRows:
        out = object.__new__(OrderedRows)
        out.__dict__.update(self.__dict__)
        out.cold, out.hot = cold, hot
        out.columns = [*self.columns, *[n for n in names if n not in self.columns]]
        return out

    def by_range(self) -> OrderedRows:
        """Exchange the plain groups by range of key, where the result is wanted in key order.

        Windows over the groups and a later sort by (keys, order) then share this one exchange.
        """
        cold = None if self.cold is None else self.cold.repartitionByRange(*self.keys)
        return self._next(cold, self.hot, [])

    def with_columns(self, columns: Mapping[str, Column]) -> OrderedRows:
        """Row-wise columns."""
        done = [None if d is None else d.withColumns(dict(columns)) for d in (self.cold, self.hot)]
        return self._next(*done, columns)

    def position(self, name: str) -> OrderedRows:
        """Row number in the group, from 1."""
        cold, hot = self.cold, self.hot
        if cold is not None:
            cold = cold.withColumn(name, F.row_number().over(self._window()).cast("long"))
        if hot is not None:
            hot = hot.withColumn(name, F.col(POS) + 1)
        return self._next(cold, hot, [name])

    def whole(self, columns: Mapping[str, Column]) -> OrderedRows:
        """Aggregates over the whole group."""
        cold, hot = self.cold, self.hot
        if cold is not None:
            w = Window.partitionBy(*self.keys)
            cold = cold.withColumns({n: c.over(w) for n, c in columns.items()})
        if hot is not None:
            totals = hot.groupBy(GROUP).agg(*[c.alias(n) for n, c in columns.items()])
            hot = hot.join(small_enough(totals, self.groups), GROUP)
        return self._next(cold, hot, columns)

    def nearby(
        self,
        columns: Mapping[str, Callable[[WindowSpec], Column]],
        *,
        back: int = 0,
        ahead: int = 0,
    ) -> OrderedRows:
        """Window columns that read at most ``back`` earlier and ``ahead`` later rows."""
        cold, hot = self.cold, self.hot
        if cold is not None:
            cold = cold.withColumns({n: f(self._window()) for n, f in columns.items()})
        if hot is not None:
            size = max(self.hot_rows, back, ahead)
            home = F.floor(F.col(POS) / F.lit(size)).cast("long")
            inside = F.col(POS) % F.lit(size)
            seen_in = F.array_compact(
                F.array(
                    home,
                    F.when(inside >= size - back, home + 1),
                    F.when((inside < ahead) & (home > 0), home - 1),
                )
            )
            w = Window.partitionBy(GROUP, BLOCK).orderBy(POS)
            hot = (
                hot.withColumn(HOME, home)
                .withColumn(BLOCK, F.explode(seen_in))
                .withColumns({n: f(w) for n, f in columns.items()})
                .where(F.col(BLOCK) == F.col(HOME))
                .drop(BLOCK, HOME)
            )
        return self._next(cold, hot, columns)

    def running(self, columns: Mapping[str, tuple[str, Column]]) -> OrderedRows:
        """Aggregates from the first row of the group to the current row.

        Each column is a pair of aggregate name (sum, count, min, max, product) and input.
        """
        cold, hot = self.cold, self.hot
        if cold is not None:
            w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
            cold = cold.withColumns({n: _RUNNING[h](c).over(w) for n, (h, c) in columns.items()})
        if hot is not None:
            hot = hot.withColumn(BLOCK, F.floor(F.col(POS) / F.lit(self.hot_rows)).cast("long"))
            w = Window.partitionBy(GROUP, BLOCK).orderBy(POS)
            w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            # one row per block of hot_rows rows
            earlier = Window.partitionBy("_g").orderBy("_b")
            earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
            blocks = hot.groupBy(F.col(GROUP).alias("_g"), F.col(BLOCK).alias("_b")).agg(
                *[_RUNNING[h](c).alias(f"_c_{n}") for n, (h, c) in columns.items()]
            )
            blocks = blocks.select(
                "_g",
                "_b",
                *[
                    _MERGE[h](F.col(f"_c_{n}")).over(earlier).alias(f"_c_{n}")
                    for n, (h, _) in columns.items()
                ],
            )
            local = hot.withColumns({n: _RUNNING[h](c).over(w) for n, (h, c) in columns.items()})
            same = (F.col(GROUP) == F.col("_g")) & (F.col(BLOCK) == F.col("_b"))
            hot = (
                local.join(blocks, same)
                .withColumns(
                    {
                        n: _merged(h, F.col(f"_c_{n}"), F.col(n))
                        for n, (h, _) in columns.items()
                    }
                )
                .drop("_g", "_b", BLOCK, *[f"_c_{n}" for n in columns])
            )
        return self._next(cold, hot, columns)

    def rows(self) -> DataFrame:
        """All rows with the columns added so far."""
        done = [d.select(*self.columns) for d in (self.cold, self.hot) if d is not None]
        return done[0] if len(done) == 1 else done[0].unionByName(done[1])

    def _window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*sort_columns(self.order))
