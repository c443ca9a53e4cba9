"""Tables stored by key: written once, so that every later window, sum and join on the key reads
them without another exchange.

Rows are bucketed and sorted by the key. A bucket is read by one task, so keys with more rows than a
task may handle are kept apart, in a plain table in range order that many tasks read. The flag column
``APART`` is constant in each of the two, so the one half of a divided window drops out of the other's plan.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import GROUP, HOT_ROWS, GroupSizes, measure
from ..operators.staging import new_path, remember_table, stage

APART = "_apart"
MIN_PART = 100_000  # rows below which a part of the large keys is not divided further


@dataclass(frozen=True)
class Stored:
    """``rows`` (with ``APART`` where keys are kept apart) and the ``sizes`` to hand on to steps on the key."""

    rows: DataFrame
    sizes: GroupSizes


def store_by_key(
    df: DataFrame,
    key: str,
    order: Sequence[str] = (),
    *,
    buckets: int | None = None,
    hot_rows: int = HOT_ROWS,
    sizes: GroupSizes | None = None,
    label: str = "stored",
) -> Stored:
    """Store ``df`` in the staging folder, bucketed by ``key`` and sorted by it and ``order``.

    Tables that are to be joined on the key need the same number of ``buckets`` (the session's shuffle
    partitions unless given). ``release_staged`` deletes the files and the table's name.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = measure(df, [key], hot_rows) if sizes is None else sizes
    cold = df if sizes.hot is None else sizes.hot.cold(df)
    name, path = f"riskloom_{label}_{uuid.uuid4().hex}", new_path(spark, label)
    by = [key, *order]
    # the buckets are those of the exchange, so each task writes one sorted file
    dealt = cold.repartition(buckets, key).sortWithinPartitions(*by)
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(*by).option("path", path).saveAsTable(name)
    remember_table(spark, name)
    rows = spark.table(name)
    if sizes.hot is None:
        return Stored(rows, sizes)
    parts = sizes.hot.rows // max(hot_rows, MIN_PART) + 1
    apart = sizes.hot.hot(df).drop(GROUP).select(*df.columns)
    apart = stage(apart.repartitionByRange(parts, *by), f"{label}-apart")
    rows = rows.withColumn(APART, F.lit(False)).unionByName(apart.withColumn(APART, F.lit(True)))
    return Stored(rows, GroupSizes(replace(sizes.hot, flag=APART)))
