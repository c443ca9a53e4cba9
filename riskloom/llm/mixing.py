"""Mixing sources to target weights by block quotas and a hypergeometric splitting tree.

The documents of a source are dealt by hash into at most ``BLOCKS`` blocks. A source's target is met
by whole passes over its blocks and a part of one pass: blocks in permuted order as long as they
fit, so the words taken miss the target by less than the smallest block left out. The block draws
are split among output shards by a tree: each node gives its left half a multivariate
hypergeometric share of every source's quota, which is how a uniform shuffle of all draws would
fall. A shard then takes its run of each source's permuted draws and orders its rows by hash.

The driver holds one row per source, never documents: shares of a total need all sources at once.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; rows
repeated with one id are separate rows of equal hash and share their block; a source without words
has target 0; an empty table gives an empty result. Only the named columns are read, so other
columns may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.skew import small_enough
from riskloom.operators.staging import stage

BLOCKS = 4096  # per source; also bounds the rows of one source in one task
BROADCAST_ENDS = 1_000_000  # numbers
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A join key in which a null source is a value like any other."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: list[int], weights=WEIGHTS, share: float = 1.5, most: float = 2.0):
    """Words each source should give: shares by weight, capped, the excess shared out again."""
    size = np.asarray(sizes, float)
    weight = np.array([weights[i % len(weights)] for i in range(len(size))])
    goal, free = np.zeros(len(size)), np.ones(len(size), bool)
    left = share * size.sum()
    while free.any():
        want = left * weight / weight[free].sum()
        over = free & (want > most * size)
        if not over.any():
            goal[free] = want[free]
            break
        goal[over] = most * size[over]
        left -= goal[over].sum()
        free &= ~over
    return goal


def draw_blocks(blocks: pd.DataFrame, seed: int) -> pd.DataFrame:
    """How often each block of one source is drawn (at most ``BLOCKS`` rows come in)."""
    blocks = blocks.sort_values("block").reset_index(drop=True)
    size, goal = int(blocks.source_size.iloc[0]), float(blocks.target.iloc[0])
    passes = min(math.floor(goal / size + 1e-12), 2) if size else 0
    rest = goal - passes * size
    copies = np.full(len(blocks), passes)
    rng = np.random.default_rng([seed, size, len(blocks)])
    permuted = rng.permutation(len(blocks))
    words = blocks.words.to_numpy()
    if rest > 0:
        taken = 0
        for b in permuted:
            if taken + words[b] <= rest:
                taken += words[b]
                copies[b] += 1
        out = permuted[copies[permuted] == passes]
        if len(out):
            best = out[np.argmin(words[out])]
            if words[best] > 0 and taken + words[best] - rest < rest - taken:
                copies[best] += 1
    rank = np.empty(len(blocks), np.int64)
    rank[permuted] = np.arange(len(blocks))
    return blocks.assign(copies=copies.astype("int64"), place=rank)


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of every source for every shard: a tree of multivariate hypergeometric splits."""
    out = np.zeros((len(quotas), shards), np.int64)
    nodes = [(np.asarray(quotas, np.int64), 0, shards)]
    while nodes:
        quota, low, high = nodes.pop()
        if high - low == 1:
            out[:, low] = quota
            continue
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        need = int(quota.sum()) * (mid - low) // (high - low)
        left, rest = np.zeros_like(quota), int(quota.sum())
        for i, have in enumerate(quota):
            rest -= int(have)
            left[i] = rng.hypergeometric(have, rest, need) if need and have else 0
            need -= int(left[i])
        nodes += [(left, low, mid), (quota - left, mid, high)]
    return out


def plan(
    docs: DataFrame, id_col: str, text: str, source: str, seed: int = 9
) -> tuple[DataFrame, DataFrame]:
    """Sized documents (row, id, source_key, block, size; a row number each) and their drawn blocks."""
    spark = docs.sparkSession
    sized = docs.select(
        F.monotonically_increasing_id().alias("row"),  # fixed by the staged table
        F.col(id_col).alias("doc_id"),
        source_key(F.col(source)).alias("source_key"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(BLOCKS)).cast("int").alias("block"),
        word_count(F.col(text)).alias("size"),
    )
    sized = stage(sized, "mix-sizes")
    blocks = stage(
        sized.groupBy("source_key", "block").agg(F.sum("size").alias("words")), "mix-blocks"
    )
    rows = blocks.groupBy("source_key").agg(F.sum("words").alias("w")).collect()
    # "n" sorts before "s...", so the null source is moved to the end
    rows = sorted(rows, key=lambda r: (r.source_key == "n", r.source_key))
    goal = targets([r.w for r in rows])
    # Arrow tables need no Python workers: those of rows would be two more beside the ones at work
    per_source = spark.createDataFrame(
        pa.table(
            {
                "source_key": pa.array([r.source_key for r in rows], pa.string()),
                "source_size": pa.array([r.w for r in rows], pa.int64()),
                "target": pa.array([float(g) for g in goal], pa.float64()),
            }
        )
    )
    schema = (
        "source_key string, block int, words long, source_size long, target double,"
        " copies long, place long"
    )
    drawn = (
        blocks.join(small_enough(per_source, len(rows)), "source_key")
        .groupBy("source_key")
        .applyInPandas(lambda part: draw_blocks(part, seed), schema)
    )
    return sized, stage(drawn, "mix-drawn")


def deal(rows: DataFrame, drawn: DataFrame, id_col: str, shards: int | None, seed: int) -> DataFrame:
    """``rows`` (with ``__key``, ``__block``) as often as their blocks are drawn, dealt to ``__shard``.

    Each shard is a partition of its own, its rows in random order; ``shards`` is
    ``spark.sql.shuffle.partitions`` if it is not given.
    """
    spark = rows.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    quota = drawn.groupBy("source_key").agg(F.sum("copies").alias("q")).collect()
    quota.sort(key=lambda r: r.source_key)
    split = split_quotas(np.array([r.q for r in quota], np.int64), shards, seed)
    ends = spark.createDataFrame(
        pa.table(
            {
                "source_key": pa.array([r.source_key for r in quota], pa.string()),
                "ends": pa.array([np.cumsum(row) for row in split], pa.list_(pa.int64())),
            }
        )
    )
    # instance i of a source (pass by pass, permuted within a pass) goes to the shard it falls in
    draws = drawn.where("copies > 0").select(
        "source_key", "block", "place", F.explode(F.sequence(F.lit(1), "copies")).alias("pass")
    )
    sizes = drawn.groupBy("source_key").agg(F.count("*").alias("n_blocks"))
    full = drawn.groupBy("source_key").agg(F.min("copies").alias("full"))
    part = drawn.join(full, "source_key").where("copies > full")
    w = Window.partitionBy("source_key").orderBy("place")  # at most BLOCKS rows of a source
    last = part.select("source_key", "block", F.row_number().over(w).alias("late"))
    draws = (
        draws.join(sizes, "source_key")
        .join(full, "source_key")
        .join(last, ["source_key", "block"], "left")
        .withColumn(
            "nth",
            F.when(
                F.col("pass") <= F.col("full"),
                (F.col("pass") - 1) * F.col("n_blocks") + F.col("place") + 1,
            ).otherwise(F.col("full") * F.col("n_blocks") + F.col("late")),
        )
        .join(F.broadcast(ends) if len(quota) * shards <= BROADCAST_ENDS else ends, "source_key")
        .select(
            F.col("source_key").alias("__key"),
            F.col("block").alias("__block"),
            F.col("pass").alias("__pass"),
            F.size(F.filter("ends", lambda e: e < F.col("nth"))).alias("__shard"),
        )
    )
    out = rows.join(draws, ["__key", "__block"]).withColumn(
        "__order", F.xxhash64(F.lit(seed + 1), "__pass", F.col(id_col))
    )
    return out.repartitionById(shards, F.col("__shard")).sortWithinPartitions("__shard", "__order", id_col)


def taken_words(
    docs: DataFrame, id_col="doc_id", text="text", source="source", shards: int | None = None, seed: int = 9
) -> DataFrame:
    """One row per document: its size, its source's size and target, the words the mix takes.

    The words are summed over the rows that are really dealt to shards, as :func:`mix` deals them;
    ids and sizes take the place of the texts.
    """
    sized, drawn = plan(docs, id_col, text, source, seed)
    rows = sized.withColumnsRenamed({"source_key": "__key", "block": "__block"})
    dealt = deal(rows, drawn, "doc_id", shards, seed)
    dealt = stage(dealt.select("row", "doc_id", "size", "__shard"), "mix-dealt")
    taken = dealt.groupBy("row").agg(F.sum("size").alias("taken"))
    goals = drawn.select("source_key", "source_size", "target").distinct()
    return (
        sized.join(taken, "row", "left")
        .join(goals, "source_key")
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    shards: int | None = None,
    seed: int = 9,
    shard_col: str | None = None,
) -> DataFrame:
    """The mixed rows, whole documents, each as often as its block is drawn.

    One output partition per shard, its rows in random order. ``shard_col`` adds the shard's number.
    The caller's columns travel in one struct, so they may have any names.
    """
    _, drawn = plan(docs, id_col, text, source, seed)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("doc_id"),
        source_key(F.col(source)).alias("__key"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(BLOCKS)).cast("int").alias("__block"),
    )
    out = deal(keyed, drawn, "doc_id", shards, seed)
    if shard_col:
        return out.select("row.*", F.col("__shard").alias(shard_col))
    return out.select("row.*")
