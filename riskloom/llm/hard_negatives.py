"""Hard negatives of anchors by Fagin's threshold algorithm over blocks of candidates.

1. Components become whole numbers, floor(256 x). Candidates are dealt by hash to tasks; a task takes
   blocks of ``BLOCK`` rows and sorts each dimension of a block once.
2. For an anchor, sorted access goes down the list of every dimension in which the anchor is not zero, from
   the large end where the anchor's component is positive, from the small end where it is negative. Rows met
   for the first time get their exact score by random access. The threshold, the score that a row at the
   present depth of all lists would have, bounds every row not met yet.
3. A window is a range of scores with its ``TOP`` best rows so far, kept from block to block. A search ends
   once the threshold lies strictly below the window's worst kept score (strictly, because ties go to the
   smaller id) or below the window's range, for all windows.
4. First the window of an anchor's positives is everything, over rows of its label; the scores of the
   positives then give the windows of its negatives, over rows of other labels. Tasks return ``TOP`` rows a
   window, which one ranking per window merges.

Anchors are sent to the tasks in passes of about ``ANCHORS`` (counted), so the broadcast is bounded
whatever the table; every pass reads all candidates.

Edge cases: rows with a null id, label or vector, or with a null or non-finite component, take no part;
repeated rows (equal id, label and vector) count once, other rows of one id are rows of their own; rows of
different lengths are not compared; an anchor without positives, or a positive whose window holds no row,
gives no rows; scores too large for doubles are reckoned with Python's whole numbers (beyond 38 digits they count as
equal) and returned within the range of a long; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.staging import stage

SCALE = 256
TOP = 5
BLOCK = 8192
ANCHORS = 20_000
FIRST_STEP = 8  # rows of each list; every further step is twice as long
MOST = 10**38 - 1  # of scores reckoned without doubles
EASE, FULL = 80, 100  # a negative scores at least 80 and at most 100 hundredths of the positive


def whole(x: np.ndarray, exact: bool) -> np.ndarray:
    """floor(256 x) in doubles, or in Python's numbers where products do not fit doubles."""
    q = np.floor(SCALE * x)
    return q if exact else np.array([[int(c) for c in row] for row in q], object).reshape(q.shape)


class Lists:
    """A block of rows with every dimension sorted."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)

    def search(self, anchor: np.ndarray, fits: np.ndarray, low, high, score, found) -> int:
        """Update ``score`` and ``found`` (windows x TOP, best first) in place; rows scored."""
        n = len(self.x)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen, depth, step = np.zeros(n, bool), 0, FIRST_STEP
        while depth < n:
            at = max(depth - 1, 0)
            bound = (self.sorted[n - 1 - at, up] * anchor[up]).sum()
            bound += (self.sorted[at, down] * anchor[down]).sum()
            if np.all((bound < low) | (bound < score[:, -1])):
                break
            to = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.order[n - to : n - depth, up]] = True
            met[self.order[depth:to, down]] = True
            if not len(up) and not len(down):  # all scores are 0
                met[:], to = True, n
            new = np.flatnonzero(met & ~seen)
            seen |= met
            depth, step = to, 2 * step
            new = new[fits[new]]
            if len(new):
                self._update(new, self.x[new] @ anchor, low, high, score, found)
        return int(seen.sum())

    def _update(self, rows, s, low, high, score, found) -> None:
        for w in range(len(low)):
            some = (s >= max(low[w], score[w, -1])) & (s <= high[w])
            if some.any():
                both = np.concatenate((score[w], s[some]))
                ids = np.concatenate((found[w], self.ids[rows[some]]))
                best = np.lexsort((ids, -both))[: score.shape[1]]
                score[w], found[w] = both[best], ids[best]


@dataclass
class Anchors:
    """Anchors of one length with their windows (``low`` and ``high``: anchors x windows)."""

    row: np.ndarray
    label: np.ndarray
    x: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _scan(shared, exact: bool, same_label: bool, dtype):
    """Tasks: blocks of candidates against all anchors of the pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, Anchors] = shared.value
        best = {
            d: (np.full((*a.low.shape, TOP), -math.inf, dtype), np.zeros((*a.low.shape, TOP), np.int64))
            for d, a in groups.items()
        }
        waiting: dict[int, list] = {}

        def work(d: int) -> None:
            parts = waiting.pop(d)
            row, ids, label, x = (np.concatenate(c) for c in zip(*parts))
            a, (score, found) = groups[d], best[d]
            x = whole(x, exact)
            lots = [np.flatnonzero(label == c) for c in np.unique(a.label)] if same_label else [np.arange(len(x))]
            for lot in lots:
                if not len(lot):
                    continue
                lists = Lists(x[lot], ids[lot])
                mine = np.flatnonzero(a.label == label[lot[0]]) if same_label else range(len(a.row))
                for i in mine:
                    fits = row[lot] != a.row[i] if same_label else label[lot] != a.label[i]
                    lists.search(a.x[i], fits, a.low[i], a.high[i], score[i], found[i])

        for batch in batches:
            size = np.asarray(batch.column("vector").value_lengths())
            for d in np.unique(size):
                if int(d) in groups:
                    some = batch.take(pa.array(np.flatnonzero(size == d)))
                    x = np.asarray(some.column("vector").flatten(), np.float64).reshape(some.num_rows, int(d))
                    columns = [np.asarray(some.column(c)) for c in ("row", "vec_id", "label")]
                    for low in range(0, len(x), BLOCK):
                        waiting.setdefault(int(d), []).append([c[low : low + BLOCK] for c in (*columns, x)])
                        if sum(len(p[0]) for p in waiting[int(d)]) >= BLOCK:
                            work(int(d))
        for d in list(waiting):
            work(d)
        for d, (score, found) in best.items():
            a, w, k = np.nonzero(score > -math.inf)
            if len(a):
                values = [max(-MOST, min(MOST, int(s))) for s in score[a, w, k]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": groups[d].row[a],
                        "w": w.astype(np.int32),
                        "found": found[a, w, k],
                        "score": pa.array(values, pa.int64() if exact else pa.decimal128(38)),
                    }
                )

    return run


def _best(found: DataFrame) -> DataFrame:
    """``TOP`` rows of every window, over what the tasks returned."""
    order = Window.partitionBy("anchor", "w").orderBy(F.col("score").desc(), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _as_long(score: Column) -> Column:
    """The score, or the end of the range of a long that it lies beyond."""
    most = 2**63 - 1
    high, low = score.cast("decimal(38,0)") > most, score.cast("decimal(38,0)") < -most
    return F.when(high, F.lit(most)).when(low, F.lit(-most)).otherwise(score.try_cast("long"))


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` rows that take part, each once."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    return rows.where(known & F.coalesce(fine, F.lit(False))).distinct()


def _anchor_groups(rows: list, windows: dict) -> dict[int, tuple]:
    """Collected anchors of a pass by length, with a list of (low, high) each."""
    groups: dict[int, list] = {}
    for r in rows:
        groups.setdefault(len(r.vector), []).append((r.row, r.label, r.vector, windows.get(r.row, [])))
    return groups


def _packed(groups: dict[int, list], exact: bool, dtype) -> dict[int, Anchors]:
    out = {}
    for d, rows in groups.items():
        width = max((len(r[3]) for r in rows), default=0)
        low = np.full((len(rows), width), math.inf, dtype)  # no window: nothing fits
        high = np.full((len(rows), width), -math.inf, dtype)
        for i, r in enumerate(rows):
            for w, (a, b) in enumerate(r[3]):
                low[i, w], high[i, w] = a, b
        x = whole(np.array([r[2] for r in rows], np.float64).reshape(len(rows), d), exact)
        out[d] = Anchors(
            np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), x, low, high
        )
    return out


def mine(
    rows: DataFrame, is_anchor: Column, anchors_per_pass: int = ANCHORS, rows_per_task: int = BLOCK
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id long, label long, vector array<double>``; ``is_anchor`` marks the anchors.
    """
    spark = rows.sparkSession
    good = stage(usable(rows).withColumn("row", F.monotonically_increasing_id()), "hard-rows")
    n, n_anchors, width, largest = good.agg(
        F.count("*"),
        F.count_if(is_anchor),
        F.max(F.size("vector")),
        F.max(F.array_max(F.transform("vector", F.abs))),
    ).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], schema)
    # every sum of products is a whole number that doubles hold exactly
    exact = (SCALE * (largest or 0) + 1) ** 2 * max(width, 1) < 2.0**53
    dtype = np.float64 if exact else object
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(math.ceil(n / rows_per_task), most))
    dealt = good.withColumn("task", F.pmod(F.xxhash64(F.lit(13), "row"), F.lit(tasks)))
    dealt = dealt.repartitionById(tasks, F.col("task").cast("int")).select("row", "vec_id", "label", "vector")
    passes = math.ceil(n_anchors / anchors_per_pass)
    found_schema = f"anchor long, w int, found long, score {'long' if exact else 'decimal(38,0)'}"
    names = good.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    done = []
    for number in range(passes):  # of about ``anchors_per_pass`` rows
        of_pass = F.pmod(F.xxhash64(F.lit(17), "row"), F.lit(passes))
        anchors = good.where(is_anchor & (of_pass == number)).select("row", "label", "vector").collect()
        if not anchors:
            continue

        def scan(windows: dict, same_label: bool) -> DataFrame:
            groups = _packed(_anchor_groups(anchors, windows), exact, dtype)
            shared = spark.sparkContext.broadcast(groups)
            return stage(dealt.mapInArrow(_scan(shared, exact, same_label, dtype), found_schema), "hard-found")

        every = {r.row: [(-math.inf, math.inf)] for r in anchors}
        positives = stage(_best(scan(every, True)), "hard-positives")
        windows: dict[int, list] = {}
        for r in positives.orderBy("anchor", "rank").collect():  # TOP a row of the pass at most
            windows.setdefault(r.anchor, []).append((-(-EASE * int(r.score) // FULL), int(r.score)))
        negatives = _best(scan(windows, False))
        of = positives.select(
            "anchor",
            (F.col("rank") - 1).alias("w"),
            F.col("found").alias("positive_id"),
            F.col("score").alias("positive_score"),
        )
        both = negatives.join(of, ["anchor", "w"]).join(names, "anchor")
        done.append(both.withColumns({c: _as_long(F.col(c)) for c in ("score", "positive_score")}))
    if not done:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, done).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("found").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def hard_negatives(df: DataFrame, id_col="vec_id", vector="embedding", label="label") -> DataFrame:
    """Hard negatives of every hundredth id, where every seventh id has its label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    ).withColumn("label", moved)
    return mine(rows, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k
  FROM s WHERE same QUALIFY k <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
