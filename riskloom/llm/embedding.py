"""Near duplicates of vectors by inverted lists and product quantisation.

1. Equal vectors of a label are collapsed to the smallest id, with their number.
2. A coarse codebook (spherical k-means) and, for each of ``PARTS`` subspaces, a codebook of
   residuals are fitted on at most ``FIT_ROWS`` vectors; the number of lists follows the number of
   vectors (half its square root, 16 to 4096).
3. Every vector is put in the list of its best centroid, with its residual's codes and the distance
   between the vector and its code (``slack``).
4. A vector ``x`` of list ``a`` probes list ``b`` where ``x.a - x.b <= share * reach * |a - b| / 2``;
   ``reach`` is the largest distance of linked unit vectors. For a link ``x, y`` between the lists the
   two gaps add up to ``(x - y).(a - b)``, which is at most ``reach * |a - b|``; so with a share of 1 one of
   the two vectors probes the other's list, and no link is lost. The residuals of a sample tell in how many
   directions they spread; differences rarely lie along one of many, so the share is ``SPREAD`` over the
   root of that number where this is below 1. Where both vectors probe, the smaller id does, so a
   pair is judged once.
5. Lists and probes meet in blocks of ``CHUNK`` by ``CHUNK`` rows. Table-lookup distances to the codes
   are compared with the distance that the threshold allows plus the slack, which by the triangle
   inequality drops no link; what is left is ranked by exact cosine in double precision.
6. A block returns counts of links per vector and links that join components, never all pairs.

The only loss is a link of which neither vector probes the other's list; recall is measured in the tests.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
without a label, link with nothing and are kept; vectors link within their length
only, each length with an index of its own; repeated rows (equal ids) count as one vector per distinct value;
a null id links with nothing; an empty table gives an empty result. Only the named columns are
read, so other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from riskloom.llm.components import components
from riskloom.operators.staging import stage

THRESHOLD = 0.93
FIT_ROWS = 20_000
PARTS, CODES = 8, 256
SPREAD = 4.5  # standard deviations of a difference along one direction that probes allow for
CHUNK = 1024
ROUNDS = 8
SMALL_LISTS = 50_000  # lists (of a label) whose sizes are sent to all executors; more are joined


@dataclass
class Index:
    centroids: np.ndarray  # lists x dimensions, unit length
    codebook: np.ndarray  # parts x codes x dimensions of a part
    cuts: np.ndarray  # of the dimensions into parts
    gaps: np.ndarray  # lists x lists, how much worse a probed list may be than a vector's own

    def encode(self, x: np.ndarray):
        """List, codes and slack of unit vectors."""
        near = (x @ self.centroids.T).argmax(1)
        rest = x - self.centroids[near]
        codes = np.empty((len(x), len(self.codebook)), np.uint8)
        error = np.zeros(len(x))
        for p, book in enumerate(self.codebook):
            part = rest[:, self.cuts[p] : self.cuts[p + 1]]
            gap = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            codes[:, p] = gap.argmin(1)
            error += np.maximum(gap.min(1), 0)
        return near, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, near: np.ndarray) -> list[np.ndarray]:
        """Lists to search for each row, its own (``near``) among them."""
        cosine = x @ self.centroids.T
        worse = cosine[np.arange(len(x)), near][:, None] - cosine
        return [np.flatnonzero(some).astype(np.int32) for some in worse <= self.gaps[near]]

    def tables(self, x: np.ndarray, cell: int) -> np.ndarray:
        """(rows, parts, codes) squared distances of the rows' residuals in a list to every code."""
        rest = x - self.centroids[cell]
        out = np.empty((len(x), len(self.codebook), len(self.codebook[0])), np.float32)
        for p, book in enumerate(self.codebook):
            part = rest[:, self.cuts[p] : self.cuts[p + 1]]
            out[:, p] = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        gap = (c**2).sum(1) - 2 * x @ c.T
        near = gap.argmin(1)
        count = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        some = count > 0
        c[some] = sums[some] / count[some, None]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    # a power of two changes no digit and keeps squares of very large and very small numbers in range
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _share(rest: np.ndarray, spread: float) -> float:
    """Part of the certain gap that is allowed, by the number of directions in which residuals spread."""
    variance = np.linalg.eigvalsh(rest.T @ rest)
    directions = variance.sum() ** 2 / max((variance**2).sum(), 1e-300)
    return min(1.0, spread / np.sqrt(max(directions, 1.0)))


def fit(sample: np.ndarray, n_vectors: int, threshold: float, spread: float = SPREAD, seed: int = 7) -> Index:
    rng = np.random.default_rng(seed)
    lists = int(min(max(16, np.sqrt(n_vectors) / 2), 4096, max(1, len(sample))))
    dims = sample.shape[1]
    cuts = np.linspace(0, dims, min(PARTS, dims) + 1).astype(int)
    centroids = _kmeans(sample, lists, rng, True)
    rest = sample - centroids[(sample @ centroids.T).argmax(1)]
    some = rest[rng.permutation(len(rest))[:8192]]
    books = [_kmeans(some[:, a:b], min(CODES, len(some)), rng, False) for a, b in zip(cuts, cuts[1:])]
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    gaps = _share(rest, spread) * _reach(threshold) * apart / 2 + 1e-9
    return Index(centroids, books, cuts, gaps)


def _reach(threshold: float) -> float:
    """Largest distance of two unit vectors that are linked."""
    return np.sqrt(max(0.0, 2 - 2 * threshold))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _coded(index):
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                x = _unit(_matrix(part.column("vector")))
                near, codes, slack = index.value.encode(x)
                yield pa.RecordBatch.from_pydict(
                    {
                        "rep": part.column("rep"),
                        "label": part.column("label"),
                        "copies": part.column("copies"),
                        "vector": part.column("vector"),
                        "cell": near.astype(np.int32),
                        "codes": pa.array([c.tobytes() for c in codes], pa.binary()),
                        "slack": slack,
                        "probes": pa.array(index.value.probes(x, near), pa.list_(pa.int32())),
                    }
                )

    return run


def _block(index, threshold: float):
    """Links between the probing rows and the list rows of one block."""

    def work(key: tuple, probing: pa.Table, listed: pa.Table) -> pa.Table:
        empty = pa.table(
            {n: pa.array([], pa.int64()) for n in ("node", "weight", "a", "b")}
        )
        if not probing.num_rows or not listed.num_rows:
            return empty
        cell = key[1].as_py()
        q, y = _unit(_matrix(probing.column("vector"))), _unit(_matrix(listed.column("y_vector")))
        rep_q, rep_y = np.asarray(probing.column("rep")), np.asarray(listed.column("y_rep"))
        n_q, n_y = np.asarray(probing.column("copies")), np.asarray(listed.column("y_copies"))
        codes = np.frombuffer(b"".join(listed.column("codes").to_pylist()), np.uint8)
        codes = codes.reshape(len(y), -1).astype(np.int64)
        limit = (_reach(threshold) + np.asarray(listed.column("slack"))) ** 2 + 1e-5
        home, lists = np.asarray(probing.column("home")).astype(np.int64), len(index.value.centroids)
        back = listed.column("y_probes").combine_chunks()  # lists that the listed rows probe themselves
        searched = np.repeat(np.arange(len(y)), pa.compute.list_value_length(back)) * lists
        searched = searched + np.asarray(back.flatten())
        left, right = [], []
        for low in range(0, len(q), 128):
            tables = index.value.tables(q[low : low + 128], cell)
            far = np.zeros((len(tables), len(y)), np.float32)
            for p in range(codes.shape[1]):
                far += tables[:, p][:, codes[:, p]]
            i, j = np.nonzero(far <= limit)
            left.append(i + low)
            right.append(j)
        left, right = np.concatenate(left), np.concatenate(right)
        sure = np.empty(len(left), bool)
        for low in range(0, len(left), 65536):
            some = slice(low, low + 65536)
            sure[some] = np.einsum("ij,ij->i", q[left[some]], y[right[some]]) >= threshold
        left, right = left[sure], right[sure]
        mine = rep_q[left] < rep_y[right]  # a listed row of a larger id is this row's to find; one of a smaller id
        mine |= (rep_q[left] != rep_y[right]) & ~np.isin(right * lists + home[left], searched)  # only if it does not look here
        left, right = left[mine], right[mine]
        weight_q = np.bincount(left, n_y[right], len(q)).astype(np.int64)
        weight_y = np.bincount(right, n_q[left], len(y)).astype(np.int64)
        joined = _forest(left, right, len(q), len(y))
        a, b = rep_q[left[joined]], rep_y[right[joined]]
        some_q, some_y = weight_q > 0, weight_y > 0
        node = np.concatenate((rep_q[some_q], rep_y[some_y]))
        weight = np.concatenate((weight_q[some_q], weight_y[some_y]))
        gap = len(a)
        return pa.table(
            {
                "node": pa.array(np.append(node, np.zeros(gap, np.int64)), mask=np.arange(len(node) + gap) >= len(node)),
                "weight": pa.array(np.append(weight, np.zeros(gap, np.int64)), pa.int64()),
                "a": pa.array(np.append(np.zeros(len(node), np.int64), a), mask=np.arange(len(node) + gap) < len(node)),
                "b": pa.array(np.append(np.zeros(len(node), np.int64), b), mask=np.arange(len(node) + gap) < len(node)),
            }
        )

    return work


def _forest(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> np.ndarray:
    """Numbers of links that join all that the links join (each node's smallest label, repeated)."""
    label = np.arange(n_left + n_right)
    right = right + n_left
    keep = []
    while len(left):
        x, y = label[left], label[right]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            break
        high, low = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        order = np.lexsort((low, high))
        first = order[np.diff(high[order], prepend=-1) != 0]
        keep.append(apart[first])
        up = np.arange(len(label))
        up[high[first]] = low[first]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    return np.concatenate(keep) if keep else np.zeros(0, int)


def vectors(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, vector`` of rows that can link."""
    narrow = df.select(vector).schema[0].dataType == ArrayType(FloatType())
    kind = "array<float>" if narrow else "array<double>"  # floats travel as floats and are compared as doubles
    rows = df.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label).cast("string").alias("label"),
        F.col(vector).cast(kind).alias("vector"),
    )
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(fine, F.lit(False))
        & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    )


def near_duplicates(
    df: DataFrame,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    spark = df.sparkSession
    good = stage(vectors(df, id_col, vector, label).distinct(), "vectors")
    reps = stage(
        good.groupBy("label", "vector")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("rep_key", F.xxhash64("label", "vector")),
        "vector-reps",
    )
    size = reps.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    found = spark.createDataFrame([], "node long, weight long, a long, b long")
    for of in size.where("n > 1").orderBy("d").collect():  # a row per vector length
        same = reps.where(F.size("vector") == of.d)
        picked = same.orderBy(F.xxhash64(F.lit(7), "rep", "vector")).limit(FIT_ROWS).select("vector")
        sample = _unit(_matrix(picked.toArrow().column("vector")))
        index = spark.sparkContext.broadcast(fit(sample, of.n, threshold))
        kind = reps.schema["vector"].dataType.simpleString()
        schema = (
            f"rep long, label string, copies long, vector {kind}, cell int, codes binary,"
            " slack double, probes array<int>"
        )
        rows = same.select("rep", "label", "copies", "vector")
        coded = stage(rows.mapInArrow(_coded(index), schema), "vector-codes")
        found = found.unionByName(stage(_blocks(coded, index, threshold), "vector-links"))
    counts = found.where("node is not null").groupBy("node").agg(F.sum("weight").alias("others"))
    joined = components(found.where("a is not null").select("a", "b"))
    of_rep = (
        reps.select("rep", "rep_key", "label", "vector", "copies")
        .join(counts.withColumnRenamed("node", "rep"), "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "rep_key",
            "label",
            "vector",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = (
        good.withColumn("rep_key", F.xxhash64("label", "vector"))
        .join(of_rep, ["rep_key", "label", "vector"])
        .groupBy("vec_id")
        .agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    )
    every = df.select(F.col(id_col).cast("long").alias("vec_id"))
    out = every.join(linked, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _blocks(coded: DataFrame, index, threshold: float) -> DataFrame:
    """Lists and probes dealt into blocks that meet pairwise."""
    probing = coded.select(
        "rep", "label", "copies", "vector", F.col("cell").alias("home"), F.explode("probes").alias("cell")
    )
    listed = coded.select("rep", "label", "copies", "vector", "cell", "codes", "slack", "probes").toDF(
        "y_rep", "y_label", "y_copies", "y_vector", "y_cell", "codes", "slack", "y_probes"
    )  # names of their own: both sides of the meeting come from one table
    n_listed = coded.groupBy("label", "cell").agg(F.count("*").alias("n_y"))
    n_probing = probing.groupBy("label", "cell").agg(F.count("*").alias("n_q"))
    parts = n_listed.join(n_probing, ["label", "cell"]).select(
        "label",
        "cell",
        F.ceil(F.col("n_y") / CHUNK).cast("int").alias("k_y"),
        F.ceil(F.col("n_q") / CHUNK).cast("int").alias("k_q"),
    )
    parts = stage(parts, "vector-lists")
    few = parts.count() <= SMALL_LISTS  # rows of a label and three whole numbers

    def dealt(rows: DataFrame, side: str, own: str, other: str, i: str, j: str) -> DataFrame:
        keys = parts.select(
            F.col("label").alias(f"{side}label"), F.col("cell").alias(f"{side}cell"), "k_y", "k_q"
        )
        return rows.join(F.broadcast(keys) if few else keys, [f"{side}label", f"{side}cell"]).select(
            *rows.columns,
            F.pmod(F.xxhash64(F.lit(3), f"{side}rep"), F.col(own)).cast("int").alias(i),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(j),
        )

    x = dealt(probing, "", "k_q", "k_y", "i", "j").groupBy("label", "cell", "i", "j")
    y = dealt(listed, "y_", "k_y", "k_q", "y_j", "y_i").groupBy("y_label", "y_cell", "y_i", "y_j")
    schema = "node long, weight long, a long, b long"
    return x.cogroup(y).applyInArrow(_block(index, threshold), schema)


ORACLE_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y
  ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.93
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.vec_id, links.b FROM reach r JOIN links ON links.a = r.other
), counted AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(max(n), 0) AS n_links, min(other) AS component_id,
       e.vec_id = min(other) AS kept
FROM embeddings e JOIN reach USING (vec_id) LEFT JOIN counted USING (vec_id) GROUP BY e.vec_id
"""
