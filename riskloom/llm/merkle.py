"""Merkle manifest of a table: a hash tree per group, a tree over the groups, a proof for every row.

1. A row's leaf is the hash of its fields, each written with its byte length. The leaves of a group
   ascend by id; a range partitioning and one count per partition number them.
2. Every ``FANOUT`` consecutive nodes of a tree become their hash, level by level, until one is left:
   the group's subroot. The subroots, ordered by group, are the leaves of the top tree.
3. Proofs come by pointer jumping. A node holds the steps (the siblings left and right of the way)
   towards an ancestor, at first its parent. Each round joins the nodes to the nodes they point at,
   takes over their pointers and appends their steps, so the distance doubles until all point at the
   root. The leaves of a run share all but their first step: the run jumps as one row, and a leaf's own
   first step is put in front of the run's when all have arrived. So proofs never move as rows of
   leaves, and what does move is an eighth of them.

The ancestors that a round can reach are at least as high as the distance; they are counted, and
broadcast below ``BROADCAST_NODES``. Where they are more, no ancestor is pointed at by more than
``FANOUT`` to the power of the distance, and the join needs no help.

Edge cases: null fields are written ``-``; a null group is a group of its own, the first; null ids come
first; rows of equal ids are ordered by their leaves, and equal rows each have a leaf; a group of one
row has its leaf as subroot, a table of one group its subroot as root, and steps without siblings are
kept (hashing a lone node again); a row whose proof has no siblings has the hash of nothing; an empty
table gives an empty result. Only the named columns are read; carried columns travel inside a struct, so
any names may occur.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.skew import small_enough
from riskloom.operators.staging import stage

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BROADCAST_NODES = 5_000  # ancestors, a few kilobytes of steps each
LOCAL_BITS = 33  # of monotonically_increasing_id
TOP = "t"  # the tree of subroots; trees of groups are "n" (null) and "s..."
STEP = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def written(field: Column) -> Column:
    """``-`` for null, else the byte length, a colon and the value."""
    value = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return digest(F.concat(*[written(f) for f in fields]))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tree(group: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("n"))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (staged, with ``tree``) with their place ``idx`` in the tree and its number of rows ``n``."""
    by = ["tree", *order]
    placed = stage(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("serial", F.monotonically_increasing_id()),
        "merkle-placed",
    ).withColumn("part", F.shiftright("serial", LOCAL_BITS))
    # a row for each partition that a tree reaches into
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = stage(
        placed.groupBy("tree", "part")
        .agg(F.count("*").alias("here"), F.min("serial").alias("first"))
        .withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
        .withColumn("n", F.sum("here").over(Window.partitionBy("tree"))),
        "merkle-shares",
    ).drop("here")
    return (
        placed.join(small_enough(shares, shares.count()), ["tree", "part"])
        .withColumn("idx", F.col("serial") - F.col("first") + F.col("before"))
        .drop("serial", "part", "first", "before")
    )


def _runs(nodes: DataFrame, member: Sequence[str], fanout: int) -> DataFrame:
    """Every ``fanout`` nodes of a tree as one node of the next level."""
    members = F.array_sort(F.collect_list(F.struct("idx", *member)))
    run = F.floor(F.col("idx") / fanout).cast("long")
    return (
        nodes.groupBy("tree", run.alias("idx"))
        .agg(members.alias("members"), F.max("n").alias("n"))
        .withColumn("n", F.ceil(F.col("n") / fanout).cast("long"))
        .withColumn("digest", digest(F.array_join(F.transform("members", lambda m: m["digest"]), "")))
    )


def _grow(first: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels above the runs ``first``, each staged, as long as a tree has several nodes."""
    levels, at = [], first
    most = first.agg(F.max("n")).first()[0] or 1
    while most > 1:
        at = stage(_runs(at.where("n > 1"), ["digest"], fanout), "merkle-level")
        levels.append(at)
        most = -(-most // fanout)
    return levels


def _sides(members: Column, place: Column) -> Column:
    """The step of one member: the digests left and right of it."""
    hexes = F.transform(members, lambda m: m["digest"])
    left = F.array_join(F.slice(hexes, F.lit(1), place), "")
    right = F.array_join(F.slice(hexes, place + 2, F.size(hexes)), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _to_parents(runs: DataFrame, level: int) -> DataFrame:
    """For every member of the runs (nodes of ``level - 1``): its parent and its step."""
    one = runs.select("tree", "idx", "members", F.posexplode("members").alias("place", "member"))
    return one.select(
        "tree",
        F.lit(level - 1).alias("level"),
        F.col("member.idx").alias("idx"),
        F.col("tree").alias("p_tree"),
        F.lit(level).alias("p_level"),
        F.col("idx").alias("p_idx"),
        F.array(_sides(F.col("members"), F.col("place"))).alias("steps"),
    )


def _jump(jumps: DataFrame, root: tuple, fanout: int) -> DataFrame:
    """Pointer jumping: every node's steps to the root."""
    at_root = (
        (F.col("p_tree") == root[0]) & (F.col("p_level") == root[1]) & (F.col("p_idx") == root[2])
    )
    distance = 1
    while True:
        far = jumps.where(~at_root)
        if far.isEmpty():
            return jumps
        high = jumps.where((F.col("tree") == TOP) | (F.col("level") > distance))
        named = high.toDF(*[f"a_{c}" for c in high.columns])
        few = high.count() <= BROADCAST_NODES
        same = [F.col(f"p_{c}") == F.col(f"a_{c}") for c in ("tree", "level", "idx")]
        further = far.join(F.broadcast(named) if few else named, reduce(Column.__and__, same)).select(
            "tree",
            "level",
            "idx",
            F.col("a_p_tree").alias("p_tree"),
            F.col("a_p_level").alias("p_level"),
            F.col("a_p_idx").alias("p_idx"),
            F.concat("steps", "a_steps").alias("steps"),
        )
        jumps = stage(jumps.where(at_root).unionByName(further), "merkle-jumps")
        distance *= 2


def proofs(leaves: DataFrame, carry: Sequence[str] = (), fanout: int = FANOUT) -> DataFrame:
    """Leaves (``tree, id, digest`` and carried columns) with ``subroot, root, steps``.

    ``steps`` is an array of (left, right) hex texts from the leaf to the root; :func:`fold` and
    :func:`proof_digest` read it.
    """
    spark = leaves.sparkSession
    out = ["tree", "id", "digest", *carry]
    leaves = stage(leaves.select(*out), "merkle-leaves")
    places = numbered(leaves, ["id", "digest"])
    lone = places.where("n = 1").select(
        "tree", F.lit(0).alias("level"), "idx", "n", "digest", F.array(F.struct("idx", *out[1:])).alias("members")
    )
    runs = _runs(places.where("n > 1"), out[1:], fanout).withColumn("level", F.lit(1))
    base = stage(lone.unionByName(runs), "merkle-runs")
    levels = _grow(base.where("level = 1").select("tree", "idx", "n", "digest"), fanout)
    tops = [base.select("tree", "level", "n", "digest")]
    tops += [r.select("tree", F.lit(k).alias("level"), "n", "digest") for k, r in enumerate(levels, 2)]
    subroots = stage(
        reduce(DataFrame.unionByName, tops).where("n = 1").select("tree", "level", "digest"), "merkle-subroots"
    )
    jumps = [_to_parents(r, k) for k, r in enumerate(levels, 2)]
    n_trees = subroots.count()
    if n_trees < 2:
        top = subroots.first()
        root, root_digest = (top.tree, top.level, 0) if top else (TOP, 0, 0), top and top.digest
    else:
        ranked = numbered(
            subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "level", "digest"), ["of"]
        )
        first = stage(_runs(ranked, ["digest", "of", "level"], fanout), "merkle-level")
        upper = [first, *_grow(first.select("tree", "idx", "n", "digest"), fanout)]
        root, root_digest = (TOP, len(upper), 0), upper[-1].first().digest
        one = first.select("tree", "idx", "members", F.posexplode("members").alias("place", "member"))
        jumps.append(  # a subroot is a leaf of the top tree
            one.select(
                F.col("member.of").alias("tree"),
                F.col("member.level").alias("level"),
                F.lit(0).cast("long").alias("idx"),
                F.col("tree").alias("p_tree"),
                F.lit(1).alias("p_level"),
                F.col("idx").alias("p_idx"),
                F.array(_sides(F.col("members"), F.col("place"))).alias("steps"),
            )
        )
        jumps += [_to_parents(r, k) for k, r in enumerate(upper[1:], 2)]
    none = spark.createDataFrame(
        [], f"tree string, level int, idx long, p_tree string, p_level int, p_idx long, steps {STEP}"
    )
    ways = _jump(stage(reduce(DataFrame.unionByName, jumps, none), "merkle-jumps"), root, fanout)
    ways = ways.where("level <= 1").select("tree", "level", "idx", F.col("steps").alias("way"))
    subroots = subroots.select("tree", F.col("digest").alias("subroot"))
    each = (
        base.drop("n", "digest")
        .join(ways, ["tree", "level", "idx"], "left")
        .join(small_enough(subroots, n_trees), "tree")
        .select("*", F.posexplode("members").alias("place", "member"))
    )
    own = F.when(F.col("level") == 1, F.array(_sides(F.col("members"), F.col("place"))))
    empty = F.array().cast(STEP)
    return each.select(
        "tree",
        *[F.col(f"member.{c}").alias(c) for c in out[1:]],
        "subroot",
        F.lit(root_digest).cast("string").alias("root"),
        F.concat(F.coalesce(own, empty), F.coalesce("way", empty)).alias("steps"),
    )


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(
        steps, start, lambda h, s: digest(F.concat(s["left"], h, s["right"]))
    )


def proof_digest(steps: Column) -> Column:
    """One hash over all siblings of a proof, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group: str = "lang",
    altered: Mapping[str, Column] | None = None,
    when: Column | None = None,
) -> DataFrame:
    """``doc_id, lang (as its tree), leaf, subroot, root, steps, folded_root, verified`` for every row.

    ``altered`` replaces fields of the rows for which ``when`` holds before their proofs are checked: the
    check of a copy against the manifest. Without it every row is checked as it is.
    """
    columns = {f: F.col(f) for f in fields}
    changed = leaf([(altered or {}).get(f, c) for f, c in columns.items()])
    seen = F.when(when, changed) if altered and when is not None else F.lit(None).cast("string")
    leaves = docs.select(
        _tree(F.col(group)).alias("tree"),
        F.col(id_col).alias("id"),
        leaf(list(columns.values())).alias("digest"),
        seen.alias("seen"),
    )
    done = proofs(leaves, ["seen"])
    folded = fold(F.coalesce("seen", "digest"), F.col("steps"))
    return done.select(
        F.col("id").alias(id_col),
        "tree",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "steps",
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def tamper_report(docs: DataFrame) -> DataFrame:
    """The manifest's digests, and what becomes of them when a third of the texts is put in lower case."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    done = manifest(docs, altered={"text": lowered(F.col("text"))}, when=third)
    return done.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("steps")).alias("proof_sha256"),
        "folded_root",
        "verified",
    )


def _oracle(depth: int = 8) -> str:
    """DuckDB SQL of :func:`tamper_report` for trees of at most ``depth`` levels."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = " || ".join(field.format(f) for f in FIELDS)
    altered = " || ".join(field.format(low if f == "text" else f) for f in FIELDS)
    crc = (
        "xor(list_reduce(flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: "
        "[ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), "
        "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) "
        "ELSE c >> 1 END, 4294967295), 4294967295)"
    )
    sides = (
        "coalesce(string_agg(h, '') OVER (PARTITION BY tree, idx // 8 ORDER BY idx "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
        "coalesce(string_agg(h, '') OVER (PARTITION BY tree, idx // 8 ORDER BY idx "
        "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
    )
    parts = [
        f"base AS (SELECT doc_id, lang AS tree, sha256({plain}) AS leaf, "
        f"CASE WHEN {crc} % 3 = 0 THEN sha256({altered}) ELSE sha256({plain}) END AS seen FROM documents)",
        "g0 AS (SELECT coalesce('s' || tree, 'n') AS tree, doc_id, leaf, seen, leaf AS h, row_number() OVER "
        "(PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, "
        "count(*) OVER (PARTITION BY tree) AS n FROM base)",
    ]

    def levels(name: str) -> None:
        for k in range(depth):
            parts.append(f"{name}{k}s AS (SELECT tree, idx, n, h, {sides} FROM {name}{k})")
            parts.append(
                f"{name}{k + 1} AS (SELECT tree, idx // 8 AS idx, (max(n) + 7) // 8 AS n, "
                f"CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE max(h) END AS h "
                f"FROM {name}{k} GROUP BY tree, idx // 8)"
            )

    levels("g")
    parts.append(
        "t0 AS (SELECT 't' AS tree, tree AS of_tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, "
        f"count(*) OVER () AS n FROM g{depth})"
    )
    levels("t")
    parts.append(
        "f0 AS (SELECT doc_id, leaf, seen AS h, '' AS proof, tree, idx, h AS own FROM g0)"
    )

    def climb(name: str, start: int, own: str) -> None:
        for k in range(depth):
            parts.append(
                f"f{start + k + 1} AS (SELECT f.doc_id, f.leaf, {own} f.tree, f.idx // 8 AS idx, "
                "CASE WHEN s.n > 1 THEN sha256(s.l || f.h || s.r) ELSE f.h END AS h, "
                "CASE WHEN s.n > 1 THEN f.proof || s.l || s.r ELSE f.proof END AS proof "
                f"FROM f{start + k} f JOIN {name}{k}s s ON s.tree = f.tree AND s.idx = f.idx)"
            )

    climb("g", 0, "")
    parts.append(
        f"f{depth + 1} AS (SELECT doc_id, leaf, t0.h AS subroot, t0.tree, t0.idx, f.h, proof "
        f"FROM f{depth} f JOIN t0 ON t0.of_tree = f.tree)"
    )
    climb("t", depth + 1, "f.subroot,")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, "
        f"f.h AS folded_root, f.h = t.h AS verified FROM f{2 * depth + 1} f CROSS JOIN t{depth} t"
    )


ORACLE_SQL = _oracle()
