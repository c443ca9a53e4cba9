"""Near duplicates by BagMinHash: weighted minwise signatures of five-word windows.

A text is a bag of windows of five words; likeness is the weighted Jaccard index of two bags (sum of
the smaller counts over the sum of the larger). For each window a Poisson process over (time, weight)
is drawn from its hash: weights are cut at the powers of two, each stretch has a process of its own
whose rate follows its width, and a point counts for a bag whose weight exceeds the point's. The
earliest counting point of each of ``SIZE`` signature places is kept; two bags agree in a place with
a probability equal to their likeness. A process stops as soon as its time exceeds the latest place.

1. Copies (equal word sequences, 128-bit key) are collapsed to the smallest id.
2. Signatures are cut into ``BANDS`` bands; texts that share a band value form a bucket.
3. In each bucket every member is compared with one leader, the member of the most crowded buckets.
   Buckets whose members are then still in several components are searched whole, so no candidate
   link is lost: up to ``FEW`` members pair by pair, more in blocks within a task, which returns only
   links that join components. Signatures rule out pairs far below the threshold; the rest is
   verified on the whole texts.
4. Links are joined into components.

At likeness 0.8 a pair is missed by all bands with probability 3e-6.

Edge cases: texts without words resemble nothing; texts of fewer than five words are one window;
rows without an id are compared with nothing and form no class; texts of one id that differ are
distinct nodes, linked or not by what they say; repeated rows are copies; an empty table gives an empty result. Only
the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import components
from riskloom.llm.text_batches import (
    SLICE_BYTES,
    SpanHasher,
    map_texts,
    mix64,
    shingles,
    span_hashes,
    text_bytes,
    unit,
    word_spans,
)
from riskloom.operators.staging import stage

BANDS, BAND_ROWS = 32, 5
SIZE = BANDS * BAND_ROWS
THRESHOLD = 0.8
FEW, CHUNK = 8, 256  # members of a bucket that are paired one by one; members of a side of a block
CLEARLY_LESS = 0.67  # share of equal signature places: four standard errors below the threshold


def _bags(column: pa.Array, hasher: SpanHasher):
    """Rows, windows and counts of a text column; also the words and their rows."""
    data, at = text_bytes(column)
    start, end, row = word_spans(data, at)
    words = span_hashes(data, start, end, hasher)
    window, of = shingles(words, row, len(at) - 1)
    order = np.lexsort((window, of))
    window, of = window[order], of[order]
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1]) | (of[1:] != of[:-1])
    count = np.diff(np.append(np.flatnonzero(new), len(window)))
    return of[new], window[new], count, words, row, len(at) - 1


def signatures(row: np.ndarray, item: np.ndarray, count: np.ndarray, n_rows: int) -> np.ndarray:
    """(rows, SIZE) earliest times; rows without items are infinite."""
    # one process for each item and stretch of weight [0,1), [1,2), [2,4), [4,8) ... below its count
    stretches = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    which = np.repeat(np.arange(len(item)), stretches)
    level = np.arange(len(which)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.maximum(low, 1.0)
    of, top = row[which], count[which].astype(float)
    seed = mix64(item[which] + level.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    time = np.zeros(len(which))
    best, latest = np.full(n_rows * SIZE, np.inf), np.full(n_rows, np.inf)
    step = 0
    while len(of):
        step += 1
        draw = mix64(seed + np.uint64(step * 0x9FB21C651E98DF25 % 2**64))
        time = time - np.log(unit(draw)) / (SIZE * width)
        other = mix64(draw)
        place = ((other >> np.uint64(32)) * np.uint64(SIZE)) >> np.uint64(32)
        weight = low + np.floor((other & np.uint64(0xFFFFFFFF)) * 2.0**-32 * width)
        counts = weight < top
        np.minimum.at(best, of[counts] * SIZE + place[counts].astype(np.int64), time[counts])
        open_rows = of[np.flatnonzero(np.diff(of, prepend=-1))]  # ``of`` ascends
        latest[open_rows] = best.reshape(n_rows, SIZE)[open_rows].max(1)
        on = time < latest[of]
        if not on.all():
            of, low, width, top = of[on], low[on], width[on], top[on]
            seed, time = seed[on], time[on]
    return best.reshape(n_rows, SIZE)


def _sketch(part: pa.RecordBatch) -> dict:
    row, window, count, words, word_row, n = _bags(part.column("text"), SpanHasher(51))
    best = signatures(row, window, count, n)
    some = np.bincount(row, minlength=n) > 0
    bits = mix64(best.view(np.uint64))
    bands = np.zeros((n, BANDS), np.uint64)
    for k in range(BAND_ROWS):
        bands = mix64(bands * np.uint64(31) + bits[:, k::BAND_ROWS])
    bands = mix64(bands + np.arange(BANDS, dtype=np.uint64))
    # the sequence of words, as two 64-bit sums over (word, place)
    first = np.cumsum(np.bincount(word_row, minlength=n)) - np.bincount(word_row, minlength=n)
    nth = (np.arange(len(words)) - first[word_row]).astype(np.uint64)
    keys = []
    for salt in (np.uint64(3), np.uint64(5)):
        term = mix64(mix64(words + salt) + nth * np.uint64(0xD6E8FEB86659FD93))
        sums = np.concatenate(([0], np.cumsum(term, dtype=np.uint64)))
        total = np.bincount(word_row, minlength=n)
        keys.append(sums[first + total] - sums[first])
    small = (bits & np.uint64(0xFF)).astype(np.uint8)
    where = np.flatnonzero(some)
    flat = pa.ListArray.from_arrays(
        np.arange(len(where) + 1, dtype=np.int32) * BANDS, bands[where].ravel().view(np.int64)
    )
    return {
        "doc_id": part.column("doc_id").take(pa.array(where)),
        "text_key": part.column("text_key").take(pa.array(where)),
        "k1": keys[0][where].view(np.int64),
        "k2": keys[1][where].view(np.int64),
        "n": np.bincount(row, count, n).astype(np.int64)[where],
        "bands": flat,
        "sketch": pa.array([small[r].tobytes() for r in where], pa.binary()),
    }


def sketches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, k1, k2, n, bands, sketch`` of every row with an id and a word."""
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.xxhash64(F.col(text)).alias("text_key"),
    )
    schema = "doc_id long, text_key long, k1 long, k2 long, n long, bands array<long>, sketch binary"
    return map_texts(rows, _sketch, schema)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures do not rule them out."""
    for batch in batches:
        if batch.num_rows:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SIZE)
                for c in ("sa", "sb")
            )
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= CLEARLY_LESS))


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges [start, start + length) one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def shared_weight(
    own_a: np.ndarray, own_b: np.ndarray, texts_a: pa.Array, texts_b: pa.Array, hasher: SpanHasher
) -> np.ndarray:
    """Likeness of pairs of texts given by their numbers; every text is cut into words once."""
    bags, size = [], []
    for texts in (texts_a, texts_b):
        row, window, count, *_ = _bags(texts, hasher)
        bags.append((window, count))
        size.append(np.bincount(row, minlength=len(texts)))
    first = [np.cumsum(x) - x for x in size]
    names, code = np.unique(np.concatenate((bags[0][0], bags[1][0])), return_inverse=True)
    code_a, code_b = code[: len(bags[0][0])], code[len(bags[0][0]) :]
    count_a, count_b = bags[0][1], bags[1][1]
    weight = [
        np.diff(np.concatenate(([0], np.cumsum(c)))[np.append(f, len(c))])
        for c, f in zip((count_a, count_b), first)
    ]
    total = weight[0][own_a] + weight[1][own_b]
    both, table = np.zeros(len(own_a)), np.zeros(len(names), np.int64)
    order = np.argsort(own_b, kind="stable")
    cuts = np.flatnonzero(np.diff(own_b[order], prepend=-1))
    for low, high in zip(cuts, np.append(cuts[1:], len(order))):
        rows, b = order[low:high], own_b[order[low]]
        at = slice(first[1][b], first[1][b] + size[1][b])
        table[code_b[at]] = count_b[at]
        n = size[0][own_a[rows]]
        flat = _ragged(first[0][own_a[rows]], n)
        least = np.minimum(table[code_a[flat]], count_a[flat])
        both[rows] = np.bincount(np.repeat(np.arange(len(rows)), n), least, len(rows))
        table[code_b[at]] = 0
    return both / np.maximum(total - both, 1)


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = SpanHasher(51)
    for batch in batches:
        size = np.maximum(*(np.diff(text_bytes(batch.column(c))[1]) for c in ("ta", "tb")))
        ends = np.concatenate(([0], np.cumsum(size)))
        low = 0
        while low < batch.num_rows:
            to = max(low + 1, int(np.searchsorted(ends, ends[low] + SLICE_BYTES, "right")) - 1)
            part = batch.slice(low, to - low)
            low = to
            own, texts = [], []
            for side in ("a", "b"):
                ids = np.asarray(part.column(side))
                _, one, mine = np.unique(ids, return_index=True, return_inverse=True)
                own.append(mine)
                texts.append(part.column("t" + side).take(pa.array(one)))
            likeness = shared_weight(*own, *texts, hasher)
            yield part.select(["a", "b"]).filter(pa.array(likeness >= THRESHOLD - 1e-12))


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """Links between members of one bucket (two chunks of it) that are in different components.

    A pair is judged in the first band that it shares; links that close a ring are left out.
    """
    rows = rows.combine_chunks()
    x, y = (rows.filter(pa.array(np.asarray(rows.column(c)))) for c in ("in_x", "in_y"))
    band, same = key[0].as_py(), key[1].as_py() == key[2].as_py()

    def matrix(part, name, kind, width):
        column = part.column(name).combine_chunks()
        if kind is np.uint8:
            return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
        return np.asarray(column.flatten()).reshape(-1, width)

    rep_x, rep_y = np.asarray(x.column("rep")), np.asarray(y.column("rep"))
    group_x, group_y = np.asarray(x.column("component")), np.asarray(y.column("component"))
    n_x, n_y = np.asarray(x.column("n")), np.asarray(y.column("n"))
    bands_x, bands_y = (matrix(p, "bands", np.int64, BANDS) for p in (x, y))
    sketch_x, sketch_y = (matrix(p, "sketch", np.uint8, SIZE) for p in (x, y))
    left, right = [], []
    for i in range(len(rep_x)):
        may = np.minimum(n_y, n_x[i]) >= THRESHOLD * np.maximum(n_y, n_x[i]) - 1e-9
        may &= group_y != group_x[i]
        if same:
            may &= rep_y > rep_x[i]
        some = np.flatnonzero(may)
        some = some[(sketch_y[some] == sketch_x[i]).mean(1) >= CLEARLY_LESS]
        if len(some):
            first = (bands_y[some] == bands_x[i]).argmax(1)
            some = some[bands_x[i][first] == band]
        left.append(np.full(len(some), i))
        right.append(some)
    left = np.concatenate(left) if left else np.zeros(0, int)
    right = np.concatenate(right) if right else np.zeros(0, int)
    out_a, out_b = [], []
    if len(left):
        texts = (x.column("text").combine_chunks(), y.column("text").combine_chunks())
        linked = shared_weight(left, right, *texts, SpanHasher(51)) >= THRESHOLD - 1e-12
        root: dict[int, int] = {}

        def top(g: int) -> int:
            while root.get(g, g) != g:
                g = root[g]
            return g

        for i, j in zip(left[linked], right[linked]):
            p, q = top(int(group_x[i])), top(int(group_y[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out_a.append(min(int(rep_x[i]), int(rep_y[j])))
                out_b.append(max(int(rep_x[i]), int(rep_y[j])))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _verified(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike enough. ``known`` has rep, sketch and text."""
    sides = [
        known.select(F.col("rep").alias(s), F.col("sketch").alias("s" + s)) for s in ("a", "b")
    ]
    close = pairs.distinct().join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb")
    close = stage(close.mapInArrow(_agree, "a long, b long"), "near-pairs")
    texts = [known.select(F.col("rep").alias(s), F.col("text").alias("t" + s)) for s in ("a", "b")]
    both = close.join(texts[0], "a").join(texts[1], "b").select("a", "b", "ta", "tb")
    return stage(both.mapInArrow(_overlap, "a long, b long"), "near-links")


def _may(x: str, y: str):
    """Whether counts of windows allow the threshold."""
    return F.least(x, y) >= THRESHOLD * F.greatest(x, y) - F.lit(1e-9)


def distinct_texts(found: DataFrame) -> DataFrame:
    """A node ``rep`` for every word sequence of the staged :func:`sketches`, staged.

    ``first`` is the smallest (doc_id, text_key) of its rows. Ids do not name nodes: one id may have
    several texts.
    """
    reps = found.groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"),
        F.first("n").alias("n"),
        F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    return stage(reps.withColumn("rep", F.monotonically_increasing_id()), "near-reps")


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Verified links ``a, b`` between nodes that join every class.

    ``docs`` has doc_id and text, ``reps`` is :func:`distinct_texts`.
    """
    rows = reps.select("rep", "n", F.explode("bands").alias("band"))
    crowded = rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    buckets = stage(rows.join(crowded, "band"), "near-buckets")
    weight = buckets.groupBy("rep").agg(F.sum("members").alias("weight"))
    buckets = stage(buckets.join(weight, "rep").drop("members"), "near-weights")
    wanted = reps.join(weight.select("rep"), "rep", "left_semi").select(
        "rep", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")
    )
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    texts = texts.join(wanted, ["doc_id", "text_key"]).groupBy("rep").agg(F.min("text").alias("text"))
    known = stage(reps.select("rep", "bands", "sketch").join(texts, "rep"), "near-texts")

    def stars(members: DataFrame) -> DataFrame:
        """Pairs of each bucket's leader with its other members."""
        leader = members.groupBy("band").agg(
            F.max(F.struct("weight", (-F.col("rep")).alias("back"), F.col("n").alias("ln"))).alias("x")
        )
        return (
            members.join(leader, "band")
            .select(F.col("rep"), F.col("n"), (-F.col("x.back")).alias("l"), F.col("x.ln").alias("ln"))
            .where((F.col("rep") != F.col("l")) & _may("n", "ln"))
            .select(F.least("rep", "l").alias("a"), F.greatest("rep", "l").alias("b"))
        )

    done = _verified(stars(buckets), known)
    group = components(done).select(F.col("node").alias("rep"), "component")
    placed = buckets.join(group, "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")
    )
    apart = (
        placed.groupBy("band")
        .agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count("*").alias("m"))
        .where("p < q")
    )
    left = stage(placed.join(apart.select("band", "m"), "band"), "near-apart")
    few = left.where(F.col("m") <= FEW)
    x, y = (
        few.select("band", *(F.col(c).alias(f"{s}_{c}") for c in ("rep", "n", "component")))
        for s in ("x", "y")
    )
    rest = x.join(y, "band").where(
        (F.col("x_rep") < F.col("y_rep"))
        & (F.col("x_component") != F.col("y_component"))
        & _may("x_n", "y_n")
    )
    rest = rest.select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"))
    rest = rest.join(done, ["a", "b"], "left_anti")
    tiles = _tiles(left.where(F.col("m") > FEW), known)
    return done.unionByName(_verified(rest, known)).unionByName(stage(tiles, "near-tiles"))


def _tiles(members: DataFrame, known: DataFrame) -> DataFrame:
    """Links inside crowded buckets, found in blocks of ``CHUNK`` by ``CHUNK`` members."""
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    dealt = members.withColumns(
        {"chunks": chunks, "chunk": F.pmod(F.xxhash64("rep", "band"), chunks).cast("int")}
    )
    # a member of chunk c is a row of every tile (c, j), j >= c, and (i, c), i <= c
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    dealt = dealt.select("band", "rep", "n", "component", "chunk", other)
    tile = dealt.select(
        "band",
        F.least("chunk", "other").alias("i"),
        F.greatest("chunk", "other").alias("j"),
        "rep",
        "n",
        "component",
        (F.col("chunk") <= F.col("other")).alias("in_x"),
        (F.col("chunk") >= F.col("other")).alias("in_y"),
    )
    full = tile.join(known.select("rep", "bands", "sketch", "text"), "rep")
    return full.groupBy("band", "i", "j").applyInArrow(_tile, "a long, b long")


def _classed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, class_id, chosen`` of every row of ``docs`` with an id and a word.

    ``chosen`` marks the rows of the smallest (id, text) of each class.
    """
    found = stage(sketches(docs), "near-sketches")
    reps = distinct_texts(found)
    group = components(links(docs, reps)).withColumnRenamed("node", "rep")
    placed = reps.select("k1", "k2", "first", "rep").join(group, "rep", "left")
    placed = stage(placed.withColumn("component", F.coalesce("component", "rep")), "near-groups")
    head = placed.groupBy("component").agg(F.min("first").alias("head"))
    of_text = placed.join(head, "component").select("k1", "k2", "head")
    return found.join(of_text, ["k1", "k2"]).select(
        "doc_id",
        "text_key",
        F.col("head.doc_id").alias("class_id"),
        (F.col("head") == F.struct("doc_id", "text_key")).alias("chosen"),
    )


def _named(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id of its class), kept.

    Rows without an id have no class and are kept; rows without a word are their own class.
    """
    docs = _named(docs, id_col, text)
    wordless = docs.where(
        F.col("doc_id").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    ).select("doc_id", F.col("doc_id").alias("class_id"))
    return (
        _classed(docs)
        .select("doc_id", "class_id")
        .unionByName(wordless)
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every class, all columns as they were; rows without an id or a word stay.

    A class keeps the row of its smallest id, of several texts of that id one; rows of equal id and
    equal text are one row. The caller's columns travel in one struct, so they may have any names.
    """
    gone = _classed(_named(docs, id_col, text)).where("not chosen").select("doc_id", "text_key").distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_key"),
        F.col(text).isNull().alias("no_text"),
    )
    named = rows.where("doc_id is not null").join(gone, ["doc_id", "text_key"], "left_anti")
    named = named.dropDuplicates(["doc_id", "text_key", "no_text"])
    return named.select("row.*").unionByName(rows.where("doc_id is null").select("row.*"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [w]
         ELSE list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4]) END) AS s
  FROM words WHERE len(w) > 0
), bags AS (
  SELECT doc_id, s, count(*) AS c FROM windows GROUP BY doc_id, s
), sizes AS (
  SELECT doc_id, sum(c) AS n FROM bags GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS k
  FROM bags x JOIN bags y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 5 * k >= 4 * (p.n + q.n - k)
), sides AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, sides.b FROM reach r JOIN sides ON sides.a = r.other
)
SELECT doc_id, min(other) AS class_id, min(other) = doc_id AS kept FROM reach GROUP BY doc_id
"""
