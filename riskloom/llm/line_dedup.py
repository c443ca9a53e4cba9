"""Removal of lines that many documents share; decisions travel as bitmaps, not as text.

1. Every line becomes (128-bit hash of its key, document, position): no text is shuffled here.
2. The rows are range-partitioned by (hash, document descending, position) and sorted, so a very
   common line spreads over several tasks. Each task streams its rows once, holding the rows of two
   documents at most: the first document of a hash keeps its lines, later ones drop theirs as soon
   as a third document is seen. Rows of a hash that may go on in a neighbouring task are passed on
   undecided, with the documents seen; a summary of those hashes (two per task at most) settles them.
3. Dropped positions are packed per document into a compressed keep bitmap, which meets the text
   in one join.

Edge cases: a null or empty text is one empty line; lines whose key is shorter than ``MIN_CHARS``
code points always stay; rows without a document id keep all lines and count nowhere; rows repeated
with one id count as one document and lose the same lines; an empty table gives an empty result.
Columns of the input may have any names: working columns start with two underscores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text_batches import (
    LEADS,
    LOWER,
    SpanHasher,
    counts_in,
    line_spans,
    map_texts,
    slices,
    span_hashes,
    stripped,
    text_bytes,
)
from riskloom.operators.staging import stage

MIN_CHARS = 20
MIN_DOCS = 3
KEYS = ["h1", "h2", "doc", "tid", "pos"]
LINES = "h1 long, h2 long, doc long, tid long, pos int, n_lines int"
DECIDED, OPEN, SEEN = 0, 1, 2


def line_rows(min_chars: int = MIN_CHARS):
    """Slice function: a row for every line whose key is long enough."""
    one, two = SpanHasher(31, LOWER), SpanHasher(32, LOWER)

    def work(part: pa.RecordBatch) -> dict:
        data, at = text_bytes(part.column("text"))
        start, end, row, pos, first = line_spans(data, at)
        a, b = stripped(data, start, end)
        leads = LEADS[data]
        keep = counts_in(leads, a, b) >= min_chars
        a, b, row, pos = a[keep], b[keep], row[keep], pos[keep]
        return {
            "h1": span_hashes(data, a, b, one).view(np.int64),
            "h2": span_hashes(data, a, b, two).view(np.int64),
            "doc": np.asarray(part.column("doc"))[row],
            "tid": np.asarray(part.column("tid"))[row],
            "pos": pos.astype(np.int32),
            "n_lines": np.diff(first)[row].astype(np.int32),
        }

    return work


class _Stream:
    """Sorted rows of one task, hash by hash; see the module's text."""

    def __init__(self, min_docs: int):
        self.min_docs, self.hash, self.first = min_docs, None, True

    def _begin(self, rows: np.ndarray) -> None:
        self.hash, self.docs, self.held = (rows["h1"][0], rows["h2"][0]), [], []

    def _take(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """More rows of the hash at hand."""
        if len(self.docs) < self.min_docs:
            change = np.flatnonzero(np.diff(rows["doc"], prepend=rows["doc"][0] - 1))
            new = [r for r in rows[change][: self.min_docs + 1]]
            if self.docs and new and new[0]["doc"] == self.docs[-1]["doc"]:
                new = new[1:]
            self.docs += new[: self.min_docs - len(self.docs)]
        if self.first:
            yield rows, OPEN
        elif len(self.docs) < self.min_docs:
            self.held.append(rows)
        else:
            for part in (*self.held, rows):
                yield part[part["doc"] != self.docs[0]["doc"]], DECIDED
            self.held = []

    def _end(self) -> Iterator[tuple[np.ndarray, int]]:
        """The task's last hash, which may go on in the next task."""
        if self.hash is None or self.first:
            return
        for part in self.held:
            yield part, OPEN
        if not self.held:
            yield np.array(self.docs), SEEN

    def feed(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        change = (np.diff(rows["h1"]) != 0) | (np.diff(rows["h2"]) != 0)
        cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [len(rows)]))
        same = self.hash == (rows["h1"][0], rows["h2"][0])
        if self.hash is not None and not same:
            self.first = False
        low = 0
        if self.hash is None or same:
            if self.hash is None:
                self._begin(rows)
            yield from self._take(rows[: cuts[1]])
            low = 1
        if low == len(cuts) - 1:
            return
        self.first = False
        if len(cuts) - 2 > low:  # hashes that begin and end within these rows
            body = rows[cuts[low] : cuts[-2]]
            begin = cuts[low:-2] - cuts[low]
            run = np.repeat(np.arange(len(begin)), np.diff(cuts[low:-1]))
            fresh = np.ones(len(body), bool)
            fresh[1:] = (np.diff(body["doc"]) != 0) | (np.diff(run) != 0)
            n_docs = np.bincount(run[fresh], minlength=len(begin))
            keeper = body["doc"][begin]
            drop = (n_docs[run] >= self.min_docs) & (body["doc"] != keeper[run])
            yield body[drop], DECIDED
        tail = rows[cuts[-2] :]
        self._begin(tail)
        yield from self._take(tail)


def _structured(batch: pa.RecordBatch) -> np.ndarray:
    kinds = [(f.name, f.type.to_pandas_dtype()) for f in batch.schema]
    out = np.empty(batch.num_rows, kinds)
    for name in batch.schema.names:
        out[name] = np.asarray(batch.column(name))
    return out


def decide(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(min_docs)

        def out(found):
            for rows, state in found:
                if len(rows):
                    columns = {n: np.ascontiguousarray(rows[n]) for n in rows.dtype.names}
                    columns["state"] = np.full(len(rows), state, np.int32)
                    yield pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            if batch.num_rows:
                yield from out(stream.feed(_structured(batch)))
        yield from out(stream._end())

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, dropped in zip(batch.column("n_lines").to_pylist(), batch.column("gone")):
            keep = np.ones(n, bool)
            keep[np.asarray(dropped.values)] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_pydict(
            {
                "__doc": batch.column("__doc"),
                "__tid": batch.column("__tid"),
                "__n": batch.column("n_lines"),
                "__keep": pa.array(maps, pa.binary()),
            }
        )


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``__doc, __tid, __n, __keep``: a zlib bitmap of kept lines for each document that loses some.

    ``__tid`` is the text's xxhash64, so that differing texts under one id stay apart.
    """
    source = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"),
        F.xxhash64(F.col(text)).alias("tid"),
        F.col(text).alias("text"),
    )
    lines = stage(map_texts(source, line_rows(min_chars), LINES), "lines")
    order = [F.col(c).desc() if c == "doc" else F.col(c) for c in KEYS]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stage(ranged.mapInArrow(decide(min_docs), LINES + ", state int"), "line-drops")
    undecided = found.where(F.col("state") != DECIDED)
    summary = (
        undecided.groupBy("h1", "h2")
        .agg(F.max("doc").alias("keeper"), F.count_distinct("doc").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )  # at most two hashes per task of the pass above
    settled = (
        undecided.where(F.col("state") == OPEN)
        .join(F.broadcast(summary), ["h1", "h2"])
        .where(F.col("doc") < F.col("keeper"))
    )
    columns = ["doc", "tid", "n_lines", "pos"]
    dropped = found.where(F.col("state") == DECIDED).select(columns)
    return (
        dropped.unionByName(settled.select(columns))
        .groupBy(F.col("doc").alias("__doc"), F.col("tid").alias("__tid"))
        .agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
        .mapInArrow(_bitmaps, "__doc long, __tid long, __n int, __keep binary")
    )


def _apply(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text)):
            names = batch.schema.names
            column, keep = batch.column(names.index(text)), batch.column(names.index("__keep"))
            texts, n_dropped = [], np.zeros(batch.num_rows, np.int64)
            for i, (t, k) in enumerate(zip(column, keep)):
                if k.is_valid:
                    lines = t.as_py().split("\n")
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(k.as_py()), np.uint8))
                    bits = bits[: len(lines)]
                    n_dropped[i] = len(lines) - int(bits.sum())
                    texts.append("\n".join(x for x, b in zip(lines, bits) if b))
                else:
                    texts.append(t.as_py())
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            arrays[names.index(text)] = pa.array(texts, column.type)
            arrays[names.index("__dropped")] = pa.array(n_dropped)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents with their kept lines joined by line feeds, and ``__lines``, ``__dropped``."""
    n_lines = F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit("\n"))) + 1
    keyed = docs.withColumns(
        {
            "__lines": F.coalesce(n_lines, F.lit(1)).cast("long"),
            "__dropped": F.lit(0).cast("long"),
            "__doc": F.col(id_col).cast("long"),
            "__tid": F.xxhash64(F.col(text)),
        }
    )
    joined = keyed.join(bitmaps.drop("__n"), ["__doc", "__tid"], "left").drop("__doc", "__tid")
    out = joined.mapInArrow(_apply(text), joined.schema)
    return out.drop("__keep")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their repeated lines, all columns as they were, whatever their names."""
    rest = [c for c in docs.columns if c != text]
    others = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("struct<a:int>")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), others.alias("rest"))
    out = apply_bitmaps(rows, keep_bitmaps(rows, "doc_id", "text"), "doc_id", "text")
    return out.select(
        *[F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: lines before, lines dropped, hash of the kept text."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    out = apply_bitmaps(docs, keep_bitmaps(docs, "doc_id", "text"), "doc_id", "text")
    return out.select(
        "doc_id",
        F.col("__lines").alias("n_lines"),
        F.col("__dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH lines AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), keyed AS (
  SELECT r, doc_id, u.pos, ls[u.pos] AS line,
         translate(regexp_replace(ls[u.pos], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS pos) u
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT r, keyed.doc_id, pos, line, coalesce(keyed.doc_id < keeper, false) AS gone
  FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
