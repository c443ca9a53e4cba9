"""Packing tokenised documents into sequences by bounded-space online best fit.

1. Documents become token ids (:mod:`riskloom.llm.word_bpe`) with an end mark; only those longer than a
   sequence are cut, into whole sequences and a rest.
2. Pieces are dealt by hash to parts of about ``PART_TOKENS`` tokens and stream through a packer in hash
   order. It holds ``OPEN`` bins. A bitset has the bit ``f`` set if an open bin has ``f`` tokens free, so
   the best fit for a piece is the lowest set bit at or above its length. A piece that fits nowhere opens a
   bin; if all ``OPEN`` are in use, the fullest closes first.
3. What a part's open bins hold at its end goes to the next round, which has at most ``OPEN *
   capacity / PART_TOKENS`` (a quarter) as many tokens; the round with one part is the last. Its open bins
   are emptied and packed once more, longest piece first.

So only lengths move, a part's memory is its open bins, and all but a few bins of the whole table are
closed full. Parts follow the counted tokens, not the session's partitions: the same rows give the same
sequences on every run.

Edge cases: a null or empty text is the end mark alone; texts of any length are cut; repeated ids and
rows are documents of their own (equal pieces of equal ids may change places, which gives the same rows);
null ids are dealt like any other; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.text_batches import map_texts
from riskloom.llm.word_bpe import WordBPE, ragged
from riskloom.operators.staging import stage

CAPACITY = 4096
END = 1
OPEN = 128
PART_TOKENS = 1 << 21
ROUND_BITS, BIN_BITS = 57, 24  # of a sequence id: round, part, bin

_workers: dict[int, WordBPE] = {}


def tokenizer_source(spark: SparkSession, path: str | None = None) -> str:
    """The vocabulary file named by ``path``, by ``riskloom.packing.tokenizer``, or the public one."""
    path = path or spark.conf.get("riskloom.packing.tokenizer", None)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def _vocabulary(source: str) -> WordBPE:
    key = zlib.crc32(source.encode())
    if key not in _workers:
        _workers.clear()
        _workers[key] = WordBPE(source)
    return _workers[key]


def pieces(
    docs: DataFrame,
    source: str,
    id_col: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document, tokenised once."""
    shared = docs.sparkSession.sparkContext.broadcast(source)

    def work(part: pa.RecordBatch) -> dict:
        ids, at = _vocabulary(shared.value).encode(part.column("text"), end)
        count = -(-np.diff(at) // capacity)
        row = np.repeat(np.arange(part.num_rows), count)
        number = ragged(np.zeros(part.num_rows, np.int64), count)
        start = number * capacity
        length = np.minimum(np.diff(at)[row] - start, capacity)
        low = at[row] + start
        view = memoryview(ids.astype("<u4")).cast("B")
        out = {
            "doc_id": part.column("doc_id").take(pa.array(row)),
            "piece": number.astype(np.int32),
            "start": start,
            "length": length,
            "ids_crc32": np.array(
                [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(low, low + length)], np.int64
            ),
        }
        if with_ids:
            ends = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
            out["ids"] = pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))
        return out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, work, schema + (", ids array<int>" if with_ids else ""))


class Packer:
    """Bounded-space best fit. ``put`` gives the bins that close as lists of (piece, offset)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = 0  # bit f: some open bin has f tokens free
        self.free: dict[int, list[list]] = {}
        self.count = self.opened = 0

    def _lowest(self, least: int) -> int:
        above = self.bits >> least
        return least + (above & -above).bit_length() - 1 if above else -1

    def _take(self, free: int) -> list:
        bins = self.free[free]
        out = bins.pop()
        if not bins:
            del self.free[free]
            self.bits ^= 1 << free
        self.count -= 1
        return out

    def _keep(self, free: int, held: list) -> None:
        if free in self.free:
            self.free[free].append(held)
        else:
            self.free[free] = [held]
            self.bits |= 1 << free
        self.count += 1

    def put(self, piece: int, length: int) -> list:
        closed = []
        free = self._lowest(length)
        if free >= 0:
            held = self._take(free)
        else:
            if self.count >= self.most:
                closed.append(self._take(self._lowest(0)))  # the fullest
            free, held = self.capacity, [self.opened]
            self.opened += 1
        held.append((piece, self.capacity - free))
        if free == length:
            closed.append(held)
        else:
            self._keep(free - length, held)
        return closed

    def rest(self) -> list:
        out = [b for free in sorted(self.free) for b in self.free[free]]
        self.bits, self.free, self.count = 0, {}, 0
        return out


def _pack_sorted(capacity: int, most: int, number: int, last: bool):
    """Rows sorted by ``part`` through a packer for each part."""

    def emit(bins: list, held: dict, part: int, closed: bool) -> pa.RecordBatch:
        flat = [(piece, b[0], offset) for b in bins for piece, offset in b[1:]]
        rows = pa.Table.from_batches([held.pop(p) for p, _, _ in flat]).combine_chunks()
        base = number << ROUND_BITS | part << BIN_BITS
        rows = rows.append_column("sequence_id", pa.array([base + n for _, n, _ in flat], pa.int64()))
        rows = rows.append_column("offset", pa.array([o for _, _, o in flat], pa.int64()))
        return rows.append_column("closed", pa.array([closed] * len(flat))).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, held, serial, waiting = None, None, {}, 0, []
        for batch in batches:
            body = batch.drop_columns(["part", "place"])
            parts, lengths = batch.column("part").to_pylist(), batch.column("length").to_pylist()
            for i, (of, length) in enumerate(zip(parts, lengths)):
                if of != part:
                    if waiting:
                        yield emit(waiting, held, part, True)
                        waiting = []
                    if packer and (open_bins := packer.rest()):
                        yield emit(open_bins, held, part, last)
                    part, packer = of, Packer(capacity, most)
                held[serial] = body.slice(i, 1)
                waiting += packer.put(serial, length)
                serial += 1
                if len(waiting) >= 256:
                    yield emit(waiting, held, part, True)
                    waiting = []
        if waiting:
            yield emit(waiting, held, part, True)
        if packer and (open_bins := packer.rest()):
            yield emit(open_bins, held, part, last)

    return run


def pack(
    rows: DataFrame,
    capacity: int = CAPACITY,
    most_open: int = OPEN,
    part_tokens: int = PART_TOKENS,
    seed: int = 11,
) -> DataFrame:
    """``rows`` with ``doc_id, piece, length`` (1 to ``capacity``), staged, and their ``sequence_id, offset``."""
    if part_tokens < 2 * most_open * capacity:
        raise ValueError("a part must hold twice what its open bins can hold")
    done, number = [], 0
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    schema += ", sequence_id long, offset long, closed boolean"

    def packed(left: DataFrame, part, place, last: bool) -> DataFrame:
        dealt = left.withColumns({"part": part, "place": place})
        order = ["part", "place", "doc_id", "piece", "length"]
        sorted_rows = dealt.repartition("part").sortWithinPartitions(*order)
        run = _pack_sorted(capacity, most_open, number, last)
        return stage(sorted_rows.mapInArrow(run, schema), "packed")

    left, hashed = rows, F.xxhash64(F.lit(seed), "doc_id", "piece", "length")
    while True:
        tokens = left.agg(F.sum("length")).first()[0] or 0
        parts = math.ceil(tokens / part_tokens)
        part = F.pmod(F.xxhash64(F.lit(number), hashed), F.lit(max(1, parts))).cast("long")
        out = packed(left, part, hashed, False)
        done.append(out.where("closed"))
        left = out.where("not closed").select(*rows.columns)
        number += 1
        if parts <= 1:
            break
    # at most ``most_open`` bins' pieces
    done.append(packed(left, F.lit(0).cast("long"), -F.col("length"), True))
    return reduce(DataFrame.unionByName, done).drop("closed")


def pack_documents(docs: DataFrame, source: str | None = None, **columns) -> DataFrame:
    """Every piece of every document with its place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    source = source or tokenizer_source(docs.sparkSession)
    return pack(stage(pieces(docs, source, **columns), "pieces"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, n_tokens, doc_ids`` from packed pieces with ``ids``: what a trainer reads."""
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("held"), F.sum("length").alias("n_tokens")).select(
        "sequence_id",
        F.flatten(F.transform("held", lambda h: h["ids"])).alias("ids"),
        "n_tokens",
        F.transform("held", lambda h: h["doc_id"]).alias("doc_ids"),
    )
