"""Quality classifier: similarity-weighted votes of the nearest labelled documents.

A document is a histogram of hashed byte trigrams, log-damped and weighted by inverse document
frequency, beside a histogram of word shapes (capitals, digits, symbols, marks, repetition of the word
before), both of unit length and together projected on latent directions (truncated SVD of the
labelled sample). The labelled
vectors are broadcast (``FIT_DOCS`` per class times ``DIMENSIONS`` floats, a fixed bound); every
slice of documents is multiplied with all of them in one blocked product, so neighbours are exact.

Labels come from at most ``FIT_DOCS`` rows of each class outside the held-out fold. Classes of unlike
size in that sample are evened out in the vote.

Edge cases: null and empty texts, and any text without a word, score 0; rows repeated with one
id score alike; ties at the last neighbour are broken by position in the sample, which is sorted;
without labelled rows every text that is not empty scores 1 (nothing is known against it); an empty
table gives an empty result. Only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import labelled_sample, remainder
from riskloom.llm.quality_rules import DIGIT, MARK, SYMBOLS, UPPER
from riskloom.llm.text_batches import (
    LETTERS,
    SpanHasher,
    counts_in,
    map_texts,
    slices,
    span_hashes,
    text_bytes,
    word_spans,
)

FIT_DOCS = 2048  # labelled rows of each class
DIMENSIONS = 48
NEIGHBOURS = 25
POWER = 8.0  # of the cosine, as a neighbour's weight
KEEP_FROM = 0.3
BITS = 12
N_FEATURES = 1 << BITS
N_SHAPES = 64 * 3
SHAPE_HASHER = SpanHasher(21)
LOWERED = LETTERS & ~UPPER
ROWS = 128  # documents in one block of the product; memory of a task follows it


def text_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, features) counts of hashed byte trigrams within a text, then of its words' shapes."""
    n = len(at) - 1
    out = np.zeros((n, N_FEATURES + N_SHAPES), np.float32)
    if len(data) > 2:
        b = data.astype(np.uint32)
        code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
        code *= np.uint32(2654435761)
        code ^= code >> np.uint32(15)
        code *= np.uint32(2246822519)
        code >>= np.uint32(32 - BITS)
        row = np.repeat(np.arange(n), np.diff(at))
        inside = row[:-2] == row[2:]
        cell = row[:-2][inside] * N_FEATURES + code[inside]
        out[:, :N_FEATURES] = np.bincount(cell, minlength=n * N_FEATURES).reshape(n, -1)
    start, end, row = word_spans(data, at)
    if len(start):
        word = span_hashes(data, start, end, SHAPE_HASHER)
        again = np.zeros(len(word), np.int64)
        again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
        shape = again
        for flags in (UPPER[data], LOWERED[data], DIGIT[data], SYMBOLS[data], MARK[data]):
            shape = shape * 2 + (counts_in(flags, start, end) > 0)
        shape = shape * 3 + np.digitize(end - start, (2, 12))
        cell = row * N_SHAPES + shape
        out[:, N_FEATURES:] = np.bincount(cell, minlength=n * N_SHAPES).reshape(n, -1)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def features(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    grams = _unit(np.log1p(counts[:, :N_FEATURES]) * idf)
    return np.hstack((grams, _unit(np.sqrt(counts[:, N_FEATURES:]))))


def _blocks(part: pa.RecordBatch):
    for low in range(0, part.num_rows, ROWS):
        yield part.slice(low, ROWS)


@dataclass
class Neighbours:
    idf: np.ndarray
    basis: np.ndarray  # features x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, unit length
    labels: np.ndarray
    weight: np.ndarray  # of each labelled row, evening out the classes

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(features(counts, self.idf) @ self.basis)

    def score(self, counts: np.ndarray) -> np.ndarray:
        empty = ~counts[:, N_FEATURES:].any(1)
        if not len(self.labels):
            return np.where(empty, 0.0, 1.0)
        cosine = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        close = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(float) ** POWER
        close *= self.weight[near]
        out = (close * self.labels[near]).sum(1) / close.sum(1)
        return np.where(empty, 0.0, np.clip(out, 0.0, 1.0))


def _sample_rows(part: pa.RecordBatch):
    labels, places, values = [], [], []
    given = part.column("label").to_pylist()
    for k, block in enumerate(_blocks(part)):
        counts = text_counts(*text_bytes(block.column("text")))
        for r in range(len(counts)):
            some = np.flatnonzero(counts[r])
            labels.append(given[k * ROWS + r])
            places.append(some.astype(np.int16))
            values.append(counts[r][some])
    return {
        "label": pa.array(labels, pa.int32()),
        "features": pa.array(places, pa.list_(pa.int16())),
        "values": pa.array(values, pa.list_(pa.float32())),
    }


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = FIT_DOCS) -> Neighbours:
    sample = labelled_sample(docs, labels, "quality", rows_per_class)
    schema = "label int, features array<short>, values array<float>"
    rows = map_texts(sample, _sample_rows, schema).orderBy("label", "features", "values").toArrow()
    n = rows.num_rows
    counts = np.zeros((n, N_FEATURES + N_SHAPES), np.float32)
    for i, (f, v) in enumerate(zip(rows.column("features"), rows.column("values"))):
        counts[i, np.asarray(f.values)] = np.asarray(v.values)
    y = (np.asarray(rows.column("label").to_pylist(), float) > 0).astype(float)
    held = (counts[:, :N_FEATURES] > 0).sum(0)
    idf = np.log((1 + n) / (1 + held)).astype(np.float32) + np.float32(1)
    basis = _directions(features(counts, idf), min(DIMENSIONS, max(1, n)))
    model = Neighbours(idf, basis, np.zeros((0, basis.shape[1]), np.float32), y, y)
    model.vectors = model.project(counts)
    share = np.array([(y == 0).mean(), (y == 1).mean()]) if n else np.ones(2)
    model.weight = (0.5 / np.maximum(share, 1e-9))[y.astype(int)]
    return model


def _directions(x: np.ndarray, k: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration (the same on every run)."""
    rng = np.random.default_rng(2)
    q = rng.standard_normal((x.shape[1], k + 8)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :k].astype(np.float32)


def scores(docs: DataFrame, model: Neighbours) -> DataFrame:
    """``doc_id, score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> dict:
        found = [
            shared.value.score(text_counts(*text_bytes(block.column("text"))))
            for block in _blocks(part)
        ]
        return {"doc_id": part.column("doc_id"), "score": np.concatenate(found)}

    return map_texts(docs.select("doc_id", "text"), work, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, fit(docs, labels)).select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the classifier does not reject, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                found = [
                    shared.value.score(text_counts(*text_bytes(block.column(text))))
                    for block in _blocks(part)
                ]
                yield part.filter(pa.array(np.concatenate(found) >= KEEP_FROM))

    return docs.mapInArrow(run, docs.schema)
