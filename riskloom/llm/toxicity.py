"""Toxicity: cumulative-link ordinal regression on sparse term counts.

One weight per term is shared by all grades; ordered thresholds separate them:
P(grade <= k) = logistic(threshold_k - weights . log(1 + counts)). The result is the expected grade.
Terms are runs of letters, lower-cased (A-Z), and their first ``PREFIXES`` bytes, hashed to 64 bits.

The tables mark toxic rows with 0 or 1 only. ``fit`` therefore grades toxic rows by how many terms
typical of toxic rows they hold (thirds of the sample), and takes given grades where there are any.
It uses at most ``FIT_DOCS`` rows of each class, outside the held-out fold. Spark counts in how many
of them each term occurs; the ``MAX_TERMS`` terms that tell the classes apart best, and surely
(``MIN_Z`` standard errors), become features. An L1 penalty clears the weights of chance terms.

Edge cases: null and empty texts, and texts without letters, have no terms and get the grade
probabilities of the thresholds alone; rows repeated with one id score alike; without labelled rows
of two classes every grade is 0; an empty table gives an empty result. Only the named columns are
read, so other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.tables import labelled_sample
from riskloom.llm.text_batches import (
    LETTERS,
    LOWER,
    SpanHasher,
    map_texts,
    mix64,
    span_hashes,
    text_bytes,
    word_spans,
)
from riskloom.operators.staging import stage

FIT_DOCS, MIN_DOCS = 3000, 5
PREFIXES = (3, 4, 5, 6, 7)
MAX_TERMS, MIN_Z = 5000, 4.0
GRADES = 4  # 0 and three of severity
TYPICAL = 2.5  # log odds ratio of a term that is typical of toxic rows
PENALTY, ROUNDS, RATE = 3e-4, 250, 0.1


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class CumulativeLink:
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than the grades

    def probabilities(self, signal: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k."""
        return _sigmoid(signal[:, None] - self.thresholds)


def ordinal_fit(
    row: np.ndarray, term: np.ndarray, value: np.ndarray, grade: np.ndarray, n_terms: int, n_grades: int
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of largest likelihood under an L1 penalty (Adam, proximal steps)."""
    share = np.array([(grade <= k).mean() for k in range(n_grades - 1)])
    cut = np.log((share + 1e-3) / (1 - share + 1e-3))
    cut = np.maximum.accumulate(cut + 1e-3 * np.arange(n_grades - 1))
    shape = np.concatenate((cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))))
    w = np.zeros(n_terms)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, shape)]
    n = len(grade)
    for step in range(1, ROUNDS + 1):
        cut = np.cumsum(np.concatenate((shape[:1], np.exp(shape[1:]))))
        signal = np.bincount(row, value * w[term], n)
        edges = np.concatenate(([-np.inf], cut, [np.inf]))
        above, below = _sigmoid(edges[grade + 1] - signal), _sigmoid(edges[grade] - signal)
        p = np.maximum(above - below, 1e-12)
        slope = 1 - above - below  # of the loss, by the signal
        g_w = np.bincount(term, value * slope[row], n_terms) / n
        d_up, d_low = -above * (1 - above) / p, below * (1 - below) / p
        g_cut = np.array(
            [d_up[grade == k].sum() + d_low[grade == k + 1].sum() for k in range(n_grades - 1)]
        )
        g_cut /= n
        tail = np.cumsum(g_cut[::-1])[::-1]
        g_shape = np.concatenate((tail[:1], tail[1:] * np.exp(shape[1:])))
        for param, g, s in zip((w, shape), (g_w, g_shape), state):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            pace = RATE / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
            param -= pace * s[0] / (1 - 0.9**step)
            if param is w:
                w[:] = np.sign(w) * np.maximum(np.abs(w) - np.minimum(pace * PENALTY, 10), 0)
    return w, np.cumsum(np.concatenate((shape[:1], np.exp(shape[1:]))))


def _terms(part: pa.RecordBatch, hasher: SpanHasher):
    data, at = text_bytes(part.column("text"))
    start, end, row = word_spans(data, at, LETTERS)
    terms, rows = [span_hashes(data, start, end, hasher)], [row]
    for n in PREFIXES:
        longer = end - start > n
        some = start[longer]
        terms.append(mix64(span_hashes(data, some, some + n, hasher) + np.uint64(n)))
        rows.append(row[longer])
    return np.concatenate(terms), np.concatenate(rows)


def _counted(term: np.ndarray, row: np.ndarray):
    """Distinct (row, term) with counts."""
    order = np.lexsort((term, row))
    term, row = term[order], row[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    return row[new], term[new], np.diff(np.append(np.flatnonzero(new), len(term)))


def _fit_rows(part: pa.RecordBatch) -> dict:
    term, row = _terms(part, SpanHasher(11, LOWER))
    row, term, count = _counted(term, row)
    take = lambda name: np.asarray(part.column(name))[row]
    return {
        "doc_id": take("doc_id"),
        "label": take("label"),
        "term": term.view(np.int64),
        "count": count.astype(np.int32),
    }


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows_per_class: int = FIT_DOCS
) -> CumulativeLink:
    sample = stage(labelled_sample(docs, labels, label, rows_per_class), "toxic-sample")
    given = sample.select("doc_id", "label").orderBy("doc_id", "label").collect()
    number = {(r.doc_id, r.label): i for i, r in enumerate(given)}
    given = np.array([r.label for r in given], np.int64)
    if len(set(given.tolist())) < 2:
        return CumulativeLink(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 50.0))
    rows = stage(
        map_texts(sample, _fit_rows, "doc_id long, label int, term long, count int"), "toxic-terms"
    )
    n_toxic, n_rows = int((given > 0).sum()), len(given)
    a, b = F.col("a"), F.col("n") - F.col("a")
    p = F.col("n") / F.lit(float(n_rows))
    gap = a / F.lit(float(n_toxic)) - b / F.lit(float(n_rows - n_toxic))
    spread = F.sqrt(p * (1 - p) * F.lit(1.0 / n_toxic + 1.0 / (n_rows - n_toxic)))
    telling = (
        rows.groupBy("term")
        .agg(F.count("*").alias("n"), F.sum((F.col("label") > 0).cast("int")).alias("a"))
        .where((F.col("n") >= MIN_DOCS) & (p < 1))
        .withColumn("z", F.abs(gap) / spread)
        .where(F.col("z") >= MIN_Z)
        .orderBy(F.desc("z"), "term")
        .limit(MAX_TERMS)
    )
    used = rows.join(F.broadcast(telling.select("term")), "term")
    found = used.select("doc_id", "label", "term", "count").toArrow()
    ids, marks = found.column("doc_id").to_pylist(), found.column("label").to_pylist()
    row = np.array([number[key] for key in zip(ids, marks)], np.int64)
    term = np.asarray(found.column("term")).view(np.uint64)
    count = np.asarray(found.column("count"))
    order = np.lexsort((term, row))
    row, term, count = row[order], term[order], count[order]
    names, term = np.unique(term, return_inverse=True)
    grade, n_grades = given, int(given.max()) + 1
    if n_grades == 2:
        grade, n_grades = _severity(given, row, term, count, len(names)), GRADES
    w, cut = ordinal_fit(row, term, np.log1p(count), grade, len(names), n_grades)
    return CumulativeLink(names[w != 0], w[w != 0], cut)


def _severity(given, row, number, count, n_terms) -> np.ndarray:
    """Grades of toxic rows: thirds by the number of terms typical of toxic rows."""
    toxic = given > 0
    a = np.bincount(number, toxic[row], n_terms) + 0.5
    b = np.bincount(number, ~toxic[row], n_terms) + 0.5
    odds = np.log(a / (toxic.sum() + 1 - a)) - np.log(b / ((~toxic).sum() + 1 - b))
    typical = (odds > TYPICAL) & (a > MIN_DOCS)
    hits = np.bincount(row, count * typical[number], len(given))
    cuts = np.quantile(hits[toxic & (hits > 0)], [1 / 3, 2 / 3]) if (hits[toxic] > 0).any() else [1, 2]
    return np.where(toxic, 1 + (hits > cuts[0]) + (hits > cuts[1]), 0).astype(np.int64)


def grades(docs: DataFrame, model: CumulativeLink) -> DataFrame:
    """``doc_id, expected_severity, grade, toxic``: grade is the likeliest, toxic if P(grade > 0) >= 1/2."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    hasher = SpanHasher(11, LOWER)

    def work(part: pa.RecordBatch) -> dict:
        m = shared.value
        term, row = _terms(part, hasher)
        if len(m.terms):
            at = np.minimum(np.searchsorted(m.terms, term), len(m.terms) - 1)
            known = m.terms[at] == term
        else:
            known = np.zeros(len(term), bool)
        row, term, count = _counted(term[known], row[known])
        signal = np.zeros(part.num_rows)
        if len(term):
            weight = m.weights[np.searchsorted(m.terms, term)]
            signal = np.bincount(row, weight * np.log1p(count), part.num_rows)
        above = m.probabilities(signal)
        each = np.diff(np.column_stack((np.ones(len(above)), above, np.zeros(len(above)))), axis=1)
        return {
            "doc_id": part.column("doc_id"),
            "expected_severity": above.sum(1),
            "grade": (-each).argmax(1).astype(np.int32),
            "toxic_probability": above[:, 0],
            "toxic": above[:, 0] >= 0.5,
        }

    schema = (
        "doc_id long, expected_severity double, grade int, toxic_probability double, toxic boolean"
    )
    return map_texts(docs.select("doc_id", "text"), work, schema)
