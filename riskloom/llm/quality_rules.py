"""Quality rules: base counts per text, and a line labeller that marks content and boilerplate.

Every line gets a few binned features (length, words, letters, capitals, digits, symbols, end mark,
repetition). A linear-chain conditional random field decodes the whole text's lines by Viterbi; the
share of word characters in content lines decides whether a text that passes the base rules stays.

The field is fitted on lines of at most ``FIT_DOCS`` labelled documents per class (up to
``FIT_LINES`` neighbouring lines of each, from a place given by the id): lines of good documents
count as content, lines of bad ones as boilerplate. No line of the scored text is left out.

Edge cases: null and empty texts have no words, fail the base rules and are not kept; a text of one
line of any length is scored whole; rows repeated with one id are scored alike; an empty table gives
an empty result; without labels of both classes every line counts as content. Only the named
columns are read, so other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm.crf import ChainCRF
from riskloom.llm.tables import labelled_sample
from riskloom.llm.text_batches import (
    LEADS,
    LETTERS,
    SPACE,
    SpanHasher,
    counts_in,
    line_spans,
    map_texts,
    mix64,
    shingles,
    span_hashes,
    text_bytes,
    word_spans,
)

FIT_DOCS, FIT_LINES = 1500, 48
MIN_CONTENT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
WINDOW = 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
UPPER, DIGIT, MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = DIGIT[ord("0") : ord("9") + 1] = True
MARK[[ord(c) for c in "!?;:=+~^_@/\\{}[]"]] = True
SHARES = np.array([1e-9, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
COUNTS = np.array([1, 2, 4, 7, 12, 25, 50, 100, 200, 500])
LENGTHS = np.array([1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 10, 14, 20])
SLOTS, BINS = 12, 12
N_FEATURES = SLOTS * BINS


def _lines(part: pa.RecordBatch, hasher: SpanHasher):
    """Bytes, rows, words and lines of a slice, and the lines' features."""
    data, at = text_bytes(part.column("text"))
    n = len(at) - 1
    ws, we, w_row = word_spans(data, at)
    start, end, row, _, first = line_spans(data, at)
    size = end - start
    n_words = np.searchsorted(ws, end) - np.searchsorted(ws, start)
    solid = np.maximum(counts_in(~SPACE[data], start, end), 1)
    blank = n_words == 0
    has = ~blank
    key = np.zeros(len(start), np.uint64)
    key[has] = span_hashes(data, start[has], end[has], hasher)
    key = mix64(key ^ mix64(row.astype(np.uint64)))
    repeated = np.zeros(len(start), bool)
    lines = np.flatnonzero(has)
    order = lines[np.argsort(key[lines], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    repeated[order[1:][same]] = True  # an earlier line of the text is equal
    last = np.zeros(len(start), np.uint8)
    opens = np.zeros(len(start), np.uint8)
    last[size > 0] = data[end[size > 0] - 1]
    opens[size > 0] = data[start[size > 0]]
    share = lambda flags: np.searchsorted(
        SHARES, counts_in(flags, start, end) / solid, "right"
    )
    ends = np.select([last == ord("."), MARK[last], SYMBOLS[last], LETTERS[last]], [1, 2, 3, 4], 0)
    slots = (
        np.searchsorted(COUNTS, size, "right"),
        np.searchsorted(COUNTS, n_words, "right"),
        np.searchsorted(LENGTHS, solid / np.maximum(n_words, 1), "right"),
        share(LETTERS[data]),
        share(UPPER[data]),
        share(DIGIT[data]),
        share(SYMBOLS[data]),
        share(MARK[data]),
        ends,
        np.select([UPPER[opens], LETTERS[opens], DIGIT[opens], SYMBOLS[opens]], [1, 2, 3, 4], 0),
        repeated.astype(int) + 2 * blank,
        share(data == ord(".")),
    )
    features = np.stack(slots, 1) + np.arange(SLOTS) * BINS
    return data, at, n, (ws, we, w_row), (start, end, row, first), features, repeated


def _fit_rows(part: pa.RecordBatch) -> dict:
    _, _, n, _, (_, _, _, first), features, _ = _lines(part, SpanHasher(41))
    keep = []
    for r, doc in enumerate(part.column("doc_id").to_pylist()):
        spare = int(first[r + 1] - first[r]) - FIT_LINES
        low = first[r] + (doc * 2654435761 % (spare + 1) if spare > 0 else 0)
        keep.append(features[low : min(low + FIT_LINES, first[r + 1])].ravel().tolist())
    return {
        "label": part.column("label"),
        "features": pa.array(keep, pa.list_(pa.int32())),
    }


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = FIT_DOCS) -> ChainCRF:
    """The line labeller; label 1 is content."""
    sample = labelled_sample(docs, labels, "quality", rows_per_class)
    rows = map_texts(sample, _fit_rows, "label int, features array<int>").collect()
    rows = sorted((r.label, r.features) for r in rows if r.features)
    model = ChainCRF(N_FEATURES, 2)
    if len({label for label, _ in rows}) < 2:
        model.start[:] = (0, 50)
        model.moves[:] = ((0, 50), (0, 50))
        return model
    features = [np.array(f).reshape(-1, SLOTS) for _, f in rows]
    size = np.array([len(f) for f in features])
    truth = np.repeat([int(label > 0) for label, _ in rows], size)
    return model.fit(np.concatenate(features), truth, np.concatenate(([0], np.cumsum(size))))


def rules(model: ChainCRF, min_content: float = MIN_CONTENT):
    """Slice function: base counts, verdicts and the lines' labels as runs."""
    hasher, words = SpanHasher(41), SpanHasher(42)

    def work(part: pa.RecordBatch) -> dict:
        data, at, n, (ws, we, w_row), (start, end, row, first), features, repeated = _lines(
            part, hasher
        )
        n_words = np.bincount(w_row, minlength=n)
        chars = counts_in(LEADS[data], ws, we)
        word_chars = np.bincount(w_row, chars, n).astype(np.int64)
        in_window = _repeated_words(span_hashes(data, ws, we, words), w_row, n)
        n_repeat = np.bincount(w_row[in_window], minlength=n)
        base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
        content = model.viterbi(model.emissions(features), first) == 1
        line_chars = counts_in(LEADS[data] & ~SPACE[data], start, end)
        good = np.bincount(row, line_chars * content, n)
        share = good / np.maximum(word_chars, 1)
        return {
            "doc_id": part.column("doc_id"),
            "n_words": n_words,
            "word_chars": word_chars,
            "n_symbols": counts_in(SYMBOLS[data], at[:-1], at[1:]),
            "n_dup_lines": np.bincount(row, repeated, n).astype(np.int64),
            "n_repeat_words": n_repeat,
            "base_failed": base_failed,
            "kept": ~base_failed & (share >= min_content),
            "content_share": share,
            "n_lines": np.diff(first),
            "n_content_lines": np.bincount(row, content, n).astype(np.int64),
        }

    return work


def _repeated_words(words: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Marks words inside a window of five that the text holds at least twice."""
    count = np.bincount(row, minlength=n_rows)
    long = (count >= WINDOW)[row]
    place = np.flatnonzero(long)
    marked = np.zeros(len(words) + 1, np.int64)
    if len(place):
        key, of = shingles(words[place], row[place], n_rows, WINDOW)
        inside = np.concatenate(([0], np.cumsum(np.where(count >= WINDOW, count, 0))))
        begin = np.arange(len(place))
        begin = place[begin - inside[row[place]] <= count[row[place]] - WINDOW]
        key = mix64(key ^ mix64(of.astype(np.uint64)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        np.add.at(marked, begin[twice], 1)
        np.add.at(marked, begin[twice] + WINDOW, -1)
    return np.cumsum(marked[:-1]) > 0


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, kept boolean, content_share double,"
    " n_lines long, n_content_lines long"
)


def apply_rules(docs: DataFrame, model: ChainCRF, min_content: float = MIN_CONTENT) -> DataFrame:
    return map_texts(docs.select("doc_id", "text"), rules(model, min_content), SCHEMA)
