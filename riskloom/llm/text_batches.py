"""Whole texts as byte arrays: Arrow batches cut into slices, words and spans hashed by numpy.

Spark deals the rows; a task sees one Arrow batch at a time and works through it in slices of a few
megabytes of text, so memory follows the slice (or the one longest text), not the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 21  # of text that is worked on at once; a longer text is a slice of its own
SLICE_ROWS = 2048
PIECE_BYTES = 1 << 18  # of text that is hashed at once, cut at white space

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
LEADS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point

ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hash words as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class SpanHasher:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand.

    Prefix sums of byte values times powers of an odd number (odd, so that the power at the start of
    a span can be divided out); two hashers of different seeds give 128 bits.
    """

    def __init__(self, seed: int = 0, fold: np.ndarray | None = None):
        code = mix64(np.arange(256, dtype=np.uint64) + np.uint64((1 + 1009 * seed) * int(ODD) % 2**64))
        self.code = code if fold is None else code[fold]
        self.base = np.uint64(int(mix64(np.array([seed + 77], np.uint64))[0]) | 5)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._powers = self._inverses = np.ones(1, np.uint64)

    def _need(self, n: int) -> None:
        if len(self._powers) < n:
            size = max(n, 1 << 16)
            for name, base in (("_powers", self.base), ("_inverses", self.inverse)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums before each byte and at the end; :meth:`spans` takes hashes from them."""
        self._need(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.code[data] * self._powers[: len(data)], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((sums[end] - sums[start]) * self._inverses[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of at most ``SLICE_ROWS`` rows with ``SLICE_BYTES`` of text (one row at least)."""
    _, at = text_bytes(batch.column(text))
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
        to = min(to, row + SLICE_ROWS)
        yield batch.slice(row, to - row)
        row = to


def map_texts(df: DataFrame, work: Callable, schema: str, text: str = "text") -> DataFrame:
    """``work`` on every slice of the rows; it returns a RecordBatch or a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out = work(part)
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_pydict(out)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def word_spans(
    data: np.ndarray, at: np.ndarray, parts: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of non-space bytes (or of bytes that ``parts`` marks)."""
    solid = ~SPACE[data] if parts is None else parts[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def span_hashes(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, hasher: SpanHasher
) -> np.ndarray:
    """Hashes of ascending spans, computed piece by piece of the bytes."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE_BYTES, "right")))
        low = start[i]
        sums = hasher.prefix(data[low : end[j - 1]])
        out[i:j] = hasher.spans(sums, start[i:j] - low, end[i:j] - low)
        i = j
    return out


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, k: int = 5):
    """Hash and row of every window of ``k`` words; a text of fewer words is one window of all."""
    count = np.bincount(row, minlength=n_rows)
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    n = len(words)
    total = np.zeros(max(n, 0), np.uint64)
    for step in range(k):
        factor = mix64(np.array([step + 1], np.uint64))[0] | np.uint64(1)
        total[: n - step] += words[step:] * factor if n > step else 0
    whole = (np.arange(n) - begin[row]) <= count[row] - k
    out, of = mix64(total[whole]), row[whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        x = count[short].astype(np.uint64)
        for step in range(k - 1):
            has = count[short] > step
            x[has] = mix64(x[has] * ODD + words[begin[short[has]] + step])
        out, of = np.concatenate((out, x)), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def line_spans(data: np.ndarray, at: np.ndarray):
    """Start, end, row and number within the row of every line (split at a line feed; no text: one line)."""
    n_rows = len(at) - 1
    breaks = np.flatnonzero(data == 0x0A)
    row_of = np.searchsorted(at, breaks, "right") - 1
    count = np.bincount(row_of, minlength=n_rows) + 1
    first = np.concatenate(([0], np.cumsum(count)))
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    start[first[:-1]], end[first[1:] - 1] = at[:-1], at[1:]
    line = np.arange(len(breaks)) + row_of
    end[line], start[line + 1] = breaks, breaks + 1
    row = np.repeat(np.arange(n_rows), count)
    return start, end, row, np.arange(first[-1]) - first[row], first


def stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans without the white space at both ends (blank spans become empty at their start)."""
    solid = np.flatnonzero(~SPACE[data])
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = j > i
    a, b = start.copy(), start.copy()
    a[some], b[some] = solid[i[some]], solid[j[some] - 1] + 1
    return a, b


def counts_in(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of set flags in every span."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[end] - sums[start]
