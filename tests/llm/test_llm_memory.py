"""Memory of one task of the corpus pipeline: what a step adds to a worker, in megabytes."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import line_dedup, pieces, quality_knn
from riskloom.llm.text_batches import SLICE_BYTES, SpanHasher, slices, span_hashes, text_bytes, word_spans


def peak_mb(work) -> float:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.fixture(scope="module")
def part():
    """A slice of text with very many different words."""
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    texts, size = [], 0
    while size < SLICE_BYTES:
        words = [bytes(letters[rng.integers(0, 26, n)]).decode() for n in rng.integers(2, 12, 600)]
        texts.append(" ".join(words))
        size += len(texts[-1])
    return pa.RecordBatch.from_pydict({"doc_id": range(len(texts) - 1), "text": texts[:-1]})


def test_pieces_of_many_words_at_once(part, monkeypatch):
    v = pieces.load()
    found = []

    def work():
        found.append(pieces.sample(v, part.column("text"), part.column("doc_id")))

    work()  # tables that stay
    assert (mb := peak_mb(work)) < 100, mb
    monkeypatch.setattr(pieces, "CELLS", 1 << 12)
    few = part.slice(0, 20)
    ids, offsets = pieces.sample(v, few.column("text"), few.column("doc_id"))
    assert np.array_equal(offsets, found[0][1][:21])
    assert np.array_equal(ids, found[0][0][: offsets[-1]])


def test_quality_scores_of_a_slice():
    n = quality_knn.FIT_DOCS * 2
    rng = np.random.default_rng(6)
    width = quality_knn.N_FEATURES + quality_knn.N_SHAPES
    model = quality_knn.Neighbours(
        np.ones(quality_knn.N_FEATURES, np.float32),
        rng.random((width, quality_knn.DIMENSIONS), np.float32),
        rng.random((n, quality_knn.DIMENSIONS), np.float32),
        np.arange(n) % 2.0,
        np.ones(n),
    )
    texts = [" ".join(f"w{k * j % 97}" for j in range(150)) for k in range(1000)]
    part = pa.RecordBatch.from_pydict({"text": texts})
    out = []

    def work():
        for block in quality_knn._blocks(part):
            out.append(model.score(quality_knn.text_counts(*text_bytes(block.column("text")))))

    assert (mb := peak_mb(work)) < 25, mb
    assert len(np.concatenate(out)) == part.num_rows


def test_kept_lines_of_a_large_batch():
    text = "\n".join(f"line {k} of a text that is long enough" for k in range(100))
    keep = np.arange(100) % 2 == 0
    bitmap = zlib.compress(np.packbits(keep).tobytes())
    n = 10_000
    batch = pa.RecordBatch.from_pydict(
        {
            "doc_id": range(n),
            "text": [text] * n,
            "__dropped": np.zeros(n, np.int64),
            "__keep": pa.array([bitmap, None] * (n // 2), pa.binary()),
        }
    )
    found = []

    def work():
        for out in line_dedup._apply("text")(iter([batch])):
            found.append((out.num_rows, int(np.asarray(out.column("__dropped")).sum())))

    assert (mb := peak_mb(work)) < 8, mb
    assert sum(r for r, _ in found) == n and sum(d for _, d in found) == 50 * n // 2


def test_word_hashes_of_a_slice(part):
    data, at = text_bytes(next(slices(part)).column("text"))
    start, end, _ = word_spans(data, at)
    whole = SpanHasher(7)
    expected = whole.spans(whole.prefix(data), start, end)
    assert (mb := peak_mb(lambda: span_hashes(data, start, end, SpanHasher(7)))) < 25, mb
    assert np.array_equal(span_hashes(data, start, end, SpanHasher(7)), expected)
