"""Token ids of whole texts by a word-level BPE vocabulary, for Arrow batches.

The vocabulary (a ``tokenizers`` file) is read, never trained. Its rules never let a token cross white
space, nor a change between letters, digits and signs, so the ids of a text are those of its units one
after another, and a unit met before needs no second look: distinct units are found by hash, and the
ids of the distinct ones are kept by the worker between batches (``KEPT`` of them at most, then it starts
anew). Short units of plain letters, digits or signs are merged all at once with numpy; all others (and
whole texts, if the file's rules are not the ones this module knows) are encoded by the library.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from riskloom.llm.text_batches import LOWER, SPACE, SpanHasher, mix64, span_hashes, text_bytes, word_spans

KEPT = 1 << 20  # units whose ids a worker remembers
WIDE = 24  # bytes of a unit that is merged with numpy

# fixed values: the rules of the word-level vocabulary that units rely on
RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}

# classes of bytes; a word with an ODD byte is one unit, for the library
SIGN, LETTER, DIGIT, ODD = 0, 1, 2, 3
CLASS = np.full(256, ODD, np.uint8)
CLASS[33:127] = SIGN
CLASS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = LETTER
CLASS[ord("0") : ord("9") + 1] = DIGIT
CLASS[[ord("'"), ord("|")]] = ODD  # shortened words; the marks of special tokens
LATIN = 0xC3  # lead byte of the letters U+00C0 to U+00FF
NO_LETTERS = (0x97, 0xB7)  # the signs of multiplication and division, after that lead byte


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


class WordBPE:
    """The vocabulary with the ids of units met so far."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        spec = json.loads(source)
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.known = (
            spec.get("normalizer") == RULES["normalizer"]
            and split[0].get("pattern") == {"Regex": RULES["pattern"]}
            and spec["model"].get("end_of_word_suffix") == "</w>"
            and len(spec["model"]["vocab"]) < 1 << 16
        )
        self.hasher = SpanHasher(111)
        self._forget()
        if self.known:
            self._tables(spec["model"])

    def _forget(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _tables(self, model: dict) -> None:
        vocab = model["vocab"]
        # bytes that are printable stand for themselves, the others for code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        name = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner = np.array([vocab[name[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[name[b] + "</w>"] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.pair, self.rank, self.made = key[order], order, made[order]

    # -- ids of distinct units ---------------------------------------------------------------

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids as (rank, place in the table) in one number, or the largest number."""
        key = left << 16 | right
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where(self.pair[at] == key, self.rank[at] << 20 | at, np.iinfo(np.int64).max)

    def merge(self, units: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units given as rows of lower-case bytes: in each, the lowest and leftmost pair first."""
        none = np.iinfo(np.int64).max
        n, width = units.shape
        place = np.arange(width)
        ids = np.where(place < (size - 1)[:, None], self.inner[units], self.final[units])
        inside = place[1:] < size[:, None]
        ranks = np.full((n, width), none)  # of a symbol with the next one
        ranks[:, :-1][inside] = self._ranked(ids[:, :-1][inside], ids[:, 1:][inside])
        size = size.copy()
        todo = np.arange(n)
        while len(todo):
            best = ranks[todo].argmin(1)
            found = ranks[todo, best]
            some = found < none
            todo, best, found = todo[some], best[some], found[some]
            if not len(todo):
                break
            after = place[None, :-1] > best[:, None]
            for table, last in ((ids, 0), (ranks, none)):
                old = table[todo]
                old[:, :-1] = np.where(after, old[:, 1:], old[:, :-1])
                old[:, -1] = last
                table[todo] = old
            ids[todo, best] = self.made[found & ((1 << 20) - 1)]
            size[todo] -= 1
            left, right = best > 0, best + 1 < size[todo]
            a, b = todo[left], best[left]
            ranks[a, b - 1] = self._ranked(ids[a, b - 1], ids[a, b])
            ranks[todo, best] = none
            a, b = todo[right], best[right]
            ranks[a, b] = self._ranked(ids[a, b], ids[a, b + 1])
        return ids[place < size[:, None]].astype(np.uint32), size

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        size = np.array([len(i) for i in ids], np.int64)
        return np.fromiter((t for i in ids for t in i), np.uint32, int(size.sum())), size

    def _learn(self, data, start, end, hashes, odd) -> None:
        """Take the ids of new units into the tables."""
        if len(self.hashes) + len(hashes) > KEPT and len(self.hashes):
            raise OverflowError
        size = end - start
        short = ~odd & (size <= WIDE)
        firsts, sizes = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        for some in np.split(np.flatnonzero(short), range(8192, int(short.sum()), 8192)):
            if len(some):
                width = int(size[some].max())
                cells = start[some][:, None] + np.arange(width)
                units = data[np.minimum(cells, len(data) - 1)]
                self._append(firsts, sizes, some, *self.merge(units, size[some]))
        some = np.flatnonzero(~short)
        if len(some):
            texts = [bytes(data[a:b]).decode("utf-8") for a, b in zip(start[some], end[some])]
            self._append(firsts, sizes, some, *self._by_library(texts))
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.at = np.insert(self.at, at, len(self.first) + order)
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.first, self.size = np.append(self.first, firsts), np.append(self.size, sizes)

    def _append(self, firsts, sizes, some, ids, size) -> None:
        need = self.filled + len(ids)
        if need > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(max(need, len(self.pool)), np.uint32))
        self.pool[self.filled : need] = ids
        firsts[some] = self.filled + np.cumsum(size) - size
        sizes[some], self.filled = size, need

    # -- whole texts ----------------------------------------------------------------------------

    def encode(self, column: pa.Array, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and the rows' offsets; ``last`` ends every row."""
        if not self.known:
            ids, size = self._by_library([t or "" for t in column.to_pylist()])
            offsets = np.concatenate(([0], np.cumsum(size)))
            if last is not None:
                ids = np.insert(ids, offsets[1:], last)
                offsets = offsets + np.arange(len(offsets))
            return ids, offsets
        data, at = text_bytes(column)
        data, start, end, row, odd = units(data, at)
        hashes = span_hashes(data, start, end, self.hasher)
        hashes[odd] = mix64(hashes[odd] + np.uint64(1))
        distinct, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        try:
            number = self._numbers(distinct, data, start[one], end[one], odd[one])
        except OverflowError:
            self._forget()
            number = self._numbers(distinct, data, start[one], end[one], odd[one])
        first, size = self.first[number][which], self.size[number][which]
        n_rows = len(at) - 1
        per_row = np.bincount(row, size, n_rows).astype(np.int64) + (last is not None)
        offsets = np.concatenate(([0], np.cumsum(per_row)))
        if last is None:
            return self.pool[ragged(first, size)], offsets
        ids = np.full(offsets[-1], last, np.uint32)
        inner = np.ones(offsets[-1], bool)
        inner[offsets[1:] - 1] = False
        ids[inner] = self.pool[ragged(first, size)]
        return ids, offsets

    def _numbers(self, distinct, data, start, end, odd) -> np.ndarray:
        new = ~self._has(distinct)
        if new.any():
            self._learn(data, start[new], end[new], distinct[new], odd[new])
        return self.at[np.searchsorted(self.hashes, distinct)]

    def _has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        at = np.searchsorted(self.hashes, hashes)
        return self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes


def units(data: np.ndarray, at: np.ndarray):
    """Bytes (plain units in lower case), and start, end, row and oddness of every unit."""
    kind = CLASS[data]
    latin = np.zeros(len(data), bool)  # continuation bytes of Latin-1 letters
    latin[1:] = data[:-1] == LATIN
    latin &= (data & 0xC0) == 0x80
    latin &= (data != NO_LETTERS[0]) & (data != NO_LETTERS[1])
    kind[latin] = LETTER
    kind[np.flatnonzero(latin) - 1] = LETTER
    start, end, row = word_spans(data, at)
    odd_bytes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind == ODD, out=odd_bytes[1:])
    odd_word = odd_bytes[end] > odd_bytes[start]
    word = np.zeros(len(data), bool)
    word[start[odd_word]] = True
    # runs of one class, digits alone, in the words without odd bytes
    opens = np.zeros(len(data) + 1, bool)
    opens[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start[odd_word]] += 1
    inside[end[odd_word]] -= 1
    in_odd = np.cumsum(inside[:-1]) > 0
    opens[:-1] &= ~in_odd & ~SPACE[data]
    opens[start] = True
    first = np.flatnonzero(opens[:-1])
    of_word = np.searchsorted(start, first, "right") - 1
    stop = np.append(first[1:], len(data))
    stop = np.minimum(stop, end[of_word])
    folded = LOWER[data]
    high = latin & (data >= 0x80) & (data <= 0x9E)
    folded[high] += 0x20
    folded = np.where(in_odd, data, folded)
    return folded, first, stop, row[of_word], odd_word[of_word]
