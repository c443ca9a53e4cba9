"""SentencePiece segmentations sampled from the piece lattice, and lossless decoding.

A given vocabulary is read, never trained. Its pieces get probabilities by rank, p ~ 1 / (rank +
``SOFTEN``), raised to ``alpha``: a unigram model over the model's own pieces. A space belongs to the
word after it (runs of spaces before that are units of their own), so the lattice of a text falls
into independent units. For every distinct unit of a block the lattice is filtered forward (sums over
all segmentations); for every occurrence one segmentation is drawn backward from its exact
distribution. The draws are hashes of (row key, byte offset), so a row's segmentation is the same on
every run and in every partitioning. Characters without a piece become byte pieces.

Decoding joins the pieces' bytes and drops the one space that encoding puts in front; a literal
U+2581 is encoded by bytes, so it comes back as it was.

Units of over ``LONG`` bytes go one by one in strips of ``STRIP`` bytes: time follows their length, memory
the strip.

Edge cases: a null text has null pieces and decodes to null; an empty text is the piece of the space
in front alone; words of any length are one unit; rows repeated with one id get equal pieces;
a null id is a key of its own; an empty table gives an empty result. Only the named columns are
read, so other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.text_batches import LEADS, SpanHasher, map_texts, mix64, span_hashes, text_bytes, unit

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SOFTEN, ALPHA, SEED = 10.0, 1.0, 8
BYTE_RANK = 1e6
BLOCK_BYTES = 1 << 21
BANDS = (4, 6, 8, 10, 13, 17, 24, 32)  # sizes of units, in bytes
CELLS = 1 << 19  # of one lattice: units x bytes x lengths of pieces
LONG = BANDS[-1]
STRIP = 1 << 16  # bytes of a longer unit that are worked on at once
SLOT_BITS, LIKELY_BITS = 18, 21
HASHER = SpanHasher(81)


@dataclass
class Vocabulary:
    """Piece bytes by id, the ids of byte pieces, and a hash table from bytes to ids."""

    size: np.ndarray
    first: np.ndarray
    data: np.ndarray
    byte_ids: np.ndarray
    p: np.ndarray  # with a zero at the end
    hashes: np.ndarray  # sorted by slot
    ids: np.ndarray
    slot_at: np.ndarray
    longest: int
    scale: float  # per byte, see Lattice
    likely: np.ndarray  # whether any hash begins with these bits: most spans are no pieces

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed byte strings, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        todo = np.flatnonzero(self.likely[(h >> np.uint64(64 - LIKELY_BITS)).astype(np.int64)])
        h = h[todo]
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        low, high = self.slot_at[slot], self.slot_at[slot + 1]
        while len(todo):
            hit = self.hashes[low] == h
            out[todo[hit]] = self.ids[low[hit]]
            more = ~hit & (low + 1 < high)
            todo, h, low, high = todo[more], h[more], low[more] + 1, high[more]
        return out


def load(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    """Read the model on the driver; the tables are what goes to the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, byte_ids, rank = [], np.full(256, -1), np.full(n, np.inf)
    for i in range(n):
        if model.is_byte(i):
            pieces.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
            byte_ids[pieces[-1][0]] = i
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(model.id_to_piece(i).replace("▁", " ").encode())
            rank[i] = i
    known = np.flatnonzero(np.isfinite(rank))
    rank[known] -= known.min() if len(known) else 0
    mass = 1 / (rank + SOFTEN)
    mass[byte_ids[byte_ids >= 0]] = 1 / BYTE_RANK
    p = np.append((mass / mass.sum()) ** alpha, 0.0).astype(np.float32)
    size = np.array([len(p) for p in pieces])
    first, data = np.cumsum(size) - size, np.frombuffer(b"".join(pieces), np.uint8)
    h = HASHER.spans(HASHER.prefix(data), first[known], first[known] + size[known])
    order = np.argsort(h)
    slots = (h[order] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    slot_at = np.searchsorted(slots, np.arange((1 << SLOT_BITS) + 1))
    likely = np.zeros(1 << LIKELY_BITS, bool)
    likely[(h >> np.uint64(64 - LIKELY_BITS)).astype(np.int64)] = True
    return Vocabulary(
        size, first, data, byte_ids, p, h[order], known[order].astype(np.int32), slot_at,
        int(size[known].max()), float((p[:-1][p[:-1] > 0].min() * p.max()) ** -0.5), likely,
    )


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of units: a last space with its word, or the spaces before that."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = data == 0x20
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    opens = at[:-1][np.diff(at) > 0]
    before[opens] = False
    after[np.append(opens[1:], len(data)) - 1] = False
    begin = space & (~after | ~before)
    begin[opens] = True
    start = np.flatnonzero(begin)
    return start, np.append(start[1:], len(data))


class Lattice:
    """Forward sums over distinct units of at most ``LONG`` bytes; segmentations are drawn from it.

    Tables are laid out by byte offset, units side by side in descending size, so every step works on
    leading parts of rows. A piece of ``n`` bytes weighs its probability times ``c ** n``: that does not
    change the distribution, as all ways to an offset have the same bytes, and keeps sums in range.
    """

    def __init__(self, v: Vocabulary, data: np.ndarray, first: np.ndarray, size: np.ndarray):
        order = np.argsort(-size, kind="stable")
        self.place = np.empty(len(size), np.int64)
        self.place[order] = np.arange(len(size))
        self.size, first = size[order], first[order]
        n, self.length = len(size), int(self.size[0])
        width = min(v.longest, self.length)
        active = np.searchsorted(-self.size, -np.arange(1, self.length + 1), "right")
        d = np.zeros((self.length, n), np.uint8)
        sums = np.zeros((self.length + 1, n), np.uint64)
        HASHER.prefix(np.zeros(self.length + 1, np.uint8))  # powers up to this length
        power, inverse = HASHER._powers, HASHER._inverses
        for j, a in enumerate(active):
            d[j, :a] = data[first[:a] + j]
            sums[j + 1, :a] = sums[j, :a] + HASHER.code[d[j, :a]] * power[j]
        lead = np.ones((self.length + 1, n), bool)
        lead[:-1] = LEADS[d]  # zeros behind a unit lead, as does its end
        piece = np.full((self.length, width, n), -1, np.int32)
        for j, a in enumerate(active):
            ends = np.flatnonzero(lead[j + 1, :a])
            for k in range(min(j + 1, width)):
                some = ends[lead[j - k, ends]]
                h = mix64((sums[j + 1, some] - sums[j - k, some]) * inverse[j - k])
                piece[j, k, some] = v.find(h)
        # a character without a piece is spelled by bytes
        length = np.zeros(n, np.int64)
        for j, a in enumerate(active):
            length = np.where(lead[j], 1, length + 1)
            for m in range(1, min(j + 1, 4) + 1):
                some = np.flatnonzero(lead[j + 1, :a] & (length[:a] == m))
                if m <= width:
                    some = some[piece[j, m - 1, some] < 0]
                for i in range(j - m + 1, j + 1):
                    piece[i, 0, some] = v.byte_ids[d[i, some]]
        total = np.zeros((self.length + 1, n))
        total[0] = 1.0
        below = np.ones((self.length, width, n), np.float32)
        scale = v.scale ** np.arange(1, width + 1)
        for j, a in enumerate(active):
            steps = np.zeros((min(j + 1, width), a))
            for k in range(len(steps)):
                np.multiply(v.p[piece[j, k, :a]], total[j - k, :a], out=steps[k])
                steps[k] *= scale[k]
                if k:
                    steps[k] += steps[k - 1]
            end = total[j + 1, :a] = steps[-1]
            below[j, : len(steps), :a] = steps / np.where(end > 0, end, 1.0)
        # by unit and offset, for drawing
        self.below = np.ascontiguousarray(below.transpose(2, 0, 1)).reshape(n * self.length, width)
        self.piece = np.ascontiguousarray(piece.transpose(2, 0, 1)).reshape(n * self.length, width)

    def draw(self, which: np.ndarray, key: np.ndarray, end: np.ndarray):
        """Piece ids of occurrences one after another, and how many each has.

        ``which``: unit numbers; ``key``: hashes of the rows; ``end``: byte offsets in the rows.
        """
        which = self.place[which]
        left, base = self.size[which].copy(), which * self.length - 1
        end = end.astype(np.uint64)
        step, who = [], np.arange(len(which))
        count = np.zeros(len(which), np.int64)
        while len(who):
            at = base[who] + left[who]
            u = chance(key[who], end[who])
            k = (self.below[at] < u[:, None]).sum(1)
            k = np.minimum(k, self.below.shape[1] - 1)
            bad = self.piece[at, k] < 0  # rounding at the upper end
            if bad.any():
                k[bad] = (self.piece[at[bad]] >= 0).argmax(1)
            step.append((who, self.piece[at, k]))
            count[who] += 1
            left[who] -= k + 1
            end[who] -= (k + 1).astype(np.uint64)
            who = who[left[who] > 0]
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for n, (who, piece) in enumerate(step):
            out[first[who] + count[who] - 1 - n] = piece
        return out, count


def chance(key: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The random number of a row at a byte offset."""
    return unit(mix64(key + end * np.uint64(0xD1342543DE82EF95)))


def _steps(v: Vocabulary, data: np.ndarray, low: int, high: int):
    """Pieces that end at the offsets low + 1 to high of ``data``: first entry of each, length, id, weight."""
    start = max(0, low - v.longest)
    part = data[start:high]
    sums = HASHER.prefix(part)
    lead = np.append(LEADS[part], True)
    if high < len(data):
        lead[-1] = LEADS[data[high]]
    place = np.arange(low - start, high - start)
    ends, sizes, ids = [], [], []
    for k in range(v.longest):
        some = place[(place >= k) & lead[place + 1]]
        some = some[lead[some - k]]
        found = v.find(HASHER.spans(sums, some - k, some + 1))
        ends.append(some[found >= 0])
        ids.append(found[found >= 0])
        sizes.append(np.full(len(ids[-1]), k + 1))
    # a character without a piece is spelled by bytes
    chars = np.flatnonzero(lead[:-1])
    last = np.append(chars[1:], len(part)) - 1
    end, size = np.concatenate(ends), np.concatenate(sizes)
    owned = np.zeros(len(part), bool)
    single = end[size == (end - chars[np.searchsorted(chars, end, "right") - 1] + 1)]
    owned[single] = True
    spelled = np.flatnonzero(np.repeat(~owned[last], last - chars + 1)) + chars[0]
    spelled = spelled[(spelled >= low - start)]
    end, size = np.append(end, spelled), np.append(size, np.ones(len(spelled), np.int64))
    ids = np.append(np.concatenate(ids), v.byte_ids[part[spelled]])
    order = np.lexsort((size, end))
    end, size, ids = end[order], size[order], ids[order]
    first = np.searchsorted(end, np.arange(low - start, high - start + 1))
    return first.tolist(), size.tolist(), ids.tolist(), (v.p[ids] * v.scale**size).tolist()


def _sums(table, before: list[float], longest: int) -> tuple[list[float], list[float]]:
    """The last sums of a strip, and every piece's share of the sum at its end.

    ``before`` holds the sums ahead of the strip. Only ratios count, so the sums that later steps read
    are scaled together before they leave the range of doubles.
    """
    first, size, _, weight = table
    total, ahead, shares = before.copy(), len(before), []
    for j in range(len(first) - 1):
        s = 0.0
        for i in range(first[j], first[j + 1]):
            share = total[ahead + j - size[i]] * weight[i]
            shares.append(share)
            s += share
        total.append(s)
        if not 1e-100 < s < 1e100:
            for q in range(max(0, len(total) - longest), len(total)):
                total[q] /= s or 1.0
    return total[-longest:], shares


def draw_long(v: Vocabulary, data: np.ndarray, key: np.uint64, end: int) -> list[int]:
    """Piece ids of one long unit, strip by strip.

    Forward sums are kept at the strips' starts only; going back, a strip's tables are made again, so
    memory follows the strip, and time the length.
    """
    starts, before = list(range(0, len(data), STRIP)), [[1.0]]
    for low in starts[:-1]:
        before.append(_sums(_steps(v, data, low, low + STRIP), before[-1], v.longest)[0])
    out, left = [], len(data)
    for low, ahead in zip(starts[::-1], before[::-1]):
        high = min(low + STRIP, len(data))
        first, size, ids, _ = table = _steps(v, data, low, high)
        shares = _sums(table, ahead, v.longest)[1]
        offsets = np.arange(low + 1, high + 1).astype(np.uint64) + np.uint64(end - len(data))
        u = chance(key, offsets).tolist()
        while left > low:
            j = left - low - 1
            a, b = first[j], first[j + 1]
            goal, pick = u[j] * sum(shares[a:b]), b - 1
            for i in range(a, b):
                goal -= shares[i]
                if goal <= 0:
                    pick = i
                    break
            out.append(ids[pick])
            left -= size[pick]
    return out[::-1]


def sample(v: Vocabulary, column: pa.Array, ids: pa.Array, seed: int = SEED):
    """Piece ids of all rows one after another, and the offsets of the rows."""
    data, at = text_bytes(column)
    n = len(at) - 1
    data, at = np.insert(data, at[:-1], 0x20), at + np.arange(n + 1)
    start, end = units(data, at)
    row = np.searchsorted(at, start, "right") - 1
    known = np.asarray(ids.cast(pa.int64()).fill_null(0)).view(np.uint64)
    nulls = np.asarray(ids.is_null()).astype(np.uint64)
    row_key = mix64(mix64(known + np.uint64(seed)) + nulls)
    found, count = [], np.zeros(len(start), np.int64)
    low = 0
    while low < len(start):
        to = max(low + 1, int(np.searchsorted(end, start[low] + BLOCK_BYTES, "right")))
        s, e, r = start[low:to], end[low:to], row[low:to]
        _, one, which = np.unique(span_hashes(data, s, e, HASHER), return_index=True, return_inverse=True)
        size, drawn = (e - s)[one], []
        for least, most in zip((0, *BANDS), BANDS):  # units of like size share a table
            some = np.flatnonzero((size > least) & (size <= most))
            number = np.full(len(size), -1)
            number[some] = np.arange(len(some))
            held = np.flatnonzero(number[which] >= 0)
            held = held[np.argsort(number[which[held]], kind="stable")]
            each = max(1, CELLS // (most * min(v.longest, most)))
            for k in range(0, len(some), each):
                lattice = Lattice(v, data, s[one[some[k : k + each]]], size[some[k : k + each]])
                ends = np.searchsorted(number[which[held]], (k, k + each))
                mine = held[slice(*ends)]
                out, n_out = lattice.draw(
                    number[which[mine]] - k, row_key[r[mine]], e[mine] - at[r[mine]]
                )
                count[low + mine] = n_out
                drawn.append((mine, out, n_out))
        for i in np.flatnonzero(e - s > LONG):
            out = draw_long(v, data[s[i] : e[i]], row_key[r[i]], int(e[i] - at[r[i]]))
            count[low + i] = len(out)
            drawn.append((np.array([i]), np.array(out, np.int32), np.array([len(out)])))
        first = np.cumsum(count[low:to]) - count[low:to]
        block = np.empty(int(count[low:to].sum()), np.int32)
        for mine, out, n_out in drawn:
            block[ragged(first[mine], n_out)] = out
        found.append(block)
        low = to
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(row, count, n).astype(np.int64), out=offsets[1:])
    return np.concatenate(found) if found else np.zeros(0, np.int32), offsets


def decode_bytes(v: Vocabulary, pieces: np.ndarray, offsets: np.ndarray):
    """Bytes and offsets of the rows' texts."""
    size = v.size[pieces]
    data = v.data[ragged(v.first[pieces], size)]
    ends = np.concatenate(([0], np.cumsum(size)))[offsets]
    some = np.flatnonzero(np.diff(ends) > 0)
    return np.delete(data, ends[some]), ends - np.concatenate(([0], np.cumsum(np.diff(ends) > 0)))


def encode(
    docs: DataFrame, v: Vocabulary, id_col: str = "doc_id", text: str = "text", seed: int = SEED
) -> DataFrame:
    """``doc_id, pieces, n_pieces, lossless``: sampled ids, and whether decoding gave the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def work(part: pa.RecordBatch) -> dict:
        column = part.column("text")
        pieces, offsets = sample(shared.value, column, part.column("doc_id"), seed)
        data, at = text_bytes(column)
        back, back_at = decode_bytes(shared.value, pieces, offsets)
        same = np.diff(at) == np.diff(back_at)
        if same.all():
            wrong = np.concatenate(([0], np.cumsum(data != back)))
            same = wrong[at[1:]] == wrong[at[:-1]]
        else:
            same &= [
                bytes(data[a:b]) == bytes(back[c:d])
                for a, b, c, d in zip(at[:-1], at[1:], back_at[:-1], back_at[1:])
            ]
        nulls = np.asarray(column.is_null())
        lists = pa.ListArray.from_arrays(
            pa.array(offsets.astype(np.int32)), pa.array(pieces), mask=pa.array(nulls)
        )
        return {
            "doc_id": part.column("doc_id"),
            "pieces": lists,
            "n_pieces": np.where(nulls, 0, np.diff(offsets)),
            "lossless": same,
        }

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, work, "doc_id long, pieces array<int>, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, v: Vocabulary) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id, pieces``."""
    shared = encoded.sparkSession.sparkContext.broadcast(v)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                lists = part.column("pieces")
                nulls = np.asarray(lists.is_null())
                size = np.where(nulls, 0, np.asarray(lists.value_lengths().fill_null(0)))
                pieces = np.asarray(lists.flatten())
                data, at = decode_bytes(
                    shared.value, pieces, np.concatenate(([0], np.cumsum(size)))
                )
                texts = [
                    None if none else bytes(data[a:b]).decode("utf-8")
                    for none, a, b in zip(nulls, at[:-1], at[1:])
                ]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column("doc_id"), "text": pa.array(texts, pa.string())}
                )

    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")


def vocabulary_for(spark: SparkSession, path: str | None = None) -> Vocabulary:
    """The model named by ``path``, by ``riskloom.piece.model`` in the session, or the default one."""
    return load(path or spark.conf.get("riskloom.piece.model", None) or MODEL)
