"""Language of words and texts by a linear-chain conditional random field.

Words are runs of letters (and marks on them) of one script; a script that writes no spaces, such as
Han, Kana or Thai, is cut into units of ``UNIT`` code points, each a word with a label of its own. A
word's features are its hashed form (lexicon), the first one to four
and last one to four bytes (affixes) and all its byte trigrams (n-grams; with the affixes at the borders), A-Z
lower-cased. Emission weights for all languages and the transitions between neighbouring words are
learned together; forward-backward gives every word's language probabilities, so text that switches
language within a line is labelled word by word. A text's language is the one with the largest sum
of word probabilities, weighted by word length in code points; its score is that share.

Fitted on at most ``FIT_DOCS`` texts of each language outside the held-out fold: runs of ``RUN``
words from random places are strung together across languages, so that switches are learned too (``FIT_GRAMS`` trigrams of a word are
learned from at most, so that the driver's rows are bounded; in scoring all count).
Texts are scored whole.

Edge cases: null texts and texts without a letter are ``und`` with score 0; a letter is what Unicode
calls one (``\\p{L}``); rows without a language are not learned from but scored; ties go to the first
language by code point; without any learned language all texts are ``und``; rows repeated with one
id score alike; an empty table gives an empty result. Only the named columns are read, so other
columns may have any names.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.crf import ChainCRF
from riskloom.llm.tables import bounded_sample, one_text_each, remainder
from riskloom.llm.text_batches import (
    LEADS,
    LOWER,
    SpanHasher,
    map_texts,
    mix64,
    span_hashes,
    text_bytes,
)

FIT_DOCS, RUN, RUNS, MIX = 200, 12, 4, 6  # texts a language; words a run, runs a text, runs a sequence
FIT_TOTAL = 100_000  # documents of all languages together, where there are very many
BITS = 16
N_FEATURES = 1 << BITS
AFFIXES, FIT_GRAMS = 4, 128  # bytes; trigrams of a word that are learned from
UNIT = 4  # code points of a unit of a script without spaces
CODE_POINTS = 0x33480  # behind the last assigned letter
#: Scripts written without spaces, by the first word of their letters' Unicode names.
UNSPACED = (
    "BALINESE", "BOPOMOFO", "CJK", "HALFWIDTH", "HIRAGANA", "JAVANESE", "KATAKANA", "KHMER", "LAO",
    "MYANMAR", "NEW", "TAI", "THAI", "TIBETAN", "YI",
)
NONE, LATIN, FIRST_SPACED, ALONE, JOINS, MARK = 0, 1, len(UNSPACED) + 2, 253, 254, 255
HASHER = SpanHasher(61, LOWER)


def _number(code: np.ndarray, kind: int) -> np.ndarray:
    mixed = mix64(code + np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64))
    return (mixed >> np.uint64(64 - BITS)).astype(np.int32)


@functools.cache
def scripts() -> np.ndarray:
    """The script number of every code point; the last entry stands for all behind."""
    out = np.zeros(CODE_POINTS + 1, np.uint8)
    numbers = {name: LATIN + 1 + i for i, name in enumerate(UNSPACED)}
    for c in range(CODE_POINTS):
        kind = unicodedata.category(chr(c))
        if kind[0] == "M":
            out[c] = MARK
        elif kind == "Lm":
            out[c] = JOINS
        elif kind[0] == "L":
            name = unicodedata.name(chr(c), "").split(" ")[0].split("-")[0]
            if c < 0x250 or name == "LATIN":
                out[c] = LATIN
            else:
                out[c] = min(numbers.setdefault(name, len(numbers) + LATIN + 1), ALONE)
    return out


def letter_units(data: np.ndarray, at: np.ndarray):
    """Start, end, row and code points of every word or unit."""
    lead = np.flatnonzero(LEADS[data])
    if not len(lead):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    byte = data[lead]
    code = byte.astype(np.int32)
    for low, high, size, bits in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0xF8, 4, 0x07)):
        some = np.flatnonzero((byte >= low) & (byte < high))
        value = code[some] & bits
        for step in range(1, size):
            value = (value << 6) | (data[np.minimum(lead[some] + step, len(data) - 1)] & 0x3F)
        code[some] = value
    script = scripts()[np.minimum(code, CODE_POINTS)]
    opens = np.zeros(len(lead), bool)
    opens[np.searchsorted(lead, at[:-1][at[:-1] < at[1:]])] = True
    # marks and modifier letters belong to the letter before them, if there is one
    joins = script >= JOINS
    if joins.any():
        base = np.maximum.accumulate(np.where(joins & ~opens, 0, np.arange(len(lead))))
        own = script[base]
        alone = np.where(script == JOINS, ALONE, NONE)
        script = np.where(joins, np.where((own == NONE) | (own >= JOINS), alone, own), script)
    letter = script != NONE
    cut = opens.copy()
    cut[1:] |= script[1:] != script[:-1]
    run = np.maximum.accumulate(np.where(cut, np.arange(len(lead)), 0))
    some = np.flatnonzero((script > LATIN) & (script < FIRST_SPACED))
    cut[some] |= (some - run[some]) % UNIT == 0
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(lead))
    first, last = first[letter[first]], last[letter[first]]
    start, end = lead[first], np.append(lead, len(data))[last]
    return start, end, np.searchsorted(at, start, "right") - 1, last - first


def word_features(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, grams: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words one after another, and where each word's begin (key: the words' hashes).

    At most ``grams`` trigrams of a word, all if it is not given.
    """
    low = LOWER[data].astype(np.uint64)
    size = end - start
    n_grams = np.maximum(size - 2, 0)
    if grams is not None:
        n_grams = np.minimum(n_grams, grams)
    affixes = np.minimum(size, AFFIXES)
    at = np.concatenate(([0], np.cumsum(1 + 2 * affixes + n_grams)))
    out = np.empty(at[-1], np.int32)
    put = at[:-1].copy()
    out[put] = _number(key, 1)
    front, rear = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for k in range(AFFIXES):
        has = np.flatnonzero(size > k)
        front[has] = front[has] * np.uint64(257) + low[start[has] + k] + np.uint64(1)
        rear[has] = rear[has] * np.uint64(257) + low[end[has] - 1 - k] + np.uint64(1)
        out[put[has] + 1 + 2 * k] = _number(front[has], 2 + k)
        out[put[has] + 2 + 2 * k] = _number(rear[has], 20 + k)
    put += 1 + 2 * affixes
    nth = np.arange(n_grams.sum()) - np.repeat(np.cumsum(n_grams) - n_grams, n_grams)
    p = np.repeat(start, n_grams) + nth
    code = (low[p] * np.uint64(257) + low[p + 1]) * np.uint64(257) + low[p + 2]
    out[np.repeat(put, n_grams) + nth] = _number(code, 40)
    return out, at


def _words(part: pa.RecordBatch):
    data, at = text_bytes(part.column("text"))
    start, end, row, length = letter_units(data, at)
    return data, start, end, row, length, part.num_rows


def _runs(part: pa.RecordBatch) -> dict:
    """Features of ``RUNS`` runs of words from places given by the text's id."""
    data, start, end, row, _, n = _words(part)
    key = span_hashes(data, start, end, HASHER)
    first = np.searchsorted(row, np.arange(n + 1))
    lang, chosen = [], []
    names = part.column("lang").to_pylist()
    for r, doc in enumerate(part.column("doc_id").to_pylist()):
        have = int(first[r + 1] - first[r])
        rng = np.random.default_rng(doc & 0xFFFFFFFF)
        for _ in range(min(RUNS, -(-have // RUN))):
            low = first[r] + int(rng.integers(0, max(have - RUN, 0) + 1))
            lang.append(names[r])
            chosen.append(np.arange(low, min(low + RUN, first[r + 1])))
    some = np.concatenate(chosen) if chosen else np.zeros(0, int)
    features, at = word_features(data, start[some], end[some], key[some], FIT_GRAMS)
    ends = np.cumsum([0, *map(len, chosen)])
    runs = [features[at[i] : at[j]] for i, j in zip(ends, ends[1:])]
    sizes = [np.diff(at[i : j + 1]) for i, j in zip(ends, ends[1:])]
    return {
        "lang": pa.array(lang, pa.string()),
        "features": pa.array(runs, pa.list_(pa.int32())),
        "sizes": pa.array(sizes, pa.list_(pa.int32())),
    }


class Languages:
    """A fitted field and the languages of its labels."""

    def __init__(self, names: list[str], model: ChainCRF):
        self.names, self.model = names, model

    def word_probabilities(self, part: pa.RecordBatch):
        data, start, end, row, length, n = _words(part)
        key = span_hashes(data, start, end, HASHER)
        _, one, mine = np.unique(key, return_index=True, return_inverse=True)
        e = self.model.emissions(*word_features(data, start[one], end[one], key[one]))[mine]
        first = np.searchsorted(row, np.arange(n + 1))
        return self.model.marginals(e, first), length, row, first, n


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    rows_per_language: int = FIT_DOCS,
    folds: int = 3,
    held_out: int = 1,
) -> Languages:
    known = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.col(lang).alias("lang"),
    ).where(
        (remainder(F.col("doc_id"), folds) != held_out)
        & F.col("doc_id").isNotNull()
        & F.col("lang").isNotNull()
    )
    n_languages = known.select(F.count_distinct("lang")).first()[0]
    each = max(8, min(rows_per_language, FIT_TOTAL // max(1, n_languages)))
    chosen = bounded_sample(known.select("doc_id", "lang"), "doc_id", "lang", each)
    sample = one_text_each(known.join(F.broadcast(chosen), ["doc_id", "lang"]), ["doc_id", "lang"])
    rows = map_texts(sample, _runs, "lang string, features array<int>, sizes array<int>").collect()
    names = sorted({r.lang for r in rows})
    if not rows:
        return Languages([], ChainCRF(N_FEATURES, 1))
    rows = sorted((r.lang, r.features, r.sizes) for r in rows)
    order = np.random.default_rng(10).permutation(len(rows))
    features = np.concatenate([np.array(rows[i][1], np.int32) for i in order])
    sizes = [np.array(rows[i][2], np.int64) for i in order]
    label = [names.index(rows[i][0]) for i in order]
    size = np.array([len(x) for x in sizes])
    ends = np.concatenate(([0], np.cumsum(size)))
    first = np.unique(np.append(ends[::MIX], ends[-1]))
    at = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    model = ChainCRF(N_FEATURES, len(names))
    model.fit(features, np.repeat(label, size), first, rounds=25, rate=0.2, decay=1.0, at=at)
    return Languages(names, model)


def predict(docs: DataFrame, languages: Languages) -> DataFrame:
    """``doc_id, lang_pred, score, lang_share`` (probability mass of every language) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def work(part: pa.RecordBatch) -> dict:
        m = shared.value
        p, length, row, first, n = m.word_probabilities(part)
        weight = length.astype(float)
        mass = np.stack([np.bincount(row, p[:, k] * weight, n) for k in range(p.shape[1])], 1)
        letter = np.asarray(part.column("letter")) & (mass.sum(1) > 0) & bool(m.names)
        share = mass / np.maximum(mass.sum(1, keepdims=True), 1e-300)
        best = share.argmax(1)
        found = [m.names[k] if ok else "und" for k, ok in zip(best, letter)]
        return {
            "doc_id": part.column("doc_id"),
            "lang_pred": found,
            "score": np.where(letter, np.minimum(share[np.arange(n), best], 1.0), 0.0),
        }

    rows = docs.select(
        "doc_id",
        "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"),
    )
    return map_texts(rows, work, "doc_id long, lang_pred string, score double")


def label_spans(docs: DataFrame, languages: Languages) -> DataFrame:
    """Code-switched text as spans: doc_id, first_word, n_words, lang, score (mean probability).

    Words are numbered from 0 within a text; a span is a maximal run of words of one language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def work(part: pa.RecordBatch) -> dict:
        m = shared.value
        p, _, row, first, _ = m.word_probabilities(part)
        best = p.argmax(1) if len(p) else np.zeros(0, int)
        new = np.ones(len(best), bool)
        new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(best)))
        sure = np.add.reduceat(p.max(1), at) / size if len(at) else np.zeros(0)
        return {
            "doc_id": part.column("doc_id").take(pa.array(row[at])),
            "first_word": at - first[row[at]],
            "n_words": size,
            "lang": pa.array([m.names[k] for k in best[at]] if m.names else ["und"] * len(at), pa.string()),
            "score": sure,
        }

    schema = "doc_id long, first_word long, n_words long, lang string, score double"
    return map_texts(docs.select("doc_id", "text"), work, schema)


def predictions(docs: DataFrame) -> DataFrame:
    """Predictions with the held-out mark (remainder 1 of 3)."""
    out = predict(docs, fit(docs))
    return out.select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score"
    )
