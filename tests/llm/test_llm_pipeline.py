"""The five stages of the corpus pipeline against plain versions, and awkward column names and ids."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import language, line_dedup, minhash, mixing, pieces, quality_knn, tables, toxicity
from riskloom.llm.text_batches import LOWER, SpanHasher, mix64

GOOD = "the river runs under old stone bridges while people read letters in quiet gardens".split()
BAD = "zzz click buy win cash now offer zzz free money casino bonus prize hurry deal".split()
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(9)
    shared = "A line of thirty letters or more that documents share"
    rows = []
    for i in range(160):
        words = GOOD if i % 3 else BAD
        body = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(12)) for _ in range(4)]
        if i % 5 == 1:
            body.insert(1, shared)
        rows.append([i, "\n".join(body), "en", "abc"[i % 3] if i % 11 else None, None])
    for i, of in ((160, 1), (161, 1), (162, 4), (163, 7)):
        rows.append([i, rows[of][1], "en", "a", None])
    rows[163][1] = rows[163][1].rsplit(" ", 1)[0] + " changed"
    rows += [[164, None, None, None, None], [165, "", "en", "b", 0], [166, "x" * 70_000, "en", "c", 1]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 160, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def plain_lines(rows):
    keys = lambda t: [x.strip(" \t\n\v\f\r").translate(ASCII_LOW) for x in (t or "").split("\n")]
    where = {}
    for r in rows:
        for k in set(keys(r[1])):
            where.setdefault(k, set()).add(r[0])
    out = []
    for r in rows:
        kept = [
            line
            for line, k in zip((r[1] or "").split("\n"), keys(r[1]))
            if len(k) < 20 or len(where[k]) < 3 or max(where[k]) == r[0]
        ]
        out.append((r[0], None if r[1] is None else "\n".join(kept), *r[2:]))
    return out


ASCII_LOW = {ord(c): ord(c) + 32 for c in map(chr, range(65, 91))}


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_unique(rows):
    """Smallest id of each class of near copies; texts without words stand alone."""
    bags = [bag(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for g, r in zip(group, rows):
        first[g] = min(first.get(g, r), r, key=lambda x: x[0])
    return sorted(first.values(), key=lambda r: r[0])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, repr(r)))


def test_stages_equal_plain_versions(spark, folder):
    from riskloom.operators.staging import stage

    functions = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = tables.table(spark, folder, "documents")
    after = []
    for name in names:
        docs = stage(functions[name](spark, docs, folder), "test-stage")
        after.append(rows_of(docs))
    start = rows_of(tables.table(spark, folder, "documents"))
    # quality: rows stay whole, decided by votes recomputed below
    good = {r.doc_id for r in quality_knn.classify(
        tables.table(spark, folder, "documents"), tables.table(spark, folder, "labels")
    ).where("predicted = 1").collect()}
    assert after[0] == [r for r in start if r[0] in good]
    assert {r[0] for r in after[0]} >= {i for i in range(160) if i % 3} - {r[0] for r in after[0] if r[1] is None}
    assert not {r[0] for r in after[0]} & {i for i in range(160) if i % 3 == 0}
    assert after[1] == plain_lines(after[0])
    assert after[2] == plain_unique(after[1])
    assert not {162, 163} & {r[0] for r in after[2]} and {4, 7} <= {r[0] for r in after[2]}
    check_mix(after[2], after[3])
    check_pieces(after[3], after[4])


def check_mix(before, mixed):
    """Whole documents, none more than twice, each source near its target."""
    times = Counter(mixed)
    assert set(times) <= set(before) and max(times.values()) <= 2
    size = lambda r: len((r[1] or "").split())
    order = sorted({r[3] for r in before}, key=lambda s: (s is None, s or ""))
    have = [sum(size(r) for r in before if r[3] == s) for s in order]
    goal = plain_targets(have)
    for s, g in zip(order, goal):
        took = sum(size(r) * n for r, n in times.items() if r[3] == s)
        assert abs(took - g) <= max(size(r) for r in before if r[3] == s)


def plain_targets(have):
    weight = [(5, 2, 1)[i % 3] for i in range(len(have))]
    goal, left, free = [0.0] * len(have), 1.5 * sum(have), set(range(len(have)))
    while free:
        total = sum(weight[i] for i in free)
        over = [i for i in free if left * weight[i] / total > 2 * have[i]]
        if not over:
            for i in free:
                goal[i] = left * weight[i] / total
            break
        for i in over:
            goal[i] = 2 * have[i]
        left -= sum(goal[i] for i in over)
        free -= set(over)
    return goal


def check_pieces(before, encoded):
    assert Counter(r[0] for r in encoded) == Counter(r[0] for r in before)
    text = {r[0]: r[1] for r in before}
    v = pieces.load()
    table = [bytes(v.data[a : a + n]) for a, n in zip(v.first, v.size)]
    for doc_id, ids, n, lossless in encoded:
        assert lossless and n == len(ids or [])
        if text[doc_id] is None:
            assert ids is None
        else:
            assert b"".join(table[i] for i in ids).decode() == " " + text[doc_id]


def test_run_equals_its_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "pieces", "n_pieces", "lossless"]
    again = corpus_pipeline.run(spark, folder)
    assert rows_of(out) == rows_of(again) and out.count() > 100


def test_quality_votes_by_hand(spark, folder):
    """Votes of every document against all labelled vectors, sorted one document at a time."""
    docs, labels = tables.table(spark, folder, "documents"), tables.table(spark, folder, "labels")
    got = {r.doc_id: r for r in quality_knn.classify(docs, labels).collect()}
    assert len(got) == len(corpus())
    m = quality_knn.fit(docs, labels)
    learned = [i for i in range(0, 160, 2) if zlib.crc32(str(i).encode()) % 5]
    assert len(m.labels) == len(learned) and m.labels.sum() == sum(i % 3 > 0 for i in learned)
    for doc_id, text, *_ in corpus():
        r = got[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
        if not (text or "").split():
            assert r.score == 0
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        x = quality_knn.features(quality_knn.text_counts(data, np.array([0, len(data)])), m.idf)[0].astype(float)
        x = x @ m.basis.astype(float)
        x /= np.linalg.norm(x)
        cosine = [float(x @ v) for v in m.vectors.astype(float)]
        near = sorted(range(len(cosine)), key=lambda i: -cosine[i])[: quality_knn.NEIGHBOURS]
        close = [max(cosine[i], 1e-6) ** quality_knn.POWER * m.weight[i] for i in near]
        want = sum(c for c, i in zip(close, near) if m.labels[i]) / sum(close)
        assert r.score == pytest.approx(want, abs=2e-3)


def ordinal_loss(w, cut, x, grade):
    """Minus log likelihood a row of the cumulative-link model, as its definition says."""
    sig = lambda t: 1 / (1 + math.exp(-t))
    total = 0.0
    for row, g in zip(x, grade):
        s = float(row @ w)
        up = 1.0 if g == len(cut) else sig(cut[g] - s)
        low = 0.0 if g == 0 else sig(cut[g - 1] - s)
        total -= math.log(up - low)
    return total / len(x)


def test_ordinal_fit_is_a_minimum(monkeypatch):
    """Moving any weight or threshold does not lower the penalised loss."""
    monkeypatch.setattr(toxicity, "ROUNDS", 3000)
    rng = np.random.default_rng(5)
    x = rng.poisson(1.0, (120, 4)).astype(float)
    signal = x @ [1.2, -0.8, 0.0, 0.5] + rng.logistic(size=120)
    grade = np.digitize(signal, [0.5, 1.5, 3.0])
    row, term = np.nonzero(x)
    w, cut = toxicity.ordinal_fit(row, term, x[row, term], grade, 4, 4)
    assert (np.diff(cut) > 0).all()

    def loss(w, cut):
        return ordinal_loss(w, cut, x, grade) + toxicity.PENALTY * np.abs(w).sum()

    best = loss(w, cut)
    for i in range(4):
        for move in (-0.05, 0.05):
            other = w.copy()
            other[i] += move
            assert loss(other, cut) > best - 1e-5
    for i in range(3):
        for move in (-0.05, 0.05):
            other = cut.copy()
            other[i] += move
            assert loss(w, other) > best - 1e-5


def test_toxic_grades_by_hand(spark):
    """Terms, signal, probabilities and grade of each text, word by word."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(GOOD) for _ in range(20)) + (" Idiot, stupid! moron" if i % 4 == 0 else "")) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "idiot " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    weight = dict(zip(m.terms.tolist(), m.weights.tolist()))
    hasher = SpanHasher(11, LOWER)

    def hashed(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return hasher.spans(hasher.prefix(data), np.array([0]), np.array([len(data)]))

    for r in toxicity.grades(docs, m).collect():
        text = dict(rows)[r.doc_id] or ""
        terms = Counter()
        for word in re.findall("[A-Za-z]+", text):
            terms[int(hashed(word)[0])] += 1
            for n in toxicity.PREFIXES:
                if len(word) > n:
                    terms[int(mix64(hashed(word[:n]) + np.uint64(n))[0])] += 1
        signal = sum(weight.get(t, 0.0) * math.log1p(c) for t, c in terms.items())
        above = [1 / (1 + math.exp(-(signal - c))) for c in m.thresholds]
        each = [a - b for a, b in zip([1, *above], [*above, 0])]
        assert r.expected_severity == pytest.approx(sum(above)) and r.grade == max(range(len(each)), key=lambda k: each[k])
        assert r.toxic == (above[0] >= 0.5) == (r.doc_id == 902 or (r.doc_id < 400 and r.doc_id % 4 == 0))


CLASH = ["__keep", "__shard", "__doc", "__tid", "__lines", "__dropped", "__key", "__block", "__pass", "__order",
         "row", "rest", "text_key", "class_id", "a.b", "rep", "no_text"]


def test_stages_keep_columns_of_any_name(spark):
    rows = [(i, f"{i} " + " ".join(GOOD) + f" {i}\nA shared line of many letters here", "en", "a", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, COLUMNS).select("*", *[F.lit(f"v{i}").alias(c) for i, c in enumerate(CLASH)])
    want = [f"v{i}" for i in range(len(CLASH))]
    for out in (line_dedup.dedup_lines(docs), minhash.one_of_each(docs), mixing.mix(docs)):
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(list(r)[5:] == want for r in kept)


def test_one_of_each_loses_no_text(spark):
    """Differing texts of one id are documents of their own."""
    rng = random.Random(2)
    a, b, c = (" ".join(rng.choice(GOOD) + str(rng.randrange(99)) for _ in range(50)) for _ in range(3))
    rows = [(1, a), (1, b), (2, c), (3, c), (3, c), (4, b + " more"), (5, None), (5, ""), (None, a), (None, a), (6, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or -1, r.text) for r in minhash.one_of_each(docs).collect()), key=repr)
    assert kept == sorted(
        [(1, a), (1, b), (2, c), (5, None), (5, ""), (-1, a), (-1, a), (6, None)], key=repr
    )
    classes = {(r.doc_id, r.class_id) for r in minhash.classes(docs).collect()}
    assert {(1, 1), (2, 2), (3, 2), (4, 1)} <= classes


def test_many_languages_and_sources(spark):
    rows = [
        (i * 100 + k, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for w in ("ora", "une", "tak", "vel")), f"l{i:02d}")
        for i in range(70)
        for k in range(6)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.predictions(docs).collect()
    assert len(out) == 420 and {r.lang_pred for r in out} <= {f"l{i:02d}" for i in range(70)}
    many = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.format_string("s%05d", "id").alias("source")
    )
    taken = mixing.taken_words(many, shards=4).agg(F.sum("size"), F.sum("taken"), F.max("taken")).first()
    assert taken[0] == 6000 and taken[2] <= 4


def test_samples_are_bounded_in_rows(spark):
    """One id holds a third of all rows; a class has many members; all classes are there."""
    rows = [(7, f"text {i}") for i in range(300)] + [(i, f"text of {i}") for i in range(1000, 1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000, 1600)] + [(7, 0), (7, 1), (7, 1)], "doc_id long, quality int")
    got = tables.labelled_sample(docs, labels, "quality", 20).collect()
    assert Counter(r.label for r in got) == {0: 20, 1: 20} or len(got) <= 40
    assert max(Counter((r.doc_id, r.label) for r in got).values()) == 1
    wide = spark.range(1500).select("id", (F.col("id") % 1200).alias("c"))
    assert tables.bounded_sample(wide, "id", "c", 1).count() == 1200


def test_long_words_in_strips(spark, monkeypatch):
    """Strips of any size give the segmentation that one table gives."""
    import pyarrow as pa

    v = pieces.load()
    rng = random.Random(3)
    text = "".join(rng.choice("etaoin😀éxyz0") for _ in range(400))
    want = pieces.sample(v, pa.array([text]), pa.array([5]))[0]
    for strip in (7, 64, 1 << 16):
        monkeypatch.setattr(pieces, "STRIP", strip)
        assert list(pieces.sample(v, pa.array([text]), pa.array([5]))[0]) == list(want)
    for n in (1, 9, 31):  # short units by both ways
        data = np.frombuffer((" " + text[:n]).encode()[:32].decode(errors="ignore").encode(), np.uint8)
        for key in range(50):
            k = np.array([key * 7919 + 1], np.uint64)
            lattice = pieces.Lattice(v, data, np.array([0]), np.array([len(data)]))
            out, _ = lattice.draw(np.array([0]), k, np.array([len(data)]))
            assert list(out) == pieces.draw_long(v, data, k[0], len(data))


def test_long_units_follow_their_distribution():
    """A unit of 33 letters: draws against exact probabilities of the first piece."""
    v = pieces.load()
    text = b" " + b"ab" * 16
    data = np.frombuffer(text, np.uint8)
    first, size, ids, weight = pieces._steps(v, data, 0, len(data))
    back = [0.0] * (len(data) + 1)
    back[-1] = 1.0
    for j in range(len(data), 0, -1):
        for i in range(first[j - 1], first[j]):
            back[j - size[i]] += weight[i] * back[j]
    want = Counter()
    for j in range(1, len(data) + 1):
        for i in range(first[j - 1], first[j]):
            if j == size[i]:
                want[ids[i]] += weight[i] * back[j] / back[0]
    n = 3000
    got = Counter(pieces.draw_long(v, data, np.uint64(k * 2654435761 + 17), len(data))[0] for k in range(n))
    for piece, p in want.items():
        assert math.isclose(got[piece] / n, p, abs_tol=4 * math.sqrt(max(p * (1 - p), 1e-4) / n))
