"""Every corpus operator on awkward tables, and against plain versions."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import embedding, language, licences, line_dedup, minhash, mixing, pieces
from riskloom.llm import quality_knn, quality_rules, toxicity
from riskloom.llm.crf import ChainCRF
from riskloom.llm.text_batches import mix64, text_bytes

WORDS = "river stone paper cloud green market window yellow garden music train letter summer".split()
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " score double, label int, n_lines int, path string, pieces string, size int, target string"
)


def prose(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None, None, None, None, None, None, None, None)


LINE = "This is a line that several documents share"
BASE = prose(1, 400)
NEAR = BASE.replace(BASE.split()[200], "changed", 1) if BASE.split()[200] else BASE
ROWS = [
    row(1, BASE),
    row(2, BASE),
    row(3, NEAR, source=None),
    row(4, None),
    row(5, ""),
    row(6, " \n\t\n", lang=None),
    row(7, f"{LINE}\n{prose(2)}"),
    row(8, f"  {LINE.upper()}\t\n{prose(3)}\n{LINE}", source="b"),
    row(9, f"{prose(4)}\n{LINE}", source="b"),
    row(9, f"{prose(4)}\n{LINE}", source="b"),
    row(None, f"{prose(5)}\n{LINE}"),
    row(10, "idiot " * 3 + prose(6)),
    row(11, "x" * 300_000, source="c"),
    row(12, prose(7, 30_000), source="c"),
    row(13, "123 456 !!"),
    row(14, "one two"),
    row(15, "Released under the MIT License.\n" + prose(8), lang="fr", source="d"),
    row(16, "ü▁😀\x00   a  b   ", lang="fr", source="d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i == 10)) for i in range(1, 17)] + [(None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_line_dedup_equals_plain(docs, empty):
    got = sorted(line_dedup.line_report(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_lines))
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert (by[7].n_lines, by[7].n_dropped) == (2, 1)
    assert (by[8].n_lines, by[8].n_dropped) == (3, 2)
    assert by[9].n_dropped == 0 and by[None].n_dropped == 0
    assert by[4].n_lines == 1 and by[5].n_dropped == 0
    assert line_dedup.line_report(empty).count() == 0
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert texts[7] == prose(2) and texts[4] is None
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_line_stream_over_task_borders(spark):
    rows = [(i, f"{LINE} number {i % 7}\nown line of document {i} {prose(i)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in line_dedup.line_report(docs).collect()}
    keeper = {i % 7: i for i in range(400)}
    assert all(got[i] == (0 if keeper[i % 7] == i else 1) for i in range(400))


def test_mixing(docs, empty):
    got = mixing.taken_words(docs).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(
        map(tuple, mixing.taken_words(docs).collect()), key=repr
    )
    assert mixing.taken_words(empty).count() == 0
    mixed = mixing.mix(docs, shards=4)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.taken // r["size"] for r in got if r["size"]) + sum(
        1 for r in mixed.collect() if not re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
    )
    assert mixing.mix(empty, shards=4).count() == 0


def test_mix_targets_and_quotas(spark):
    assert mixing.targets([100, 100, 100]).tolist() == pytest.approx([200, 500 / 3, 250 / 3])
    goal = mixing.targets([100, 1000, 0, 50])
    assert goal.sum() == pytest.approx(1.5 * 1150) and (goal <= 2 * np.array([100, 1000, 0, 50])).all()
    split = mixing.split_quotas(np.array([100, 7, 0, 33]), 8, 1)
    assert split.sum(1).tolist() == [100, 7, 0, 33]
    assert split.sum(0).max() - split.sum(0).min() <= 3
    rows = [(i, prose(i, 20 + i % 50), f"s{i % 4}") for i in range(2000)]
    got = mixing.taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r.t - r.target) <= 0.01 * r.target


def test_taken_words_count_dealt_rows(spark, docs, monkeypatch):
    rows = [(i, prose(i, 5 + i % 40), f"s{i % 3}") for i in range(1500)]
    rows += [(3, rows[3][1], "s0")] * 2 + [(None, prose(9), "s1"), (7, prose(7), None), (8, None, "s2")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(table, shards=8, shard_col="shard").collect()
    times = Counter((r.doc_id, r.source) for r in mixed)
    have = Counter((i, s) for i, _, s in rows)
    expected = Counter((i, len(t.split()), len(t.split()) * times[i, s] // have[i, s])
                       for i, t, s in ((i, t or "", s) for i, t, s in rows))
    got = Counter((r.doc_id, r["size"], r.taken) for r in mixing.taken_words(table, shards=8).collect())
    assert got == expected and min(t for *_, t in got) == 0
    quotas = Counter(r.shard for r in mixed)
    assert set(quotas) == set(range(8)) and max(quotas.values()) < 1.5 * min(quotas.values())

    real = mixing.deal  # draws lost in the deal show in what is taken
    monkeypatch.setattr(mixing, "deal", lambda *a: real(*a).where("__shard <> 0"))
    short = sum(r.taken for r in mixing.taken_words(table, shards=8).collect())
    sizes = {(i, s): len((t or "").split()) for i, t, s in rows}
    lost = sum(sizes[r.doc_id, r.source] for r in mixed if r.shard == 0)
    assert lost > 0 and short == sum(n * t for (_, _, t), n in expected.items()) - lost


def test_mix_has_a_partition_for_each_shard(spark):
    rows = [(i, prose(i, 5 + i % 40), f"s{i % 3}") for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for shards in (8, 13, None):
        mixed = mixing.mix(table, shards=shards, shard_col="shard")
        placed = mixed.select("shard", F.spark_partition_id().alias("p")).distinct().collect()
        n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted((r.shard, r.p) for r in placed) == [(k, k) for k in range(n)]


def test_minhash_classes(docs, empty, spark):
    got = {r.doc_id: r for r in minhash.classes(docs).collect()}
    assert got[2].class_id == 1 and got[3].class_id == 1 and not got[3].kept
    assert all(got[i].kept for i in (1, 4, 5, 6, 11, 12, 13, 14))
    assert minhash.classes(docs).count() == len(ROWS)
    assert minhash.classes(empty).count() == 0
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[9] == 1 and ids[None] == 1 and 2 not in ids


def test_minhash_crowded_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 2)
    monkeypatch.setattr(minhash, "CHUNK", 8)
    base, rows = prose(21, 200).split(), []
    for i in range(60):
        words, rng = list(base), random.Random(i)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.class_id for r in minhash.classes(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bags = [Counter(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    root = list(range(60))
    for a, b in itertools.combinations(range(60), 2):
        k = sum((bags[a] & bags[b]).values())
        if 5 * k >= 4 * (sum(bags[a].values()) + sum(bags[b].values()) - k):
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    assert [got[i] for i in range(60)] == root


def test_bag_signatures_estimate_weighted_jaccard():
    rng, gaps = np.random.default_rng(0), []
    for t in range(40):
        a = rng.integers(0, 9, 60)
        b = np.where(rng.random(60) < 0.3, rng.integers(0, 9, 60), a)
        items = mix64(np.arange(60, dtype=np.uint64) + np.uint64(1000 * t))
        rows = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = minhash.signatures(
            rows, np.concatenate((items[a > 0], items[b > 0])), np.concatenate((a[a > 0], b[b > 0])), 2
        )
        gaps.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.02


def test_quality_rules(docs, empty, labels, no_labels):
    model = quality_rules.fit(docs, labels)
    got = quality_rules.apply_rules(docs, model).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t for i, t, *_ in ROWS if i == r.doc_id) or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        marked = {j + k for j in range(len(words) - 4) for k in range(5) if windows[tuple(words[j : j + 5])] > 1}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert (r.n_repeat_words, r.n_dup_lines) == (len(marked), len(lines) - len(set(lines)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert r.base_failed == (len(words) < 10 or 100 * len(marked) > 20 * len(words))
        assert not (r.kept and r.base_failed)
    assert quality_rules.apply_rules(empty, model).count() == 0
    plain = quality_rules.apply_rules(docs, quality_rules.fit(docs, no_labels)).collect()
    assert all(r.kept != r.base_failed for r in plain)


def test_field_equals_enumeration():
    rng, model = np.random.default_rng(1), ChainCRF(5, 3)
    model.moves, model.start = rng.normal(size=(3, 3)).astype("f4"), rng.normal(size=3).astype("f4")
    first, e = np.array([0, 4, 4, 5, 11]), (2 * rng.normal(size=(11, 3))).astype("f4")
    p, path = model.marginals(e, first, block=3), model.viterbi(e, first)
    for a, b in zip(first, first[1:]):
        if a == b:
            continue
        total, best = np.zeros((b - a, 3)), (-1e9, None)
        for y in itertools.product(range(3), repeat=int(b - a)):
            s = model.start[y[0]] + sum(e[a + i, k] for i, k in enumerate(y))
            s += sum(model.moves[y[i], y[i + 1]] for i in range(b - a - 1))
            best = max(best, (s, y))
            for i, k in enumerate(y):
                total[i, k] += np.exp(s)
        assert np.allclose(total / total.sum(1, keepdims=True), p[a:b], atol=1e-6)
        assert tuple(path[a:b]) == best[1]


def test_quality_neighbours(docs, empty, labels, no_labels):
    got = quality_knn.classify(docs, labels)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ROWS) and all(0 <= r.score <= 1 for r in rows.values())
    assert all(rows[i].score == 0 and rows[i].predicted == 0 for i in (4, 5, 6))
    assert quality_knn.classify(empty, labels).count() == 0
    assert quality_knn.classify(docs, no_labels).where("predicted = 0").count() == 3
    assert quality_knn.keep_good(docs, no_labels).count() == len(ROWS) - 3
    assert quality_knn.keep_good(docs, labels).columns == docs.columns


def test_toxicity(spark, docs, empty, labels, no_labels):
    rows = [(i, prose(i) + (" idiot clown " * (1 + i % 3) if i % 4 == 0 else "")) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], labels.schema)
    got = {r.doc_id: r for r in toxicity.grades(table, toxicity.fit(table, marks)).collect()}
    assert all(got[i].toxic == (i % 4 == 0) for i in got)
    severity = [got[i].expected_severity for i in (12, 4, 8)]  # one, two and three insults
    assert severity == sorted(severity)
    model = toxicity.fit(docs, labels)
    assert toxicity.grades(docs, model).count() == len(ROWS)
    assert toxicity.grades(empty, model).count() == 0
    assert toxicity.grades(docs, toxicity.fit(docs, no_labels)).where("toxic").count() == 0


def test_licences(spark, docs, empty):
    files = spark.createDataFrame(
        [
            (1, "a/LICENSE", "Released under the MIT License."),
            (2, "a/b/c.py", "code here " * 9),
            (3, "a/b/d.py", "Licensed under CC BY-NC 4.0.\n" + "def run " * 40),
            (4, "x/y.py", "code"),
            (5, None, "Licensed under CC BY-NC 4.0."),
            (6, "a/b/n/e.py", None),
            (7, "a/b/n/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ],
        "doc_id long, path string, text string",
    )
    got = {r.doc_id: (r.licence, r.origin) for r in licences.scan_files(files).collect()}
    assert got[1] == ("MIT", "header") and got[2] == ("MIT", "directory")
    assert got[3] == ("CC-BY-NC-4.0", "header") and got[4] == (None, "none")
    assert got[5] == ("CC-BY-NC-4.0", "header") and got[6] == ("Apache-2.0", "directory")
    assert licences.scan_files(licences.document_paths(docs)).count() == len(ROWS)
    assert licences.scan_files(licences.document_paths(empty)).count() == 0


MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions:"""
APACHE_HEADER = """/*
 * Copyright 2019 The Example Authors. All rights reserved.
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     https://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
package org.example;
"""


def test_licence_texts_and_wrapped_headers(spark):
    code = "int value = other + 1;\n" * 30
    texts = {n: t.replace("Copyright (c)", "Copyright (c) 2021 Jane Doe") for n, t in licences.TEXTS.items()}
    files = [(f"{n}/COPYING.txt", t, n, True) for n, t in texts.items()]
    files += [
        ("one", " ".join(texts["MIT"].split()), "MIT", True),
        ("two", code + MIT_GRANT + "\n" + code, "MIT", False),
        ("three", APACHE_HEADER + code, "Apache-2.0", False),
        ("four", "# Released under\n#\n# the MIT License.\n" + code, "MIT", False),
        ("five", code + "This project is released under the MIT License\n", "MIT", False),
        ("six", code + "Licensed under the MIT license.\n", "MIT", False),
        ("seven", code + "GNU GENERAL PUBLIC LICENSE\n", "GPL", False),
        ("eight", "// SPDX-License-Identifier: MIT\n" + code, "MIT", False),
        ("nine", "# SPDX-License-Identifier: (GPL-2.0-or-later OR MIT)\n" + code, "GPL-2.0", False),
        ("ten", "# SPDX-License-Identifier: EPL-2.0\n" + code, None, False),
        ("eleven", "# SPDX-License-Identifier: MIT-0\n" + code, None, False),
        ("twelve", "license\n" + code + "the terms of this license\n", None, False),
    ]
    rows = [(i, path, text) for i, (path, text, *_) in enumerate(files)]
    rows += [(i, None, f"Der Fluss {i} mit dem Stein") for i in range(1000, 1300)]
    table = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: r for r in licences.scan(table).collect()}
    for i, (path, _, name, declares) in enumerate(files):
        assert got[i].header == name, path
        assert got[i].declared == (name if declares else None), path
    assert all(got[i].header is None for i in range(1000, 1300))


def test_licence_blocks_equal_plain(spark):
    """Every line, every file and every block of a tried length, compared without a bound."""
    t = licences.Templates(licences.TEMPLATES)
    t.weigh(np.random.default_rng(6).integers(0, 500, len(t.terms)).astype(float), 1000)
    rng = random.Random(6)
    pool = " ".join(licences.TEXTS[n] for n in ("MIT", "ISC")).split() + WORDS * 20
    notice = "Licensed under the\nApache License,\nVersion 2.0."
    texts = ["\n".join(" ".join(rng.choices(pool, k=rng.randint(1, 6))) for _ in range(12)) for _ in range(20)]
    texts = [f"{x}\n{notice}\n{x}" if i % 3 == 0 else x for i, x in enumerate(texts)]
    part = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "path": pa.nulls(20, pa.string()), "text": texts})
    got = licences._scan(t, False)(part)["score"]
    for i, text in enumerate(texts):
        lines = text.split("\n")
        blocks = ["\n".join(lines[a:b]) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1)]
        h, unit, *_ = licences._terms(pa.array(blocks))
        cosine = t.cosines(h, unit, len(blocks)).max(1)
        single = max(c for b, c in zip(blocks, cosine) if "\n" not in b)
        assert got[i] <= cosine.max() + 1e-9
        assert got[i] >= single if single >= licences.MIN_COSINE else True
        assert (got[i] > 0.99) == (i % 3 == 0)


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 16))
    x[100:130] = x[5] + 0.05 * rng.normal(size=(30, 16))
    x[200:210] = x[7]
    rows = [(i, [float(v) for v in row], i % 2) for i, row in enumerate(x)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [1.0], 1)]
    rows += [(304, rows[0][1], None), (None, rows[0][1], 0), (305, [], 1), rows[9]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.withColumns({"n_links": F.lit(5), "vector": F.lit("v"), "rep": F.lit(1)})
    got = embedding.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    unit = x.astype("f4").astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2)
    found = np.array([by[i].n_links for i in range(300)])
    assert (found <= true.sum(1) - 1).all() and found.sum() >= 0.9 * (true.sum() - 300)
    assert all(by[i].n_links == 0 and by[i].kept for i in (300, 301, 302, 303, 304, 305))
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_every_length(spark):
    rng, rows = np.random.default_rng(8), []
    for d, n in ((16, 60), (7, 40), (1, 6), (3, 2), (24, 1)):
        x = rng.normal(size=(n, d))
        x[n // 2 :] = x[: n - n // 2] * 3 + 0.01 * rng.normal(size=(n - n // 2, d))
        rows += [(len(rows) + i, v.tolist(), "l") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r for r in embedding.near_duplicates(df).collect()}
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    for i, u in enumerate(unit):
        links = [j for j, v in enumerate(unit) if j != i and len(u) == len(v) and u @ v >= 0.93]
        assert got[i].n_links == len(links), (i, len(u))
        assert got[i].component_id <= min([i, *links])


@pytest.mark.parametrize("times", [0.5, 2, 10])
def test_long_licence_texts_inside_files(times):
    """Bodies without title or notice among other text, and no licence in that text alone."""
    t = licences.Templates(licences.TEMPLATES)
    rng = random.Random(9)
    usual = licences._terms(pa.array([" ".join("the of and to a in that is for by on or as with this be are".split())]))[0]
    df = np.where(np.isin(t.terms, usual), 900.0, np.random.default_rng(9).integers(0, 30, len(t.terms)))
    t.weigh(df, 1000)
    names, texts = ["CC0-1.0", "Apache-2.0", "MPL-1.1", "GPL-2.0", "LGPL-2.1"], []
    for name in names:
        body = licences.TEXTS[name].split("\n")
        lines = int(times * sum(len(x.split()) for x in body) / 8 / 2)
        around = ["\n".join(" ".join(["the of", *rng.choices(WORDS, k=6)]) for _ in range(lines)) for _ in range(2)]
        texts += ["\n".join([around[0], *body[6:], around[1]]), "\n".join(around)]
    n = len(texts)
    part = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "path": pa.nulls(n, pa.string()), "text": texts})
    assert licences._scan(t, False)(part)["header"].to_pylist() == [x for name in names for x in (name, None)]


def test_no_block_passes_the_bound_of_its_file():
    """A file is left out for a long template only if none of its blocks of lines is near enough."""
    t = licences.Templates({n: licences.TEXTS[n] for n in ("CC0-1.0", "Apache-2.0", "GPL-2.0")})
    t.weigh(np.ones(len(t.terms)), 1000)
    rng = random.Random(10)
    near = 0
    for name in t.names:
        body = licences.TEXTS[name].split("\n")
        for share in (0.2, 0.5, 0.8, 1.0):
            kept = [x for x in body if rng.random() < share] + [prose(i) for i in range(20)]
            blocks = ["\n".join(kept[a:b]) for a in range(0, len(kept), 9) for b in range(a + 1, len(kept) + 1, 9)]
            h, unit, *_ = licences._terms(pa.array(blocks))
            cosine = t.cosines(h, unit, len(blocks)).max(0)
            term = np.unique(t.place(licences._terms(pa.array(["\n".join(kept)]))[0]))
            for k in range(len(t.names)):
                some = slice(t.at[k], t.at[k + 1])
                mass = (t.value[some] ** 2)[np.isin(t.term[some], term)].sum()
                assert cosine[k] <= np.sqrt(mass) + 1e-9
                near += cosine[k] >= licences.MIN_COSINE
    assert near >= 3


def _plain_links(x: np.ndarray, threshold: float = embedding.THRESHOLD) -> np.ndarray:
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= threshold
    np.fill_diagonal(links, False)
    return links.sum(1)


@pytest.mark.parametrize("shift", [0.0, 1.0])
def test_embeddings_between_lists(spark, shift):
    """Links whose ends are in different lists are found, once, also where they all point one way."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(700, 24))
    away = rng.normal(size=(700, 24)) * (1 - shift) + shift * 3 * np.eye(24)[0]
    x = np.concatenate((base, base + 0.3 * away)).astype("f4").astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding.near_duplicates(df).collect()}
    want = _plain_links(x)
    assert want.sum() > 200 and max(got[i] - n for i, n in enumerate(want)) == 0  # no link twice
    assert sum(got.values()) >= 0.99 * want.sum()


def test_embedding_probes_are_certain_at_full_share():
    rng = np.random.default_rng(12)
    x = embedding._unit(rng.normal(size=(1500, 6)))  # few directions: the share is 1
    index = embedding.fit(x, 40_000, 0.93)
    near = index.encode(x)[0]
    probes = index.probes(x, near)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert len(i) > 1000 and (near[i] != near[j]).any()
    assert all(near[b] in probes[a] or near[a] in probes[b] for a, b in zip(i, j))
    few = embedding.fit(x, 40_000, 0.93, spread=0.2)
    assert sum(map(len, few.probes(x, near))) < sum(map(len, probes))


def test_embeddings_of_any_size_of_number(spark):
    one, two = [1e200, 2e200, 0.0], [1.0, 2.0, 0.0]
    rows = [(1, one, 1), (2, two, 1), (3, [1e-200, 2e-200, 0.0], 1), (4, [0.0, 0.0, 5e-324], 1), (5, [0.0, 0.0, 9.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


def test_pieces_round_trip_and_distribution(docs, empty, spark):
    v = pieces.load()
    encoded = pieces.encode(docs, v)
    rows = encoded.collect()
    assert len(rows) == len(ROWS) and all(r.lossless for r in rows)
    back = {r.doc_id: r.text for r in pieces.decode(encoded, v).collect()}
    assert all(back[i] == t for i, t, *_ in ROWS)
    again = pieces.encode(docs.repartition(5), v).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert pieces.encode(empty, v).count() == 0

    def ways(b):
        if not b:
            yield ()
        for k in range(1, len(b) + 1):
            sums = pieces.HASHER.prefix(np.frombuffer(b[:k], np.uint8))
            i = int(v.find(pieces.HASHER.spans(sums, np.array([0]), np.array([k])))[0])
            if i >= 0:
                yield from ((i, *rest) for rest in ways(b[k:]))

    weight = {s: math.prod(float(v.p[i]) for i in s) for s in ways(b" hello")}
    n = 8000
    ids, at = pieces.sample(v, pa.array(["hello"] * n), pa.array(range(n)))
    seen = Counter(tuple(map(int, ids[a:b])) for a, b in zip(at, at[1:]))
    for s, w in weight.items():
        p = w / sum(weight.values())
        assert abs(seen[s] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_language(spark, docs, empty):
    def text(seed, tail):
        rng = random.Random(seed)
        return " ".join(rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnr") + tail for _ in range(40))

    rows = [(i, text(i, ("ung", "eux", "ado")[i % 3]), ("de", "fr", "es")[i % 3]) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(table)
    got = {r.doc_id: r for r in language.predict(table, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    mixed = spark.createDataFrame([(1, text(900, "ung") + " " + text(901, "ado"))], "doc_id long, text string")
    spans = sorted(language.label_spans(mixed, model).collect(), key=lambda r: r.first_word)
    assert [s.lang for s in spans] == ["de", "es"] and abs(spans[1].first_word - 40) <= 1
    rows = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (4, 5, 6, 13))
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert language.predictions(empty).count() == 0
    assert language.predict(docs, language.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_language_counts_whole_words_and_unspaced_text(spark):
    text = "Hello wörld, это тест—да. 你好世界今天天气很好。こんにちは東京タワーへ"
    data, at = text_bytes(pa.array([text, None, "naïve “quoted” été 한국어 ok"]))
    start, end, row, length = language.letter_units(data, at)
    units = [bytes(data[a:b]).decode() for a, b in zip(start, end)]
    assert units[:6] == ["Hello", "wörld", "это", "тест", "да", "你好世界"]
    assert units[6:8] == ["今天天气", "很好"] and units[-5:] == ["naïve", "quoted", "été", "한국어", "ok"]
    assert length.tolist() == [len(u) for u in units] and row.tolist() == [0] * (len(units) - 5) + [2] * 5
    pattern = re.compile(r"[^\W\d_]+")
    assert "".join(units) == "".join(pattern.findall(text + " naïve “quoted” été 한국어 ok"))

    words = ["a", "Überwachungsgesetzgebungsverfahren", "не" * 20]
    data, at = text_bytes(pa.array(words))
    start, end, *_ = language.letter_units(data, at)
    features, first = language.word_features(data, start, end, np.arange(3, dtype=np.uint64))
    for i, word in enumerate(words):
        low = bytes(data[start[i] : end[i]]).lower()
        grams = [np.array([(low[j] * 257 + low[j + 1]) * 257 + low[j + 2]], np.uint64) for j in range(len(low) - 2)]
        mine = Counter(features[first[i] : first[i + 1]].tolist())
        assert not Counter(int(language._number(g, 40)[0]) for g in grams) - mine
        assert sum(mine.values()) == 1 + 2 * min(4, len(low)) + len(grams)

    # languages that differ only behind the 12th byte, or behind the first characters of an unspaced text
    rng = random.Random(1)
    stem = lambda: "".join(rng.choice("bcdfghklm") + rng.choice("aeiou") for _ in range(8))
    mid = {"xx": "zork", "yy": "wump"}
    rows = [
        (i, " ".join(stem() + mid[x] + stem() for _ in range(20)), x)
        for i, x in enumerate(["xx", "yy"] * 40)
    ]
    han = {"zh": "这个们说来时国", "ja": "のにをはがです"}
    rows += [
        (100 + i, "山川" + "".join(rng.choice(han[x]) for _ in range(60)) + "山川", x)
        for i, x in enumerate(["zh", "ja"] * 40)
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(table)
    got = {r.doc_id: r.lang_pred for r in language.predict(table, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    switch = "".join(rng.choice(han["zh"]) for _ in range(40)) + "".join(rng.choice(han["ja"]) for _ in range(40))
    mixed = spark.createDataFrame([(1, switch)], "doc_id long, text string")
    spans = sorted(language.label_spans(mixed, model).collect(), key=lambda r: r.first_word)
    assert [s.lang for s in spans] == ["zh", "ja"] and abs(spans[1].first_word - 10) <= 1


def test_field_on_ragged_features():
    rng = np.random.default_rng(4)
    features, labels = rng.integers(0, 30, (40, 5)), rng.integers(0, 3, 40)
    first, at = np.array([0, 15, 40]), np.arange(0, 201, 5)
    fixed, ragged = ChainCRF(30, 3), ChainCRF(30, 3)
    fixed.fit(features, labels, first, rounds=10)
    ragged.fit(features.ravel(), labels, first, rounds=10, at=at)
    assert np.allclose(fixed.weights, ragged.weights, atol=1e-4)
    assert np.allclose(fixed.emissions(features), ragged.emissions(features.ravel(), at), atol=1e-3)
