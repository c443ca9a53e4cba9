"""Licence scan: TF-IDF cosine of lines, blocks of lines and whole files to templates, then inheritance.

Templates are one-line notices, usual file headers and whole licence texts (``licence_texts``). Terms
are lower-cased runs of letters, digits and dots. Document frequencies of the templates' terms
are counted over all texts (terms outside the templates weigh as much as the rarest one). Each line
and each whole file is compared with every template, and blocks of neighbouring lines (lines without
terms, such as bare comment marks, do not count) with every template: from every line on, the blocks of
about the template's length; for templates of over ``BLOCK_TERMS`` terms from the first line after every
``STEP``-th part of the template's length on, which shifts a block by less than that part. A pair is skipped
only where a bound on
its cosine is below the threshold: the numerator is a sum over terms, and a block's norm is at least
the root of its summed squared weights; and no block of a file is nearer to a template than the root of the
squared weights (of the template, of norm 1) of those terms that the file holds at all. Notices must hold the licence's name whole. ``SPDX-License-Identifier`` tags are read by their names.

A file that is named as a licence file, or whose whole text is like
a template, declares that licence for its directory (on demand also one whose first line, or a block
from it on, is). A file without a licence of its own inherits
from the nearest ancestor directory with a declaration: directories (not files) are joined with
declarations along their ancestors, and files then with their directory.

Edge cases: null and empty texts hold no licence but may inherit; several lines above the threshold:
the best, at ties the first template by name (a name without a version, as ``GPL``, only where no other
is found); an SPDX expression of several names gives the first known one; several declarations of one directory: the best score,
then the smaller name; null paths neither declare nor inherit; rows repeated with one path give one
row each; lines of any length are compared whole; an empty table gives an empty result. Only the
named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterable
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text_batches import (
    LOWER,
    SpanHasher,
    line_spans,
    map_texts,
    span_hashes,
    text_bytes,
    word_spans,
)
from riskloom.operators.staging import stage

TEXTS = {  # also where the package is a zip file on an executor
    p.name.removesuffix(".txt"): p.read_text(encoding="utf-8")
    for p in sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda p: p.name)
    if p.name.endswith(".txt")
}
#: What licences are called in notices, by licence name.
CALLED = {
    "AGPL": ["GNU Affero General Public License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0 license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-style license"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "CC0-1.0": ["Creative Commons CC0 1.0 Universal"],
    "GPL": ["GNU General Public License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GPLv2 license"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GPLv3 license"],
    "ISC": ["ISC License"],
    "LGPL": ["GNU Lesser General Public License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "MIT": ["MIT License"],
    "MPL": ["Mozilla Public License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0 license"],
}
NO_VERSION = {"AGPL", "GPL", "LGPL", "MPL"}
#: Usual notices around such a name.
NOTICES = [
    "{}",
    "Licensed under the {}.",
    "This project is released under the {}.",
    "This project is licensed under the {} - see the LICENSE file for details.",
    "This work is licensed under a {}.",
    "Distributed under the {}. See LICENSE for more information.",
]
_GNU = """{program} is free software: you can redistribute it and/or modify it under the terms of the
GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or
(at your option) any later version. {program} is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU {kind} for more details. You should have received a copy of the GNU {kind} along
with this program. If not, see <https://www.gnu.org/licenses/>."""
_LESSER, _AFFERO = "Lesser General Public License", "Affero General Public License"
#: Usual headers, titles and further notices.
HEADERS = {
    "AGPL-3.0": [
        _GNU.format(program="This program", kind=_AFFERO, version="3"),
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        TEXTS["GPL-3.0"].replace("General Public License", _AFFERO).replace(
            "GENERAL PUBLIC LICENSE", _AFFERO.upper()
        ),
    ],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
        """Licensed to the Apache Software Foundation (ASF) under one or more contributor license
        agreements. See the NOTICE file distributed with this work for additional information regarding
        copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0
        (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the
        License.""",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
    ],
    "GPL-2.0": [
        _GNU.format(program="This program", kind="General Public License", version="2"),
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        _GNU.format(program="This program", kind="General Public License", version="3"),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "LGPL-2.1": [
        _GNU.format(program="This library", kind=_LESSER, version="2.1"),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        _GNU.format(program="This library", kind=_LESSER, version="3"),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "MIT": [
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
        TEXTS["MIT"][TEXTS["MIT"].index("Permission") : TEXTS["MIT"].index("The above")],
    ],
    "MPL-2.0": [
        "This work is subject to the terms of the Mozilla Public License, version 2.0.",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
        of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/.""",
    ],
}
TEMPLATES = {
    name: [
        *(notice.format(called) for called in CALLED.get(name, []) for notice in NOTICES),
        *HEADERS.get(name, []),
        *([TEXTS[name]] if name in TEXTS else []),
    ]
    for name in sorted({*CALLED, *TEXTS})
}
SPDX_NAMES = sorted(set(TEMPLATES) - NO_VERSION)
BLOCK_TERMS = 400  # longest template of which blocks begin at every line; longer ones begin at every STEP-th part
STEP = 20
LONG_SIZES = (0.75, 0.875, 1.0, 1.125, 1.3)  # lengths of blocks against that of a long template
BLOCK_SIZES = np.unique(np.round(3 * 1.2 ** np.arange(30)).astype(int))
NOTICE_CHARS = 200  # longest notice
CHUNK_TERMS = 1 << 20  # terms of blocks that are compared at once
MIN_COSINE = 0.8
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
PARTS = np.zeros(256, bool)
PARTS[[*map(ord, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789."), *range(128, 256)]] = True
HASHER = SpanHasher(71, LOWER)


def _terms(column: pa.Array):
    """Hashes, rows and places of terms; dots at a term's end are not part of it."""
    data, at = text_bytes(column)
    start, end, row = word_spans(data, at, PARTS)
    dot = data[end - 1] == ord(".")
    while dot.any():
        end = end - dot
        some = end > start
        start, end, row = start[some], end[some], row[some]
        dot = data[end - 1] == ord(".")
    return span_hashes(data, start, end, HASHER), row, start, data, at


def _name_in(licence: str, text: str) -> str:
    """The longest usual name of the licence in a notice; none for headers and whole texts."""
    found = [x for x in CALLED.get(licence, []) if x.lower() in text.lower()]
    return max(found, key=len, default="") if len(text) <= NOTICE_CHARS else ""


class Templates:
    """Term vectors of all templates; ``names`` has a licence name for each."""

    def __init__(self, texts: dict[str, str | Iterable[str]]):
        pairs = sorted({(n, t) for n, x in texts.items() for t in ([x] if isinstance(x, str) else x)})
        self.names = [n for n, _ in pairs]
        self.firm = np.array([n not in NO_VERSION for n in self.names])
        h, row, *_ = _terms(pa.array([t for _, t in pairs]))
        self.size = np.bincount(row, minlength=len(pairs))
        self.terms, term = np.unique(h, return_inverse=True)
        # a notice counts only where the whole name it holds is there: "License." is like "MIT License" where "mit" is usual
        said, of, *_ = _terms(pa.array([_name_in(n, t) for n, t in pairs]))
        self.must = [np.unique(self.place(said[of == k])) for k in range(len(pairs))]
        code, count = np.unique(row * len(self.terms) + term, return_counts=True)
        self.of, self.term, self.tf = code // len(self.terms), code % len(self.terms), count
        self.at = np.searchsorted(self.of, np.arange(len(pairs) + 1))
        spdx, tag, *_ = _terms(pa.array(["SPDX-License-Identifier", *SPDX_NAMES]))
        self.spdx = [spdx[tag == i] for i in range(len(SPDX_NAMES) + 1)]
        self.later = _terms(pa.array(["only or"]))[0]  # as in GPL-2.0-only, GPL-2.0-or-later

    def weigh(self, df: np.ndarray, n_docs: int) -> Templates:
        self.idf = np.log((1 + n_docs) / (1 + df)) + 1
        self.rest = float(self.idf.max())  # of terms outside the templates
        value = self.tf * self.idf[self.term]
        norm = np.sqrt(np.bincount(self.of, value * value, len(self.names)))
        self.value = value / norm[self.of]
        return self

    def place(self, h: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for terms outside the templates."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    def weights(self, term: np.ndarray) -> np.ndarray:
        return np.where(term >= 0, self.idf[term], self.rest)

    def shares(self, k: int) -> np.ndarray:
        """What one occurrence of each term adds to the numerator of template ``k``'s cosine."""
        out, some = np.zeros(len(self.terms)), slice(self.at[k], self.at[k + 1])
        out[self.term[some]] = self.value[some] * self.idf[self.term[some]]
        return out

    def cosines(self, h: np.ndarray, unit: np.ndarray, n_units: int) -> np.ndarray:
        """(units, templates) cosine of the units' term vectors."""
        order = np.lexsort((h, unit))
        h, unit = h[order], unit[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (unit[1:] != unit[:-1])
        tf = np.diff(np.append(np.flatnonzero(new), len(h)))
        h, unit = h[new], unit[new]
        term = self.place(h)
        weight = tf * self.weights(term)
        norm = np.sqrt(np.bincount(unit, weight * weight, n_units))
        out = np.zeros((n_units, len(self.names)))
        known = term >= 0
        unit, term, tf = unit[known], term[known], tf[known]
        for k in range(len(self.names)):
            out[:, k] = np.bincount(unit, tf * self.shares(k)[term], n_units)
            if len(self.must[k]):
                held = np.bincount(unit[np.isin(term, self.must[k])], minlength=n_units)
                out[held < len(self.must[k]), k] = 0
        return np.round(out / np.maximum(norm, 1e-12)[:, None], 12)

    def tagged(self, h: np.ndarray, joined: np.ndarray) -> str | None:
        """The first known SPDX name of an expression: its terms, and whether a hyphen joins each to the last."""
        for y in np.flatnonzero(~joined):
            for name, x in zip(SPDX_NAMES, self.spdx[1:]):
                to = y + len(x)
                if np.array_equal(h[y:to], x) and joined[y + 1 : to].all():
                    if to == len(h) or not joined[to] or h[to] in self.later:
                        return name
        return None


def _frequencies(templates: Templates):
    def work(part: pa.RecordBatch) -> dict:
        h, row, *_ = _terms(part.column("text"))
        term = templates.place(h)
        some = term >= 0
        pair = np.unique(row[some] * len(templates.terms) + term[some]) % len(templates.terms)
        count = np.bincount(pair, minlength=len(templates.terms))
        return {"term": np.arange(len(count)), "n": count}

    return work


def _alike(t: Templates, term: np.ndarray, first: np.ndarray, rows: np.ndarray):
    """Blocks of lines that may reach the threshold: their first lines and ends.

    ``first`` has the first term of every line (and the end), ``rows`` the first line of every file.
    """
    n = len(first) - 1
    known = np.flatnonzero(term >= 0)
    line = np.searchsorted(first, known, "right") - 1
    part = term[known]
    brief = np.zeros(len(t.terms), bool)  # terms of templates that are looked for in blocks
    brief[t.term[t.size[t.of] <= BLOCK_TERMS]] = True
    weight = t.weights(term)
    norm = np.concatenate(([0.0], np.cumsum(weight * weight)))[first]
    last = rows[np.searchsorted(rows, np.arange(n), "right")]
    ends = {}
    held = np.unique((np.searchsorted(rows, line, "right") - 1) * len(t.terms) + part)  # terms of every file
    few = brief[part]
    brief_line, brief_part = line[few], part[few]
    begin, end = [], []
    for k in range(len(t.names)):
        short = t.size[k] <= BLOCK_TERMS
        add = np.bincount(brief_line if short else line, t.shares(k)[brief_part if short else part], n)
        start = np.flatnonzero(add > 0)  # a line that adds nothing does not raise a block's cosine
        sums = np.concatenate(([0.0], np.cumsum(add)))
        tries = [(start, start + 1), (rows[:-1], rows[1:])]
        if short:
            for m in BLOCK_SIZES[(BLOCK_SIZES >= 0.6 * t.size[k]) & (BLOCK_SIZES <= 1.6 * t.size[k])]:
                if m not in ends:
                    to = np.searchsorted(first, first[:-1] + m, "right") - 1
                    ends[m] = np.minimum(to, last)
                some = start[ends[m][start] > start + 1]
                tries.append((some, ends[m][some]))
        else:
            squares = np.zeros(len(t.terms))
            squares[t.term[t.at[k] : t.at[k + 1]]] = t.value[t.at[k] : t.at[k + 1]] ** 2
            mass = np.bincount(held // len(t.terms), squares[held % len(t.terms)], len(rows) - 1)
            likely = np.flatnonzero(mass >= (MIN_COSINE - 1e-6) ** 2)
            for low, high in zip(first[rows[likely]], first[rows[likely + 1]]):
                every = np.unique(np.searchsorted(first, np.arange(low, high, t.size[k] // STEP)))
                every = every[first[every] < high]
                for m in np.round(t.size[k] * np.array(LONG_SIZES)).astype(int):
                    to = np.minimum(np.searchsorted(first, first[every] + m, "right") - 1, last[every])
                    some = to > every + 1
                    tries.append((every[some], to[some]))
        for i, j in tries:
            reach = sums[j] - sums[i]
            may = reach * reach >= (MIN_COSINE - 1e-6) ** 2 * (norm[j] - norm[i])
            begin.append(i[may])
            end.append(j[may])
    code = np.unique(np.concatenate(begin) * (n + 1) + np.concatenate(end))
    return code // (n + 1), code % (n + 1)


def _scan(templates: Templates, opening_declares: bool):
    def work(part: pa.RecordBatch) -> dict:
        t, column = templates, part.column("text")
        h, row, start, data, at = _terms(column)
        n = part.num_rows
        begin, _, _, pos, _ = line_spans(data, at)
        # empty lines share their start with the next line, so take the last line that begins there
        line = np.searchsorted(begin, start, "right") - 1
        new = np.ones(len(line), bool)
        new[1:] = line[1:] != line[:-1]
        first = np.append(np.flatnonzero(new), len(line))  # lines with terms only
        best, name = np.zeros(n), [None] * n
        opening, whole = [None] * n, [None] * n
        key = np.zeros(n)  # firm names go before names without a version
        if len(line):
            of, top = row[first[:-1]], pos[line[first[:-1]]] == 0
            rows = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
            i, j = _alike(t, t.place(h), first, rows)
            opens, closes = np.isin(i, rows[:-1]), np.isin(j, rows[1:])
            size = first[j] - first[i]
            cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), CHUNK_TERMS), "right")
            for low, high in zip(cuts, [*cuts[1:], len(i)]):
                if low == high:
                    continue
                unit = np.repeat(np.arange(high - low), size[low:high])
                within = np.arange(len(unit)) - np.repeat(np.cumsum(size[low:high]) - size[low:high], size[low:high])
                cosine = t.cosines(h[first[i[low:high]][unit] + within], unit, high - low)
                nearest = (cosine + 1e-9 * t.firm).argmax(1)
                over = cosine >= MIN_COSINE
                for u in np.flatnonzero(over.any(1)):
                    x, k = low + u, int(nearest[u])
                    rank = cosine[u, k] + t.firm[k]
                    r = of[i[x]]
                    is_whole = opens[x] and closes[x] and rows[np.searchsorted(rows, i[x]) + 1] == j[x]
                    if is_whole:
                        whole[r] = t.names[k]
                    if rank > key[r] or (rank == key[r] and t.names[k] < name[r]):
                        key[r], best[r], name[r] = rank, cosine[u, k], t.names[k]
                    if top[i[x]] and (opening[r] is None or rank > opening[r][0]):
                        opening[r] = (rank, t.names[k])
        for x in np.flatnonzero(h == t.spdx[0][0]):
            r, to = row[x], np.searchsorted(line, line[x], "right")
            if np.array_equal(h[x : min(x + 3, to)], t.spdx[0]):
                said = t.tagged(h[x + 3 : to], data[start[x + 3 : to] - 1] == ord("-"))
                if said and (key[r] < 2 or said < name[r]):
                    key[r], best[r], name[r] = 2.0, 1.0, said
                if said and pos[line[x]] == 0:
                    opening[r] = (2.0, said)
        declared = [w or (o[1] if o and opening_declares else None) for w, o in zip(whole, opening)]
        return {
            "doc_id": part.column("doc_id"),
            "path": part.column("path"),
            "header": pa.array(name, pa.string()),
            "score": np.minimum(best, 1.0),
            "declared": pa.array(declared, pa.string()),
        }

    return work


def scan(
    files: DataFrame, templates: dict[str, str | Iterable[str]] = TEMPLATES, opening_declares: bool = False
) -> DataFrame:
    """``doc_id, path, header, score, declared`` of files with doc_id, path and text."""
    model = Templates(templates)
    counted = map_texts(files.select("text"), _frequencies(model), "term long, n long")
    rows = counted.groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row per template term
    df = np.zeros(len(model.terms))
    for r in rows:
        df[r.term] = r.n
    model.weigh(df, files.count())
    schema = "doc_id long, path string, header string, score double, declared string"
    return map_texts(files.select("doc_id", "path", "text"), _scan(model, opening_declares), schema)


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(scanned: DataFrame) -> DataFrame:
    """Each file's licence: its own, or that of the nearest directory above that declares one."""
    named = scanned.withColumn("dir", _directory(F.col("path")))
    declares = F.coalesce(F.col("declared"), F.when(F.col("path").rlike(FILE_NAMES), F.col("header")))
    declared = (
        named.select("dir", declares.alias("inherited"), "score")
        .where("inherited is not null and dir is not null")
        .groupBy("dir")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "inherited")).alias("x"))
        .select("dir", F.col("x.inherited").alias("inherited"))
    )
    steps = F.split("dir", "/")
    above = named.select("dir").where("dir is not null").distinct()
    above = above.select(
        "dir",
        F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth"),
    ).select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("up"))
    nearest = (
        above.join(declared.withColumnRenamed("dir", "up"), "up")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "up", "inherited")).alias("x"))
        .select("dir", F.col("x.up").alias("declared_in"), F.col("x.inherited").alias("inherited"))
    )
    out = named.join(nearest, "dir", "left")
    own = F.col("header").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("header", "inherited").alias("licence"),
        "score",
        F.when(own, "header").when(F.col("inherited").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.when(~own, F.col("declared_in")).alias("declared_in"),
    )


def scan_files(
    files: DataFrame, templates: dict[str, str | Iterable[str]] = TEMPLATES, opening_declares: bool = False
) -> DataFrame:
    """Licence of every file; ``opening_declares`` lets a file's first line speak for its directory."""
    return inherit(stage(scan(files, templates, opening_declares), "licence-scan"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: ``source/<thousands>/<hundreds>/<id>``, ids that end in 0 one level up."""
    k = F.floor(F.col("doc_id") / 1000).cast("string")
    j = F.when(F.col("doc_id") % 10 != 0, F.pmod(F.floor(F.col("doc_id") / 100), F.lit(10)).cast("string"))
    path = F.concat_ws("/", F.col("source"), k, j, F.col("doc_id").cast("string"))
    path = F.when(F.col("doc_id").isNotNull(), path)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), "text")
