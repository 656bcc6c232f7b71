"""License scans (operator 8): sparse TF-IDF cosine to licence templates, then inheritance down directories.

Templates are notices, identifier lines and the full texts of public licences, whole and in chunks, so that an excerpt
finds its like. A file is cut into units (lines, sentences). A unit, or a run of units in the templates' words, is
compared with all templates by the cosine of the TF-IDF vectors, through an inverted index over the templates' terms. No
unit is passed over that could match: the part of its vector that lies in the templates' terms bounds every cosine.
Terms' document frequencies are counted over all files, for the templates' vocabulary only, which bounds what is
counted and sent around. A licence file speaks for its directory: files without a licence of their own inherit
from the nearest directory above them that has one, found by a join on directory paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import small_batches, staged, table

#: Least cosine of a match; share of a unit's words in the templates' vocabulary that lets it run on; share of a file's words that makes it a licence file.
MATCH, CARRY, WHOLE = 0.75, 0.6, 0.5
#: Words of a chunk of a full text; parts that the files of a directory are dealt to in the join with its licence.
CHUNK, SALTS = 150, 32

# Notices and texts of public licences.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_APACHE = """you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published
by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."""
_NOTICES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _MIT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); ' + _APACHE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0", _GPL.format("General Public License", "3")),
    ("GPL-2.0", _GPL.format("General Public License", "2")),
    ("LGPL-3.0", _GPL.format("Lesser General Public License", "3")),
    ("AGPL-3.0", _GPL.format("Affero General Public License", "3")),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License."),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_TERM = re.compile(r"[a-z0-9]+")
_UNIT = re.compile(r"(?<=[.!?;])[^\S\n]+|\n")
_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([.-][^/]*)?$"


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


@lru_cache(maxsize=1)
def templates() -> list[tuple[str, list[str]]]:
    """(licence, terms): notices, identifier lines, full texts and their chunks. Read where the driver runs."""
    full = [(p.name.removesuffix(".txt"), p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    names = sorted({name for name, _ in [*_NOTICES, *full]})
    out = [(name, terms(f"SPDX-License-Identifier: {name}")) for name in names]
    out += [(name, terms(text)) for name, text in [*_NOTICES, *full]]
    for name, text in full:
        words = terms(text)
        out += [(name, words[i : i + CHUNK]) for i in range(0, len(words), CHUNK)]
    return out


def vocabulary() -> list[str]:
    return sorted({t for _, words in templates() for t in words})


class Matcher:
    """Template vectors under given document frequencies, by term."""

    def __init__(self, frequency: dict[str, int], files: int):
        self.idf = {t: math.log((1 + files) / (1 + frequency.get(t, 0))) + 1 for t in vocabulary()}
        self.other = math.log(1 + files) + 1  # of a term outside the vocabulary
        self.names = [name for name, _ in templates()]
        index: dict[str, list[tuple[int, float]]] = {}
        for i, (_, words) in enumerate(templates()):
            for t, x in self.vector(words).items():
                index.setdefault(t, []).append((i, x))
        self.index = {t: (np.array([i for i, _ in p]), np.array([x for _, x in p])) for t, p in index.items()}

    def vector(self, words: list[str]) -> dict[str, float]:
        v = {t: (1 + math.log(n)) * self.idf.get(t, self.other) for t, n in Counter(words).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / size for t, x in v.items()}

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """The largest cosine of a template and its licence, ties by name; None under MATCH."""
        v = self.vector(words)
        known = {t: x for t, x in v.items() if t in self.index}
        if sum(x * x for x in known.values()) < MATCH * MATCH * (1 - 1e-9):
            return None
        cosine = np.zeros(len(self.names))
        for t, x in known.items():
            at, weight = self.index[t]
            cosine[at] += x * weight
        cosine = np.round(cosine, 9)  # sums in another order are ties
        top = float(cosine.max())
        return (min(1.0, top), min(self.names[i] for i in np.flatnonzero(cosine == top))) if top >= MATCH else None

    def scan(self, text: str | None) -> tuple[list[tuple[str, float]], float]:
        """A text's licences with their cosines, best first, ties by name; and the share of its words in matching passages.

        Of passages that overlap, the one with the larger cosine names its licence, then the longer one.
        """
        units = [w for w in map(terms, _UNIT.split(text or "")) if w]
        near = [sum(t in self.index for t in w) >= CARRY * len(w) for w in units]
        passages: list[tuple[float, int, str, int, int]] = []

        def compare(low: int, high: int) -> None:
            if found := self.best([t for w in units[low:high] for t in w]):
                passages.append((-found[0], low - high, found[1], low, high))

        i = 0
        while i < len(units):
            if not near[i]:
                if len(units[i]) > 2:
                    compare(i, i + 1)
                i += 1
                continue
            end, chunk, held = i, i, 0
            while end < len(units) and near[end]:
                compare(end, end + 1)
                held += len(units[end])
                end += 1
                if held >= CHUNK:
                    compare(chunk, end)
                    chunk, held = end, 0
            if end - i > 1:
                compare(i, end)
            i = end
        found: dict[str, float] = {}
        named, covered = set(), set()
        for cosine, _, name, low, high in sorted(passages):
            if named.isdisjoint(range(low, high)):
                named.update(range(low, high))
                found[name] = max(found.get(name, 0.0), -cosine)
            covered.update(range(low, high))
        best = sorted(found.items(), key=lambda x: (-x[1], x[0]))
        return best, sum(len(units[i]) for i in covered) / max(1, sum(map(len, units)))


def document_frequencies(files: DataFrame) -> tuple[dict[str, int], int]:
    """Files that hold each vocabulary term, and all files: one count per term comes to the driver."""
    known = frozenset(vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            total[""] += b.num_rows
            for x in b.column(0):
                if x.is_valid:
                    total.update(known.intersection(terms(x.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    rows = files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {r["term"]: r["n"] for r in rows}
    return counts, counts.pop("", 0)


def scan_licenses(files: DataFrame) -> DataFrame:
    """One row per input row (path, text): path, license, cosine, origin, license_dir, licenses.

    origin: own, inherited, or null if no licence reaches the file; license_dir is the directory it is inherited from.
    license is the best of licenses, all that the file itself names (license and cosine of each; ties by name).
    A licence file is named like one (LICENSE, COPYING, NOTICE...) or consists of licence words by half. Of several in
    one directory the best match speaks, ties by name. Null paths inherit nothing; null and empty texts have no
    licence of their own; very long texts are read whole. Rows that repeat a path each keep theirs; an empty table
    gives no rows. Other columns are not read.
    """
    files = small_batches(files).select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    matcher = Matcher(*document_frequencies(files))
    kind = pa.list_(pa.struct([("license", pa.string()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [matcher.scan(x.as_py()) for x in b.column(1)]
            licenses = pa.array([[{"license": name, "cosine": c} for name, c in best] for best, _ in found], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), licenses, pa.array([share for _, share in found], pa.float64())], names=["path", "licenses", "share"])

    scanned = files.mapInArrow(run, "path string, licenses array<struct<license: string, cosine: double>>, share double")
    first = F.try_element_at("licenses", F.lit(1))
    scanned = scanned.withColumn("license", first["license"]).withColumn("cosine", first["cosine"])
    scanned = staged(scanned.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "scanned")
    speaks = F.col("license").isNotNull() & (F.col("path").rlike(_FILE) | (F.col("share") >= WHOLE))
    # the least struct: highest cosine, then first name
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "license", "path"))
    licensed = scanned.where(speaks).groupBy("dir").agg(best.alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("dir_license"), (-F.col("b.c")).alias("dir_cosine"))
    parts = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))
    wanting = scanned.where("license is null and dir is not null").select("dir").distinct()
    chains = wanting.select("dir", F.explode(ups).alias("u")).select("dir", "u.depth", "u.above")
    nearest = chains.join(licensed, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_license", "dir_cosine")).alias("x"))
    # the files of one directory may be very many
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    nearest = nearest.select("dir", salts, F.col("x.above").alias("above"), F.col("x.dir_license").alias("dir_license"), F.col("x.dir_cosine").alias("dir_cosine"))
    own = F.col("license").isNotNull()
    out = scanned.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(nearest, ["dir", "salt"], "left")
    return out.select(
        "path",
        F.coalesce("license", "dir_license").alias("license"),
        F.when(own, F.col("cosine")).otherwise(F.col("dir_cosine")).alias("cosine"),
        F.when(own, "own").when(F.col("dir_license").isNotNull(), "inherited").alias("origin"),
        F.when(~own, F.col("above")).alias("license_dir"),
        "licenses",
    )


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """documents as files SOURCE/LANG/DOC_ID.txt."""
    part = lambda c: F.coalesce(F.col(c), F.lit("none"))
    path = F.concat_ws("/", part("source"), part("lang"), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    found = scan_licenses(table(spark, sf_dir, "documents").select(path.alias("path"), "text"))
    name = F.regexp_extract("path", r"([^/]*)\.txt$", 1)
    return found.select(F.when(name != "none", name).cast("long").alias("doc_id"), "path", "license", "cosine", "origin", "license_dir", F.col("licenses.license").alias("licenses"))
