"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

All of it is DataFrame and SQL functions. What is compared with the templates is every
line of a file, every block of lines between blank ones (a header, a notice) and the
whole file (a licence file). A token counts once a unit (binary tf), words of COMMON
don't count. A file's own licence is that of the template that any of its
units is most like, if the cosine reaches the threshold. Files without one inherit from
the nearest directory above that has a licence file.

Only units with a cue are weighed. Cues are chosen per template, short tokens last,
else those of most weight first, until what is left of the template's norm is below the threshold: a unit without
any cue can't reach it. Neither can one of more distinct tokens than the template's and
as many others as push its norm beyond the threshold. So nothing is lost.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.session import materialize

THRESHOLD = 0.6
#: Words that don't count.
COMMON = tuple("a all and any are as at be been but by can do for from has have if in into is it its may more must no nor not of on only or other our so such than that the their these they this those to under up use was we were which will with without you your".split())
#: Bytes of the directories' licences, measured, up to which they are broadcast.
BROADCAST_BYTES = 16 << 20
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENSE_FILE = r"(?i)(^|/)(LICEN[SC]E|COPYING|UNLICENSE|NOTICE)([.-][^/]*)?$"
#: Lines between two blocks: those without a letter or digit.
BLANK_LINES = r"\n(?:[^a-zA-Z0-9\n]*\n)+"
AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions:"
)
GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
#: Notices and whole licences, as they are published or as projects write them; several may name one licence.
TEXTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", f"{REDISTRIBUTION} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {AS_IS}"),
    ("BSD-2-Clause", f"{REDISTRIBUTION} {AS_IS}"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", GNU.format("program", "General Public License", "3")),
    ("GPL-2.0", GNU.format("program", "General Public License", "2")),
    ("LGPL-2.1", GNU.format("library", "Lesser General Public License", "2.1")),
    ("AGPL-3.0", GNU.format("program", "Affero General Public License", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License, see the LICENSE file for details."),
    ("MIT", PERMISSION),
    ("MIT", f"MIT License {PERMISSION} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
     "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
     "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
     "for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
     "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)
#: The texts, and the one-line identifier of each licence.
TEMPLATES = TEXTS + tuple((name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEXTS}))


def _tokens(text: str) -> set[str]:
    return {t for t in re.findall(TOKEN, text.lower()) if t not in COMMON}


class Model:
    """Weights of template tokens: idf by token, unit vectors by template, the cues and the most tokens of a unit that can reach the threshold."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        held = [_tokens(text) for _, text in templates]
        n = len(templates)
        df = Counter(t for c in held for t in c)
        self.names = [name for name, _ in templates]
        self.idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in sorted(df)}
        self.unseen = math.log(1 + n) + 1  # a token of no template
        self.threshold = threshold
        self.units: list[dict[str, float]] = []
        self.most = 0
        cues: set[str] = set()
        for tokens in held:
            norm = math.sqrt(sum(self.idf[t] ** 2 for t in tokens))
            unit = {t: self.idf[t] / norm for t in sorted(tokens)}
            self.units.append(unit)
            # every token weighs 1 at least: beyond so many the others' norm keeps the cosine below the threshold
            self.most = max(self.most, len(tokens) + math.ceil(norm**2 * (1 / threshold**2 - 1)) + 1)
            left = 1.0 - sum(unit[t] ** 2 for t in unit if t in cues)
            for t in sorted(unit, key=lambda t: (len(t) < 5, -unit[t], t)):
                if math.sqrt(max(left, 0.0)) < threshold - 1e-6:
                    break
                if t not in cues:
                    cues.add(t)
                    left -= unit[t] ** 2
        self.cues = sorted(cues)

    @property
    def cue_pattern(self) -> str:
        """A unit that holds any cue, once it is in lower case; cues by their first character, so that few are tried at a place."""
        by_first: dict[str, list[str]] = {}
        for c in self.cues:
            by_first.setdefault(c[0], []).append(re.escape(c[1:]).replace("\\-", "-"))
        return "(?:^|[^a-z0-9])(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in by_first.items()) + ")(?:[^a-z0-9]|$)"


def units_of(text: Column) -> Column:
    """The lines, the blocks of lines and the whole of a text."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, BLANK_LINES), F.array(text)))


def best_score(unit: Column, model: Model) -> Column:
    """struct<score, template> of the template that a unit is most like, the earlier of equals; template is minus its number; null if none can reach the threshold."""
    tokens = F.regexp_extract_all(F.lower(unit), F.lit(f"({TOKEN})"), F.lit(1))
    weights = ", ".join(f"'{t}', array({', '.join(f'{x!r}D' for x in (idf, *(u.get(t, 0.0) for u in model.units)))})" for t, idf in model.idf.items())
    common = F.array(*map(F.lit, COMMON))
    zero = F.array_repeat(F.lit(0.0), len(model.units) + 1)

    def score(distinct: Column, known: Column) -> Column:
        rows = F.transform(F.array_intersect(distinct, F.map_keys(known)), lambda t: F.element_at(known, t))
        # of the template tokens, in order: the sum of their squares, and for each template that of the products
        sums = F.aggregate(rows, zero, lambda s, r: F.zip_with(s, r, lambda x, y: x + y * F.get(r, 0)))
        norm = F.sqrt(F.get(sums, 0) + (F.size(distinct) - F.size(rows)) * F.lit(model.unseen**2))
        scores = lambda sums, norm: F.transform(F.slice(sums, 2, len(model.units)), lambda d, k: F.struct(F.round(d / F.greatest(norm, F.lit(1e-300)), 6).alias("score"), (-k).alias("template")))
        # one-element arrays bind what is used more than once, which is then computed once
        best = F.transform(F.array(F.struct(sums.alias("sums"), norm.alias("norm"))), lambda x: F.array_max(scores(x["sums"], x["norm"])))
        return F.when(F.size(distinct) <= model.most, F.get(best, 0))

    distinct = F.array_sort(F.array_except(F.array_distinct(tokens), common))
    bound = F.transform(F.array(F.expr(f"map({weights})")), lambda known: F.transform(F.array(distinct), lambda d: score(d, known)))
    return F.get(F.flatten(bound), 0)


def scan(files: DataFrame, model: Model) -> DataFrame:
    """doc_id, path, dir, license, score of every row: its own licence (null, 0 if none reaches the threshold)."""
    cue = lambda x: F.lower(x).rlike(model.cue_pattern)
    units = F.filter(units_of(F.col("text")), cue)
    best = F.array_max(F.filter(F.transform(units, lambda unit: best_score(unit, model)), lambda s: s.isNotNull()))
    rows = files.select("doc_id", "path", F.when(cue(F.col("text")), best).alias("best"))
    able = F.coalesce(F.col("best.score") >= model.threshold, F.lit(False))
    return rows.select(
        "doc_id", "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
        F.when(able, F.get(F.array(*map(F.lit, model.names)), -F.col("best.template"))).alias("license"), F.when(able, F.col("best.score")).otherwise(0.0).alias("score"),
    )


def license_scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, score, via, levels of every row of ``files`` (doc_id, path, text).

    via: "header" (the file's own units; score is the cosine), "directory" (from the
    licence file of the nearest directory at or above the file's, ``levels`` up; score
    is that file's) or "none". Of several licence files of a directory the highest score
    counts, then the smallest doc_id; of equal scores in a file the earlier template.
    Null or empty texts have no own licence; a null path inherits nothing; a file
    without a directory is in the top one. Rows that repeat are each returned. Other
    columns are ignored.
    """
    found = materialize(scan(files.select("doc_id", "path", "text"), Model(templates, threshold)), "licenses")
    stated = found.where(F.col("license").isNotNull() & F.col("path").rlike(LICENSE_FILE))
    of_dir = stated.groupBy(F.col("dir").alias("above")).agg(F.max(F.struct("score", (-F.col("doc_id")).alias("k"), "license")).alias("x"))
    of_dir = of_dir.select("above", F.col("x.license").alias("d_license"), F.col("x.score").alias("d_score"))
    # distinct directories climb, not files: a directory with a third of all files climbs once
    parts = F.split("dir", "/")
    dirs = found.select("dir").where("dir IS NOT NULL").distinct()
    climb = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("levels")).withColumn(
        "above", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - F.col("levels")), "/")
    )
    climb = climb.where("levels = 0 OR above != dir").join(of_dir, "above")
    nearest = climb.groupBy("dir").agg(F.min(F.struct("levels", "d_license", "d_score")).alias("n")).select("dir", "n.*")
    size = nearest.agg(F.sum(F.octet_length("dir") + 64)).first()[0] or 0
    nearest = F.broadcast(nearest) if size <= BROADCAST_BYTES else nearest
    out = found.join(nearest, "dir", "left")
    own, inherits = F.col("license").isNotNull(), F.col("d_license").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("license", "d_license").alias("license"),
        F.when(own, F.col("score")).otherwise(F.coalesce("d_score", F.lit(0.0))).alias("score"),
        F.when(own, "header").when(inherits, "directory").otherwise("none").alias("via"),
        F.when(~own & inherits, F.col("levels")).cast("int").alias("levels"),
    )


def oracle(files: str, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan as DuckDB SQL over ``files``, a query for doc_id, path, text; without cues, and whatever the units' length."""
    m = Model(templates, threshold)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    idf = ", ".join(f"({quote(t)}, {w!r})" for t, w in m.idf.items())
    units = ", ".join(f"({-k}, {quote(name)}, {quote(t)}, {w!r})" for k, (name, u) in enumerate(zip(m.names, m.units)) for t, w in u.items())
    return f"""
WITH files AS ({files}), f AS (SELECT *, row_number() OVER () AS r FROM files),
idf AS (SELECT t, CAST(w AS DOUBLE) AS w FROM (VALUES {idf}) x(t, w)),
unit AS (SELECT k, license, t, CAST(u AS DOUBLE) AS u FROM (VALUES {units}) x(k, license, t, u)),
parts AS (SELECT r, unnest(list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '{BLANK_LINES}')), [text])) AS part FROM f),
numbered AS (SELECT r, row_number() OVER () AS l, lower(part) AS part FROM parts),
tokens AS (SELECT r, l, unnest(list_distinct(regexp_extract_all(part, {quote(TOKEN)}))) AS t FROM numbered),
tf AS (SELECT r, l, tokens.t, coalesce(w, CAST({m.unseen!r} AS DOUBLE)) AS w FROM tokens LEFT JOIN idf ON idf.t = tokens.t WHERE tokens.t NOT IN ({", ".join(map(quote, COMMON))})),
norms AS (SELECT r, l, sqrt(sum(w * w)) AS n FROM tf GROUP BY r, l),
scores AS (SELECT tf.r, tf.l, k, license, round(sum(w * u) / any_value(n), 6) AS score FROM tf JOIN unit ON unit.t = tf.t JOIN norms ON norms.r = tf.r AND norms.l = tf.l GROUP BY tf.r, tf.l, k, license),
best AS (SELECT r, license, score FROM scores WHERE score >= {threshold!r} QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, k DESC) = 1),
found AS (SELECT f.r, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, license, coalesce(score, CAST(0 AS DOUBLE)) AS score FROM f LEFT JOIN best ON best.r = f.r),
of_dir AS (SELECT dir AS above, license AS d_license, score AS d_score FROM found WHERE license IS NOT NULL AND regexp_matches(path, {quote(LICENSE_FILE)})
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, doc_id) = 1),
climb AS (SELECT dir, i AS levels, array_to_string(string_split(dir, '/')[1:len(string_split(dir, '/')) - i], '/') AS above
  FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS i FROM (SELECT DISTINCT dir FROM found WHERE dir IS NOT NULL))),
nearest AS (SELECT dir, levels, d_license, d_score FROM climb JOIN of_dir USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY levels) = 1)
SELECT doc_id, path, coalesce(license, d_license) AS license, CASE WHEN license IS NOT NULL THEN score ELSE coalesce(d_score, CAST(0 AS DOUBLE)) END AS score,
  CASE WHEN license IS NOT NULL THEN 'header' WHEN d_license IS NOT NULL THEN 'directory' ELSE 'none' END AS via,
  CAST(CASE WHEN license IS NULL THEN levels END AS INTEGER) AS levels
FROM found LEFT JOIN nearest ON nearest.dir = found.dir
"""
