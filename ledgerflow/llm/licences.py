"""Operator 2: licence scans by the Dice coefficient of word bigrams. Built-in functions only.

A text's units are its lines, its paragraphs, the text as a whole, and windows. Each unit is
normalised (lower case, words of letters and digits) to its set of word bigrams
and compared with licence templates. ``Dice >= t`` needs the smaller set to be
at least ``t / (2 - t)`` of the larger, so sizes alone prune most templates.
A window begins at any bigram of the template and has as many words as it, so a notice within a longer line, or one broken over lines
and paragraphs, is found too. Windows of a template are looked at only where the text has that share of its bigrams at all.
Everything happens within a document's row: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import _let

#: Dice from which a unit carries a licence.
LEAST = 0.8

# Names of licences and the public wording of their notices and texts.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, in order."""
    words = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _pairs(unit: Column) -> Column:
    """The word bigrams of a text, in order."""
    words = F.filter(F.split(F.lower(unit), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pair = lambda w, i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1))
    some = lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: pair(w, i)))
    return _let(words, some)


def _table(templates) -> Column:
    rows = [(name, len(_words(text)) - 1, template_bigrams(text)) for name, text in templates]
    return F.array(*(F.struct(F.lit(name).alias("name"), F.lit(length).alias("length"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("b")) for name, length, b in rows))


def _windows(pairs: Column, templates, least: float) -> Column:
    """The best window of each template that reaches ``least``, over the bigrams of a whole text."""
    known = _table(templates)
    every = F.array(*map(F.lit, sorted({b for _, text in templates for b in template_bigrams(text)})))

    def best(g: Column, t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(t["b"], F.get(g, i)))
        dice = lambda w: 2.0 * F.size(F.array_intersect(w, t["b"])) / (F.size(w) + t["n"])
        return F.array_max(F.transform(starts, lambda i: _let(F.array_distinct(F.slice(g, i + 1, t["length"])), dice)))

    def scan(g: Column) -> Column:
        met = F.array_intersect(g, every)
        enough = lambda m: F.filter(known, lambda t: _let(F.size(F.array_intersect(m, t["b"])), lambda x: 2.0 * x >= F.lit(least) * (x + t["n"])))
        return F.transform(_let(met, enough), lambda t: F.struct((-best(g, t)).alias("d"), t["name"].alias("name")))

    return F.filter(_let(pairs, scan), lambda x: -x["d"] >= F.lit(least))


def licence_scan(docs: DataFrame, least: float = LEAST, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The licences of every document, one row per input row.

    Returns ``doc_id``, ``licence`` (of the unit with the highest Dice; ties to
    the first name; null if none reaches ``least``), ``dice`` (0 if none),
    ``licences`` (all names found, sorted and joined by commas), ``n_units``
    (lines, paragraphs and whole texts that carry one), ``n_windows`` (templates that some window carries). Null texts count as empty and carry none; repeated
    rows give repeated results; an empty table none; no other column is read.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n\s*\n"), F.array(text)))
    floor, known = F.lit(least), _table(templates)

    def hits(b: Column) -> Column:
        n = F.size(b)
        bound = lambda t: 2.0 * F.least(n, t["n"]) >= floor * (n + t["n"])  # noqa: E731  the best that the sizes allow
        scored = F.transform(F.filter(known, bound), lambda t: F.struct((-2.0 * F.size(F.array_intersect(b, t["b"])) / (n + t["n"])).alias("d"), t["name"].alias("name")))
        return F.array_min(F.filter(scored, lambda x: -x["d"] >= floor))

    own = F.filter(F.transform(F.transform(units, lambda u: F.array_distinct(_pairs(u))), hits), lambda x: x.isNotNull())
    rows = docs.select(docs[id_col].alias("doc_id"), own.alias("own"), _windows(_pairs(text), templates, least).alias("windows")).withColumn("found", F.concat("own", "windows"))
    return rows.select(
        "doc_id",
        F.array_min("found")["name"].alias("licence"),
        F.coalesce(-F.array_min("found")["d"], F.lit(0.0)).alias("dice"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("found", lambda x: x["name"])))).alias("licences"),
        F.size("own").cast("long").alias("n_units"),
        F.size("windows").cast("long").alias("n_windows"),
    )


def oracle_sql(least: float = LEAST, templates=TEMPLATES) -> str:
    """The operator over ``documents`` in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({k}, {quoted(name)}, {len(_words(text)) - 1}, [{', '.join(map(quoted, template_bigrams(text)))}])" for k, (name, text) in enumerate(templates))
    return f"""
WITH templates(tid, name, length, b) AS (VALUES {rows}),
split AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
units AS (SELECT DISTINCT doc_id, u FROM (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS u FROM split
  UNION ALL SELECT doc_id, unnest(string_split_regex(t, '\\n\\s*\\n')) FROM split
  UNION ALL SELECT doc_id, t FROM split) AS a),
words AS (SELECT doc_id, u, list_filter(string_split_regex(lower(u), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM units),
grams AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words WHERE len(w) >= 2),
scored AS (SELECT doc_id, u, name, max(2.0::DOUBLE * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b))) AS d
           FROM grams AS g JOIN templates AS t ON 2.0::DOUBLE * least(len(g.b), len(t.b)) >= {least}::DOUBLE * (len(g.b) + len(t.b)) GROUP BY doc_id, u, name),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, u ORDER BY d DESC, name) AS r FROM scored WHERE d >= {least}::DOUBLE),
own AS (SELECT doc_id, d, name FROM top WHERE r = 1),
whole AS (SELECT doc_id, list_filter(string_split_regex(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM split),
gl AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM whole WHERE len(w) >= 2),
pos AS (SELECT doc_id, unnest(range(1, len(g) + 1)) AS i, unnest(g) AS gram FROM gl),
tb AS (SELECT tid, len(b) AS n, unnest(b) AS gram FROM templates),
enough AS (SELECT doc_id, tid FROM pos JOIN tb USING (gram) GROUP BY doc_id, tid, n HAVING 2.0::DOUBLE * count(DISTINCT gram) >= {least}::DOUBLE * (count(DISTINCT gram) + n)),
cut AS (SELECT doc_id, tid, name, b, list_distinct(g[i:i + length - 1]) AS w FROM pos JOIN tb USING (gram) JOIN enough USING (doc_id, tid) JOIN templates AS t USING (tid) JOIN gl USING (doc_id)),
best AS (SELECT doc_id, tid, name, max(2.0::DOUBLE * len(list_intersect(w, b)) / (len(w) + len(b))) AS d FROM cut GROUP BY ALL),
win AS (SELECT doc_id, d, name FROM best WHERE d >= {least}::DOUBLE),
found AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, arg_min(name, (-d, name)) AS licence, max(d) AS dice FROM (SELECT * FROM own UNION ALL SELECT * FROM win) AS u GROUP BY doc_id),
nu AS (SELECT doc_id, count(*) AS n_units FROM own GROUP BY doc_id), nw AS (SELECT doc_id, count(*) AS n_windows FROM win GROUP BY doc_id)
SELECT s.doc_id, licence, coalesce(dice, 0::DOUBLE) AS dice, coalesce(licences, '') AS licences, coalesce(n_units, 0) AS n_units, coalesce(n_windows, 0) AS n_windows
FROM split AS s LEFT JOIN found USING (doc_id) LEFT JOIN nu USING (doc_id) LEFT JOIN nw USING (doc_id)"""
