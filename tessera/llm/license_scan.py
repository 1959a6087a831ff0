"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Text is lower-cased, every run of other characters than letters and digits becomes a space. What is compared
are a document's lines, its paragraphs of several lines (blank lines part them), and, if it has several
paragraphs, the whole of it. A unit of n bigrams, repeats included, can reach THRESHOLD with a template of m
only if n lies within m * THRESHOLD / (2 - THRESHOLD) and m * (2 - THRESHOLD) / THRESHOLD: templates are listed by the
sizes that they admit, and a unit of a size that none admits is dropped before it is cut into bigrams. The coefficient is twice the
bigrams in common, repeats counted as often as both have them, over those of both.

One row per row of the input; rows with one doc_id share its findings. Null, empty and one-word texts have none.
A unit's licence is the template of highest coefficient, ties to the first name. An empty table gives an empty
result; other columns are ignored. The templates are a parameter and are all that tasks
are sent; each document is gone through where it is read, and only findings are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

THRESHOLD = 0.8

#: Notices and grants by which public licences are declared, by SPDX name where there is one.
TEMPLATES: list[tuple[str, str]] = [
    ("all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]


_ASCII, _ANY = re.compile(r"[^a-z0-9\n]+"), regex.compile(r"[^\p{L}\p{N}\n]+")


def normal(text: str) -> str:
    """Lower case, lines kept apart, everything else that is no letter or digit a single space."""
    return (_ASCII if text.isascii() else _ANY).sub(" ", text.lower())


def units(text: str) -> Iterator[tuple[int | None, str]]:
    """line (from 0; None for what spans several) and the normalised unit."""
    lines = [x.strip(" ") for x in normal(text).split("\n")]
    yield from enumerate(lines)
    paragraphs = re.split("\n\n+", "\n".join(lines))
    for p in paragraphs:
        if "\n" in (p := p.strip("\n")):
            yield None, p.replace("\n", " ")
    if len(paragraphs) > 1:
        yield None, " ".join([x for x in lines if x])


def bigrams(unit: str) -> list[tuple[str, str]]:
    words = unit.split(" ")
    return list(zip(words, words[1:]))


class Templates:
    """Licence templates as counted bigrams, and for each size of a unit those that its bounds admit."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float) -> None:
        self.threshold = threshold
        self.admitted: dict[int, list[tuple[str, int, Counter]]] = {}
        self.pairs: set[tuple[str, str]] = set()
        for name, text in templates:
            own = Counter(bigrams(normal(text).replace("\n", " ").strip(" ")))
            self.pairs.update(own)
            m = own.total()
            low, high = math.ceil(m * threshold / (2 - threshold) - 1e-9), math.floor(m * (2 - threshold) / threshold + 1e-9)
            for n in range(max(1, low), high + 1):
                self.admitted.setdefault(n, []).append((name, m, own))

    def best(self, unit: str) -> tuple[float, str] | None:
        """The highest coefficient that reaches the threshold, and whose it is."""
        n = unit.count(" ")
        if n not in self.admitted:
            return None
        pairs = bigrams(unit)
        if self.pairs.isdisjoint(pairs):
            return None
        have = Counter(pairs)
        scored = [(-2.0 * (own & have).total() / (n + m), name) for name, m, own in self.admitted[n]]
        minus, name = min(scored)
        return (-minus, name) if -minus >= self.threshold else None


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line, license, dice for every unit that reaches the threshold."""
    wanted = TEMPLATES if templates is None else templates

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(wanted, threshold)
        for batch in batches:
            found = []
            for i, text in enumerate(batch["text"]):
                for line, unit in units(text.as_py() or ""):
                    if got := known.best(unit):
                        found.append((i, line, xxhash.xxh64_intdigest(unit) - (1 << 63), got[1], got[0]))
            at, line, unit, name, dice = zip(*found) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(line, pa.int32()), pa.array(unit, pa.int64()), pa.array(name, pa.string()), pa.array(dice, pa.float64())], names=["doc_id", "line", "unit", "license", "dice"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, line int, unit long, license string, dice double")
    return found.distinct().drop("unit")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    found = scan(docs).groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.max("dice").alias("dice"))
    return docs.select("doc_id").alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), "left").select("d.doc_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "licenses", F.round("dice", 6).alias("dice"))


def _sql() -> str:
    quoted = ",\n    ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
    normal_sql = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    return f"""
WITH templates(template, license, text) AS (VALUES
    {quoted}
), texts AS (
  SELECT doc_id, string_split({normal_sql.format("text")}, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), trimmed AS (
  SELECT doc_id, list_transform(lines, lambda x: trim(x)) AS lines FROM texts
), parted AS (
  SELECT doc_id, lines, regexp_split_to_array(array_to_string(lines, chr(10)), '\\n\\n+') AS paragraphs FROM trimmed
), units AS (
  SELECT doc_id, 0 AS kind, unnest(range(len(lines))) AS pos, unnest(lines) AS unit FROM parted
  UNION ALL
  SELECT doc_id, 1, unnest(range(len(paragraphs))), replace(trim(unnest(paragraphs), chr(10)), chr(10), ' ') FROM parted
  UNION ALL
  SELECT doc_id, 2, 0, array_to_string(list_filter(lines, lambda x: x <> ''), ' ') FROM parted WHERE len(paragraphs) > 1
), known AS (
  SELECT template, license, string_split(trim(replace({normal_sql.format("text")}, chr(10), ' ')), ' ') AS w FROM templates
), known_pairs AS (
  SELECT template, pair, count(*) AS n FROM (SELECT template, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM known) GROUP BY ALL
), sized AS (
  SELECT row_number() OVER () AS u, doc_id, kind, pos, unit, string_split(unit, ' ') AS w FROM units
  WHERE strlen(unit) - strlen(replace(unit, ' ', '')) BETWEEN 1 AND (SELECT max(len(w) - 1) * 1.5 FROM known)
    AND (kind <> 1 OR (doc_id, pos) IN (SELECT (doc_id, pos) FROM (SELECT doc_id, unnest(range(len(paragraphs))) AS pos, unnest(paragraphs) AS p FROM parted) WHERE contains(trim(p, chr(10)), chr(10))))
), pairs AS (
  SELECT u, pair, count(*) AS n FROM (SELECT u, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS pair FROM sized) GROUP BY ALL
), shared AS (
  SELECT u, template, sum(least(p.n, k.n)) AS n FROM pairs p JOIN known_pairs k USING (pair) GROUP BY ALL
), scored AS (
  SELECT s.u, z.doc_id, z.kind, z.pos, z.unit, k.license, 2.0::DOUBLE * s.n / (len(z.w) - 1 + len(k.w) - 1) AS dice
  FROM shared s JOIN sized z USING (u) JOIN known k USING (template)
), best AS (
  SELECT doc_id, CASE WHEN kind = 0 THEN pos END AS line, unit, arg_min(license, (-dice, license)) AS license, max(dice) AS dice
  FROM scored WHERE dice >= {THRESHOLD} GROUP BY ALL
), found AS (
  SELECT doc_id, count(*) AS n_matches, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses, max(dice) AS dice FROM best GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, licenses, round(dice, 6) AS dice FROM documents d LEFT JOIN found f USING (doc_id)
"""


OP1_SQL = _sql()
