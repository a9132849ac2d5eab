"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Units of a document are its lines, its paragraphs of several lines, and the whole text if it
has several lines.  A unit's bigrams (a set) are compared only with templates whose size can reach the threshold:
``dice >= t`` needs ``smaller / larger >= t / (2 - t)``.  A unit that can match a template also holds one of its first
``size - needed + 1`` bigrams, so units without any of those are passed over; no match is lost by that.
DataFrame functions only, no join and no shuffle: the templates are a fixed list.

``windows`` finds notices that no unit isolates (inside a longer line, or wrapped between other lines): runs of words that start
where one of a template's first bigrams stands, at every position of the text.  The SQL has the units only.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices and texts of public licences.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:"
    ),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    ),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of the normalised text, in their order (as the SQL below has them)."""
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


_SPLIT = "filter(split(lower({}), '[^a-z0-9]+'), w -> w <> '')"
_PAIRS = "zip_with(slice({0}, 1, greatest(size({0}) - 1, 0)), slice({0}, 2, greatest(size({0}) - 1, 0)), (a, b) -> concat(a, ' ', b))"


def _array(items: list[str]) -> str:
    return "array(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per matching unit: key, level (line, paragraph, text), unit (number from 0), license_id, dice, body.

    The best template of a unit counts; of equal ones the first by name.  Null, empty and
    wordless texts have no unit; repeated rows give repeated results.
    """
    sets = {name: bigrams(body) for name, body in sorted(templates.items()) if bigrams(body)}
    t = Fraction(str(threshold))
    least = lambda n: math.ceil(n * t / (2 - t))  # noqa: E731  sizes that can reach the threshold with n bigrams
    most = lambda n: math.floor(n * (2 - t) / t)
    lines = F.split("t", "\n")
    paragraphs = F.split("t", r"\n[ \t]*\n")
    units = F.expr(
        "concat(transform(lines, (x, i) -> named_struct('level', 'line', 'unit', i, 'body', x)), "
        "filter(transform(paragraphs, (x, i) -> named_struct('level', 'paragraph', 'unit', i, 'body', x)), p -> size(paragraphs) > 1 AND instr(trim('\\n', p.body), '\\n') > 0), "
        "CASE WHEN size(lines) > 1 THEN array(named_struct('level', 'text', 'unit', 0, 'body', t)) ELSE array() END)"
    )
    low = min(least(len(s)) for s in sets.values())
    high = max(most(len(s)) for s in sets.values())
    first = sorted({b for s in sets.values() for b in s[: len(s) - math.ceil(t / 2 * (len(s) + least(len(s)))) + 1]})
    once = lambda name, expr: F.explode(F.array(F.expr(expr))).alias(name)  # noqa: E731  a filter isn't pushed below a generator, so it is computed once
    scored = (
        docs.select(F.col(key).alias("name"), F.col(text).alias("t")).filter("t IS NOT NULL")
        .select("name", "t", lines.alias("lines"), paragraphs.alias("paragraphs"))
        .select("name", F.explode(units).alias("u"))
        .select("name", "u", once("words", "filter(split(lower(u.body), '[^a-z0-9]+'), w -> w <> '')"))
        # a unit with repeated bigrams may have many more words, so only the lower bound holds for words
        .filter(F.size("words") > low)
        .select("name", "u", once("grams", "array_distinct(zip_with(slice(words, 1, size(words) - 1), slice(words, 2, size(words) - 1), (a, b) -> concat(a, ' ', b)))"))
        .filter(F.size("grams").between(low, high))
        .filter(F.expr(f"exists(grams, g -> g IN ({_array(first)[6:-1]}))"))
        .select("name", "u.level", "u.unit", "u.body", "grams")
    )
    tests = []
    for name, s in sets.items():
        n = len(s)
        tests.append(
            f"CASE WHEN size(grams) BETWEEN {least(n)} AND {most(n)} THEN named_struct('dice', "
            f"CAST(2 * size(array_intersect(grams, {_array(s)})) AS DOUBLE) / (size(grams) + {n}), 'license_id', '{name}') END"
        )
    best = f"array_sort(filter(array({', '.join(tests)}), x -> x.dice >= {threshold}D), (a, b) -> CASE WHEN a.dice > b.dice THEN -1 WHEN a.dice < b.dice THEN 1 WHEN a.license_id < b.license_id THEN -1 ELSE 1 END)"
    return (
        scored.select("name", "level", "unit", "body", once("best", f"try_element_at({best}, 1)"))
        .filter("best IS NOT NULL")
        .select(F.col("name").alias(key), "level", "unit", "best.license_id", "best.dice", "body")
    )


def windows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per notice that lies in no matching unit of ``scan``, in its columns: level is ``window``, unit the number of its first word, body its words.

    A window starts at one of the first bigrams of a template and ends at one of its bigrams; of those that overlap the best counts
    (then the longer, then the first by name).
    """
    sets = {name: bigrams(body) for name, body in sorted(templates.items()) if bigrams(body)}
    t = Fraction(str(threshold))
    tests, firsts, longest, most = [], set(), 0, 0
    for name, s in sets.items():
        n, low, high = len(s), math.ceil(len(s) * t / (2 - t)), math.floor(len(s) * (2 - t) / t)
        words = [w for w in re.split("[^a-z0-9]+", templates[name].lower()) if w]
        length = math.floor((len(words) - 1) * (2 - t) / t)  # in bigrams; a template may repeat some
        needed = math.ceil(t / 2 * (n + low))
        first, all_ = s[: n - needed + 1], _array(s)
        firsts, longest, most = firsts | set(first), max(longest, length), max(most, high)
        part = "slice(x.w, 1, k)"
        # only ends at a bigram of the template: what follows the last one lowers the coefficient
        tests.append(
            f"CASE WHEN x.w[0] IN ({_array(first)[6:-1]}) AND size(array_intersect(slice(x.w, 1, {length}), {all_})) >= {needed} THEN "
            f"array_max(transform(filter(sequence({low}, least({length}, size(x.w))), k -> k >= {low} AND x.w[k - 1] IN ({all_[6:-1]}) AND size(array_distinct({part})) BETWEEN {low} AND {high}), "
            f"k -> named_struct('dice', CAST(2 * size(array_intersect({part}, {all_})) AS DOUBLE) / (size(array_distinct({part})) + {n}), 'size', k, 'license_id', '{name}'))) END"
        )
    order = "(a, b) -> CASE WHEN a.dice > b.dice THEN -1 WHEN a.dice < b.dice THEN 1 WHEN a.size > b.size THEN -1 WHEN a.size < b.size THEN 1 WHEN a.license_id < b.license_id THEN -1 ELSE 1 END"
    best = f"try_element_at(array_sort(filter(array({', '.join(tests)}), c -> c.dice >= {threshold}D), {order}), 1)"
    once = lambda name, expr: F.explode(F.array(F.expr(expr))).alias(name)
    place = "STRUCT<start: INT, stop: INT, dice: DOUBLE, license_id: STRING>"
    # in the order of their starts: one that overlaps the last kept takes its place if it is better
    sweep = (
        f"aggregate(places, CAST(array() AS ARRAY<{place}>), (kept, p) -> CASE WHEN size(kept) = 0 OR element_at(kept, -1).stop < p.start THEN concat(kept, array(p)) "
        "WHEN p.dice > element_at(kept, -1).dice THEN concat(slice(kept, 1, size(kept) - 1), array(p)) ELSE kept END)"
    )
    numbers = lambda parts: f"flatten(transform({parts}, (x, i) -> array_repeat(i, size({_SPLIT.format('x')}))))"  # noqa: E731  the part of each word
    found = (
        docs.select(F.col(key).alias("name"), F.col(text).alias("t")).filter("t IS NOT NULL")
        .select("name", "t", once("words", _SPLIT.format("t")))
        .filter(F.size("words") > 1)
        .select("name", "t", "words", once("grams", _PAIRS.format("words")))
        .filter(F.expr(f"exists(grams, g -> g IN ({_array(sorted(firsts))[6:-1]}))"))
        .select("name", "t", "words", once("starts", f"filter(transform(grams, (g, i) -> CASE WHEN g IN ({_array(sorted(firsts))[6:-1]}) THEN named_struct('at', i, 'w', slice(grams, i + 1, {longest})) END), x -> x IS NOT NULL)"))
        .select("name", "t", "words", once("places", f"filter(transform(transform(starts, x -> named_struct('at', x.at, 'b', {best})), x -> CASE WHEN x.b IS NOT NULL THEN CAST(named_struct('start', x.at, 'stop', x.at + x.b.size, 'dice', x.b.dice, 'license_id', x.b.license_id) AS {place}) END), x -> x IS NOT NULL)"))
        .filter(F.size("places") > 0)
        .select("name", "words", F.expr(numbers("split(t, '\n')")).alias("line"), F.expr(numbers(r"split(t, '\n[ \t]*\n')")).alias("paragraph"), F.explode(F.expr(sweep)).alias("p"))
    )
    # the units around the window: a match of one of them is reported by scan
    around = lambda c: f"CASE WHEN {c}[p.start] = {c}[p.stop] THEN slice(words, array_position({c}, {c}[p.start]), size(filter({c}, x -> x = {c}[p.start]))) END"
    held = found.select("name", "words", "p", once("units", f"filter(array({around('line')}, {around('paragraph')}, words), u -> u IS NOT NULL)"))
    held = held.select("name", "words", "p", once("bags", f"filter(transform(units, u -> array_distinct({_PAIRS.format('u')})), g -> size(g) <= {most})"))
    matches = " OR ".join(f"2 * size(array_intersect(g, {_array(s)})) >= {threshold}D * (size(g) + {len(s)})" for s in sets.values())
    return held.filter(f"NOT exists(bags, g -> {matches})").select(
        F.col("name").alias(key), F.lit("window").alias("level"), F.col("p.start").alias("unit"), "p.license_id", "p.dice",
        F.expr("array_join(slice(words, p.start + 1, p.stop - p.start + 1), ' ')").alias("body"),
    )


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for ``scan`` over ``documents`` (columns without the body): every unit against every template."""
    rows = ", ".join("('{}', '{}')".format(n, b.replace("'", "''")) for n, b in sorted(templates.items()))
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    words = "list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
WITH template AS (SELECT license_id, {grams} AS tg FROM (SELECT license_id, {words} AS w FROM (VALUES {rows}) AS v(license_id, body))),
line AS (SELECT doc_id, 'line' AS level, unnest(range(len(x))) AS unit, unnest(x) AS body, NULL AS n
         FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
para AS (SELECT doc_id, 'paragraph' AS level, unnest(range(len(x))) AS unit, unnest(x) AS body, len(x) AS n
         FROM (SELECT doc_id, regexp_split_to_array(text, '\\n[ \\t]*\\n') AS x FROM documents WHERE text IS NOT NULL)),
unit AS (SELECT doc_id, level, unit, body FROM line
         UNION ALL SELECT doc_id, level, unit, body FROM para WHERE n > 1 AND contains(trim(body, chr(10)), chr(10))
         UNION ALL SELECT doc_id, 'text', 0, text FROM documents WHERE contains(text, chr(10))),
gram AS (SELECT doc_id, level, unit, {grams} AS g FROM (SELECT doc_id, level, unit, {words} AS w FROM unit) WHERE len(w) > 1),
score AS (SELECT doc_id, level, unit, license_id, CAST(2 * len(list_intersect(g, tg)) AS DOUBLE) / (len(g) + len(tg)) AS dice
          FROM gram, template WHERE len(g) <= 3 * len(tg) AND len(tg) <= 3 * len(g))
SELECT doc_id, level, CAST(unit AS INTEGER) AS unit, license_id, dice FROM score WHERE dice >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, level, unit ORDER BY dice DESC, license_id) = 1
"""
