"""Licence scan: cosine of notices to templates, then inheritance down the folders.

A text is one run of words, so line breaks and comment marks do not count. Windows as long
as each template overlap by at least seven eighths; a window and a template are compared by the
cosine of their sparse TF-IDF vectors. Templates are notices, titles, SPDX tags and the
whole texts in ``licence_texts``. The inverse
document frequencies come from the templates, so a score does not change with the corpus.
Before windows are cut, a bound rules out templates without loss: a cosine is at most the length of
the template's unit vector on the words that the text has. For the same reason a notice's windows are
cut only around its heavy words, without which the bound is missed. It is a projection without a shuffle.
A file without a notice takes the licence of the licence file in its nearest folder
upwards. Only distinct folders are expanded to their ancestors, and joins
carry narrow rows. Everything is DataFrame functions.

Cases: null or empty text has no notice of its own. A null path has no folder
and inherits nothing. Several licence files in a folder: the highest score, then the
smallest path. A whole text goes before a notice, and any licence before rights reserved, which many licences
open with; then the score decides. Equal scores of templates: the first listed. Repeated rows are judged each.
Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from math import log, sqrt
from pathlib import Path
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlift.llm.common import staged, text_or_empty

PROPRIETARY = "proprietary"

#: Licence and a notice or title to compare with.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    (PROPRIETARY, "All rights reserved."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
)

#: SPDX identifiers beside the licences' own names.
SPDX = {
    "GPL-2.0": ("GPL-2.0-only", "GPL-2.0-or-later"), "GPL-3.0": ("GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL-2.1": ("LGPL-2.1-only", "LGPL-2.1-or-later"), "LGPL-3.0": ("LGPL-3.0-only", "LGPL-3.0-or-later"),
    "AGPL-3.0": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "MIT": (), "Apache-2.0": (), "BSD-2-Clause": (), "BSD-3-Clause": (),
    "MPL-2.0": (), "ISC": (), "Unlicense": (), "CC0-1.0": (), "CC-BY-4.0": (), "CC-BY-SA-4.0": (), "CC-BY-NC-4.0": (),
}

TEXTS = Path(__file__).with_name("licence_texts")
TRIGGER = r"(?i)licen[sc]e|copyright|rights reserved|public domain|redistribut|permission is hereby|spdx|free software"
WORD = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([-._].*)?$"
#: Templates of more words are whole texts.
NOTICE_WORDS = 100
STEPS = 8
LEAST_COSINE = 0.7


@cache
def default_templates() -> tuple[tuple[str, str], ...]:
    """Notices and titles, SPDX tags, whole texts; read on the driver."""
    tags = tuple((name, f"SPDX-License-Identifier: {x}") for name, others in SPDX.items() for x in (name, *others))
    return NOTICES + tags + tuple((p.stem, p.read_text()) for p in sorted(TEXTS.glob("*.txt")))


def literal_array(values: list, kind: str = "double") -> str:
    """SQL of a constant array from one literal, folded once when planned."""
    return f"cast(split('{' '.join(map(str, values))}', ' ') as array<{kind}>)"


def by_value(x: str, values: dict[int, float]) -> str:
    """SQL of the value of one of few numbers, else 0."""
    sets: dict[float, list[int]] = {}
    for number, value in values.items():
        sets.setdefault(float(value), []).append(number)
    return "CASE " + " ".join(f"WHEN {x} IN ({', '.join(map(str, ks))}) THEN {v!r}D" for v, ks in sets.items()) + " ELSE 0D END"


def numbered(vocabulary: list[str]) -> tuple[dict[str, int], int, list[int]]:
    """A number per word without collisions, the number of unknown words, and the shift of each bucket of words."""
    n, size = len(vocabulary) // 4 + 1, 2 * len(vocabulary) + 1
    buckets: dict[int, list[str]] = {}
    for word in vocabulary:
        buckets.setdefault(crc32(word.encode()) % n, []).append(word)
    taken: dict[int, str] = {}
    shifts = [0] * n
    for k, held in sorted(buckets.items(), key=lambda b: (-len(b[1]), b[0])):
        for shift in range(100_000):
            places = {crc32(f"{w} {shift}".encode()) % size: w for w in held}
            if len(places) == len(held) and not places.keys() & taken.keys():
                break
        else:
            raise ValueError("no free places")
        taken |= places
        shifts[k] = shift
    return {w: k for k, w in taken.items()}, size, shifts


#: Sum of (count * idf)^2 over the distinct words of the window ``w``: equal words follow each other once sorted.
SQUARED_LENGTH = """aggregate(sort_array(w), named_struct('w', '', 'n', 0D, 'sum', 0D), (a, t) -> named_struct(
    'w', t.w, 'n', if(a.w = t.w, a.n, 0D) + 1, 'sum', a.sum + (2 * if(a.w = t.w, a.n, 0D) + 1) * t.idf2), a -> a.sum)"""


def heavy(unit: dict[str, float]) -> list[str]:
    """Words without which a vector's length on the others is too small for the least cosine."""
    out, left = [], 1.0
    for word, value in sorted(unit.items(), key=lambda u: (-u[1], u[0])):
        if left < LEAST_COSINE**2 - 1e-9:
            break
        out.append(word)
        left -= value**2
    return out


def best_template(words: str, templates: tuple[tuple[str, str], ...]) -> Column:
    """Struct (rank, score, order, license) of the closest template, null if none is close.

    One SQL text, since thousands of Column calls would take longer than the scan.
    """
    counts = [Counter(re.findall(WORD, text.lower())) for _, text in templates]
    n = len(counts)
    df = Counter(w for c in counts for w in c)
    idf = {w: log((1 + n) / (1 + k)) + 1 for w, k in df.items()}
    number, unknown, shifts = numbered(sorted(df))

    def dense(values: dict[str, float], other: float = 0.0) -> str:
        out = [other] * (unknown + 1)
        for w, v in values.items():
            out[number[w]] = v
        return literal_array(out)

    def score(order: int) -> str:
        name, count = templates[order][0], counts[order]
        long = sum(count.values())
        size = sqrt(sum((k * idf[w]) ** 2 for w, k in count.items()))
        unit = {w: k * idf[w] / size for w, k in count.items()}
        whole, step = long > NOTICE_WORDS, max(1, long // STEPS)
        last = f"greatest(0, size(r.v) - {long})"

        def looked_up(x: str, values: dict[str, float]) -> str:
            return f"get({dense(values)}, {x})" if whole else by_value(x, {number[w]: v for w, v in values.items()})

        bound = f"aggregate(r.distinct, 0D, (a, x) -> a + {looked_up('x', {w: u * u for w, u in unit.items()})})"
        if whole:
            starts = f"concat(sequence(0, {last}, {step}), array({last}))"
        else:
            # Around every heavy word the windows that hold it, a step apart.
            ids = ", ".join(str(number[w]) for w in heavy(unit))
            starts = f"""flatten(transform(filter(r.known, t -> t.id IN ({ids})), t -> transform(
                sequence(t.k - {long - 1}, t.k, {step}), j -> least(greatest(j, 0), {last}))))"""
        dot = f"aggregate(w, 0D, (a, t) -> a + t.idf2 * {looked_up('t.id', count)})"
        top = f"array_max(transform(transform(array_distinct({starts}), j -> slice(r.v, j + 1, {long})), w -> {dot} / {size!r}D / sqrt({SQUARED_LENGTH})))"
        rank = 0 if name == PROPRIETARY else 2 if whole else 1
        return f"""if({bound} >= {LEAST_COSINE**2 - 1e-6!r}D, element_at(transform(array({top}), c -> if(c >= {LEAST_COSINE}D,
            named_struct('rank', {rank}, 'score', round(c, 9), 'order', {-order}, 'license', '{name}'), null)), 1), null)"""

    places = [""] * unknown
    for w, k in number.items():
        places[k] = w
    squares = dense({w: x * x for w, x in idf.items()}, (log(1 + n) + 1) ** 2)
    place = f"cast(crc32(concat(w, ' ', get({literal_array(shifts, 'string')}, cast(crc32(w) % {len(shifts)} as int)))) % {unknown} as int)"
    identified = f"transform({words}, w -> transform(array({place}), k -> named_struct('w', w, 'id', if(get({literal_array(places, 'string')}, k) = w, k, {unknown})))[0])"
    read = f"""transform(array({identified}), v -> named_struct(
        'v', transform(v, t -> named_struct('w', t.w, 'id', t.id, 'idf2', get({squares}, t.id))),
        'known', filter(transform(v, (t, k) -> named_struct('id', t.id, 'k', k)), t -> t.id < {unknown}),
        'distinct', filter(array_distinct(transform(v, t -> t.id)), x -> x < {unknown})))"""
    return F.expr(f"transform({read}, r -> array_max(array({', '.join(map(score, range(n)))})))[0]")


def own_licenses(df: DataFrame, id_col: str, path_col: str, text_col: str, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(id, path, folder, is_licence_file, license, score) with the notice of the file itself."""
    best = F.when(F.col("words").isNotNull(), best_template("words", templates))
    rows = df.select(df[id_col].alias("id"), df[path_col].cast("string").alias("path"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("words", F.when(F.rlike("text", F.lit(TRIGGER)), F.regexp_extract_all(F.lower("text"), F.lit(WORD), 0)))
    slash = F.length("path") - F.length(F.regexp_extract("path", "[^/]*$", 0))
    return rows.select("id", "path", best.alias("best")).select(
        "id", "path",
        F.regexp_replace(F.substr("path", F.lit(1), slash), "/$", "").alias("folder"),
        F.coalesce(F.rlike(F.regexp_extract("path", "[^/]*$", 0), F.lit(LICENCE_FILE)), F.lit(False)).alias("is_licence_file"),
        F.col("best.license").alias("license"), F.col("best.score").alias("score"),
    )


def nearest_licenses(files: DataFrame) -> DataFrame:
    """(folder, inherited, from_path): for each folder the licence file of its nearest ancestor, itself first."""
    at_folder = files.where(F.col("is_licence_file") & F.col("license").isNotNull()).groupBy("folder").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("first")
    )
    parts = F.split("folder", "/", -1)
    ancestors = files.where(F.col("license").isNull()).select("folder").where(F.col("folder").isNotNull()).distinct().select(
        "folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(
            k.alias("depth"), F.concat_ws("/", F.slice(parts, F.lit(1), k)).alias("name")))).alias("up")
    )
    found = ancestors.join(at_folder.withColumnRenamed("folder", "_at"), F.col("up.name") == F.col("_at"))
    return found.groupBy("folder").agg(F.max_by("first", "up.depth").alias("first")).select(
        "folder", F.col("first.license").alias("inherited"), F.col("first.path").alias("from_path")
    )


def license_scan(df: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
                 templates: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """(id, path, license, score, origin, license_path) for every row; origin is notice, inherited or null."""
    files = staged(own_licenses(df, id_col, path_col, text_col, templates or default_templates()), "licenses")
    joined = files.join(nearest_licenses(files), "folder", "left")
    own = F.col("license").isNotNull()
    inherits = ~own & F.col("inherited").isNotNull()
    return joined.select(
        F.col("id").alias(id_col), "path", F.coalesce("license", "inherited").alias("license"), "score",
        F.when(own, "notice").when(inherits, "inherited").alias("origin"),
        F.when(own, F.col("path")).when(inherits, F.col("from_path")).alias("license_path"),
    )
