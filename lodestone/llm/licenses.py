"""Licence scans: lines and paragraphs against licence templates, by the Dice coefficient over distinct word bigrams.

A unit is a line of the text, or a paragraph of several lines between blank lines. Units and templates are normalised to
lower-case words of letters and digits. 2|A∩B| / (|A|+|B|) >= t needs t/(2-t) <= |A|/|B| <= (2-t)/t: units outside every
template's bounds are dropped by their word count before bigrams are made, and a unit meets only templates within bounds.
A unit of n words has at most n-1 distinct bigrams, and fewer only if bigrams repeat; so the lower bound is asked of the
word count, and both are asked of the distinct bigrams.

Everything happens within a row: no shuffle, no explosion, nothing to skew. Defined results: an empty table gives no rows; a
null or empty text has no units; texts of any length are scanned whole; of equally good licences the first name is the best;
one row is returned per row, repeated ids too; only id and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

THRESHOLD = 0.8
#: Notices as the licences' publishers word them, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
)


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, as the columns below make them."""
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(words, 2, F.size(words)), lambda w, i: F.concat_ws(" ", F.get(words, i), w)))


def units(text: Column) -> Column:
    """Normalised lines and paragraphs of several lines; a line without a letter or digit is a blank line."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n")
    kept = F.regexp_replace(kept, r"[^\p{L}\p{N}\n]+", " ")
    lines = F.split(kept, "\n")
    several = F.transform(F.filter(F.split(kept, r"\n\s*\n"), lambda b: F.instr(F.trim(b), "\n") > 0), lambda b: F.translate(b, "\n", " "))
    return F.concat(lines, several)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """Per row: id, n_units that match a licence, their licences sorted and comma-joined, the best one and its coefficient.

    The best is the largest coefficient, ties to the smaller name; null where nothing matches."""
    known = [(name, bigrams_of(text)) for name, text in templates]
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    literal = F.expr("array(" + ",".join(f"named_struct('name', {quoted(n)}, 'size', {len(b)}, 'grams', array({','.join(map(quoted, b))}))" for n, b in known) + ")")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least = min(len(b) for _, b in known) * low
    most = max(len(b) for _, b in known) * high
    split = F.transform(units(F.col("text")), lambda u: F.filter(F.split(u, " +"), lambda w: w != ""))
    # repeated bigrams only lower the count, so an upper bound of words would lose units; long ones are few words away
    enough = F.filter(split, lambda w: F.size(w) - 1 >= least)
    grams = F.filter(F.transform(enough, bigrams), lambda g: F.size(g) <= most)

    def best(g):
        near = F.filter(literal, lambda t: (F.size(g) >= t["size"] * low) & (F.size(g) <= t["size"] * high))
        rated = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["size"])).alias("rate"), t["name"].alias("name")))
        return F.array_min(rated)  # the largest coefficient, then the smaller name

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", F.filter(F.transform(grams, best), lambda x: x.isNotNull() & (x["rate"] <= -threshold)).alias("found"))
    top = F.array_min("found")
    return rows.select(
        "doc_id",
        F.size("found").cast("long").alias("n_units"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("found", lambda x: x["name"])))).alias("licenses"),
        top["name"].alias("best_license"),
        F.round(-top["rate"], 6).alias("best_score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def _sql() -> str:
    known = [(name, bigrams_of(text)) for name, text in TEMPLATES]
    values = ",\n    ".join(f"('{n}', {i}, [{', '.join(repr(g) for g in b)}])" for i, (n, b) in enumerate(known))
    return f"""
WITH templates(name, tid, grams) AS (VALUES
    {values}),
base AS (SELECT doc_id, row_number() OVER () AS rid, regexp_replace(regexp_replace(lower(coalesce(text, '')), '\\r\\n?', chr(10), 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS kept FROM documents),
cut AS (
    SELECT rid, unnest(string_split(kept, chr(10))) AS u FROM base
    UNION ALL
    SELECT rid, replace(b, chr(10), ' ') AS u FROM (SELECT rid, unnest(string_split_regex(kept, '\\n\\s*\\n')) AS b FROM base) WHERE contains(trim(b), chr(10))),
unit AS (SELECT row_number() OVER () AS uid, rid, list_filter(string_split(u, ' '), lambda w: w <> '') AS w FROM cut),
gram AS (SELECT uid, rid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM unit WHERE len(w) >= 2),
rated AS (
    SELECT uid, rid, name, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS rate
    FROM gram JOIN templates ON len(g) >= len(grams) * {THRESHOLD / (2 - THRESHOLD)!r}::DOUBLE AND len(g) <= len(grams) * {(2 - THRESHOLD) / THRESHOLD!r}::DOUBLE),
best AS (SELECT uid, rid, rate, name, row_number() OVER (PARTITION BY uid ORDER BY rate DESC, name) AS k FROM rated),
found AS (SELECT * FROM best WHERE k = 1 AND rate >= {THRESHOLD}::DOUBLE),
total AS (SELECT rid, count(*) AS n_units, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(rate) AS top FROM found GROUP BY rid),
named AS (SELECT found.rid, min(name) AS best_license FROM found JOIN total ON found.rid = total.rid AND rate = top GROUP BY found.rid)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(licenses, '') AS licenses, best_license, round(top, 6) AS best_score
FROM base LEFT JOIN total USING (rid) LEFT JOIN named USING (rid)"""


ORACLE_SQL = _sql()
