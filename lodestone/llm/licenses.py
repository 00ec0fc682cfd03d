"""Licence notices in texts: Dice coefficient over word bigrams, with DataFrame functions only.

A text's units, its lines and its paragraphs, are compared to templates by the sets
of their word bigrams; then runs of two lines or more, for notices wrapped over lines, where they
touch no line or paragraph that matches, and no longer than a match can be. Of runs that overlap the best counts. A Dice coefficient of at least t bounds the sizes, n / m within
t / (2-t) and its inverse, so only templates of such a size are looked at; and it asks for so many
shared bigrams that a match holds one of a template's anchor words, so units without any are passed over.

Defined results: a null or empty text, or one without a matching unit, has no licence; of
equally good matches the first template in order wins, then the first unit; the unit of a
run is its first line; a notice inside a longer line isn't one; a unit of fewer than two words has
no bigrams and matches nothing; repeated rows are scanned one by one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

LEAST = 0.7

# Notices as their licences word them.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    """Runs of ASCII letters and digits, A-Z folded."""
    folded = "".join(c if c in _LOWER or c.isascii() and c.isdigit() else " " for c in text.translate(str.maketrans(_UPPER, _LOWER)))
    return folded.split()


def bigrams_of(text: str) -> list[str]:
    ws = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(ws, ws[1:])})


def anchors(templates: dict[str, str], least: float) -> list[str]:
    """Words and bigrams of which every unit that matches any template has one.

    A match shares t / (2-t) of a template's bigrams or more; a template's anchors leave fewer than that
    uncovered. Long words come first, those of many templates before others; then bigrams.
    """
    chosen: list[str] = []
    bigrams = {k: bigrams_of(v) for k, v in templates.items()}
    spread: dict[str, int] = {}
    for bs in bigrams.values():
        for w in {w for b in bs for w in b.split()}:
            spread[w] = spread.get(w, 0) + 1
    for bs in bigrams.values():
        need = math.ceil(least / (2 - least) * len(bs) - 1e-9)
        bare = [b for b in bs if not any(c == b or c in b.split() for c in chosen)]
        while bare and len(bare) >= need:
            words = sorted((-spread[w], w) for w in {w for b in bare for w in b.split()} if len(w) >= 6)
            chosen.append(words[0][1] if words else bare[0])
            bare = [b for b in bare if not (chosen[-1] == b or chosen[-1] in b.split())]
    return chosen


def _matches(unit: Column, at: Column, templates: dict[str, str], least: float) -> Column:
    """Structs of the templates that a unit's bigrams match."""
    ws = F.filter(F.split(unit, " "), lambda w: w != "")
    rest = F.greatest(F.size(ws) - 1, F.lit(0))
    pairs = F.array_distinct(F.zip_with(F.slice(ws, 1, rest), F.slice(ws, 2, rest), lambda a, b: F.concat_ws(" ", a, b)))
    held = F.array(*[F.struct(F.lit(-k).alias("place"), F.lit(name).alias("name"), F.array(*map(F.lit, bigrams_of(text))).alias("bigrams")) for k, (name, text) in enumerate(templates.items())])

    def fits(t: Column, own: Column) -> Column:
        n, m = F.size(own), F.size(t["bigrams"])
        return (n > 0) & (n * (2 - least) >= m * least) & (m * (2 - least) >= n * least)

    def found(own: Column) -> Column:
        sized = F.filter(held, lambda t: fits(t, own))
        scored = F.transform(sized, lambda t: F.struct((2.0 * F.size(F.array_intersect(own, t["bigrams"])) / (F.size(own) + F.size(t["bigrams"]))).alias("dice"), t["place"].alias("place"), (-at).alias("at"), t["name"].alias("name")))
        return F.filter(scored, lambda s: s["dice"] >= least)

    # A one-element transform computes the bigrams once.
    return F.flatten(F.transform(F.array(pairs), found))


def _runs(text: Column, matched: Column, anchored, templates: dict[str, str], least: float) -> Column:
    """The best matches (dice, place, at, name) of runs of lines outside of the units ``matched``, none overlapping another.

    A run has as many words as the largest template's match at most.
    """
    most = int(max(len(bigrams_of(v)) for v in templates.values()) * (2 - least) / least + 1e-9) + 1
    bar = lambda u: F.array_contains(matched, u)
    parts = F.transform(F.split(text, "\n ?\n"), lambda p: F.when(bar(F.regexp_replace(p, "[ \n]+", " ")), F.regexp_replace(p, "[^\n]+", "|")).otherwise(p))
    lines = F.transform(F.split(F.array_join(parts, "\n\n"), "\n"), lambda x: F.when(bar(x), F.lit("|")).otherwise(x))
    numbered = F.flatten(F.transform(lines, lambda x, i: F.transform(F.filter(F.split(x, " "), lambda w: w != ""), lambda w, k: F.struct(w.alias("w"), i.alias("i"), (k == 0).alias("first")))))

    def of(held: Column) -> Column:
        starts = F.filter(F.transform(held, lambda s, p: F.when(s["first"], p)), lambda p: p.isNotNull())
        return let(F.struct(F.transform(held, lambda s: s["w"]).alias("ws"), F.concat(starts, F.array(F.size(held))).alias("starts"), held.alias("held")), found)

    def found(own: Column) -> Column:
        ws, starts = own["ws"], own["starts"]
        words = lambda p, n: F.array_join(F.slice(ws, p + 1, n), " ")
        near = F.filter(F.transform(starts, lambda p, k: F.struct(p.alias("p"), k.alias("k"))), lambda s: anchored(words(s["p"], F.lit(most))))

        def grown(s: Column) -> Column:
            ends = F.filter(F.slice(starts, s["k"] + 3, most), lambda q: q - s["p"] <= most)
            texts = F.filter(F.transform(ends, lambda q: F.struct(q.alias("q"), words(s["p"], q - s["p"]).alias("u"))), lambda r: ~F.contains(r["u"], F.lit("|")) & anchored(r["u"]))
            line = F.get(own["held"], s["p"])["i"]
            best = F.transform(texts, lambda r: F.struct(F.array_max(_matches(r["u"], line, templates, least)).alias("m"), (-s["p"]).alias("p"), (-r["q"]).alias("q")))
            return F.filter(best, lambda r: r["m"].isNotNull())

        return F.flatten(F.transform(near, grown))

    def apart(runs: Column) -> Column:
        kind = f"array<struct<m:{_MATCH},p:int,q:int>>"
        first = F.reverse(F.array_sort(runs))
        taken = F.aggregate(first, F.array().cast(kind), lambda got, r: F.when(F.exists(got, lambda g: (g["p"] > r["q"]) & (r["p"] > g["q"])), got).otherwise(F.concat(got, F.array(r).cast(kind))).cast(kind))
        return F.transform(taken, lambda r: r["m"])

    return apart(let(numbered, of))


_MATCH = "struct<dice:double,place:int,at:int,name:string>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """(id, license, dice, unit, n_matches) of every row: its best licence, the unit it stands in, and how many units match."""
    templates = TEMPLATES if templates is None else templates
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    folded = F.regexp_replace(low, "[^a-z0-9\n]+", " ")
    words = anchors(templates, least)

    def anchored(text: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(text, F.lit(w))
        return out

    # Most texts hold no anchor at all and are passed over after one replacement.
    maybe = anchored(F.regexp_replace(low, "[^a-z0-9]+", " "))
    rows = docs.select(F.col(id_col).alias("id"), F.when(maybe, folded).alias("t"))
    lines, paragraphs = F.split("t", "\n"), F.split("t", "\n ?\n")
    units = F.when(F.size(paragraphs) > 1, F.concat(lines, F.transform(F.filter(paragraphs, lambda p: F.contains(p, F.lit("\n"))), lambda p: F.regexp_replace(p, "[ \n]+", " ")))).otherwise(lines)
    numbered = F.filter(F.transform(units, lambda u, i: F.struct(u.alias("u"), i.alias("i"))), lambda s: anchored(s["u"]))
    per_unit = F.filter(F.transform(numbered, lambda s: F.struct(_matches(s["u"], s["i"], templates, least).alias("m"), s["u"].alias("u"))), lambda s: F.size(s["m"]) > 0)
    rows = rows.select("id", "t", F.when(F.col("t").isNotNull(), per_unit).alias("s"))
    wrapped = F.transform(_runs(F.col("t"), F.transform("s", lambda s: s["u"]), anchored, templates, least), lambda m: F.array(m))
    rows = rows.select("id", F.when(F.col("t").isNotNull(), F.concat(F.transform("s", lambda s: s["m"]), wrapped)).alias("m"))
    best = F.array_max(F.flatten("m"))
    rows = rows.select("id", best.alias("b"), F.coalesce(F.size("m"), F.lit(0)).alias("n"))
    return rows.select("id", F.col("b.name").alias("license"), F.col("b.dice").alias("dice"), (-F.col("b.at")).cast("long").alias("unit"), F.greatest("n", F.lit(0)).cast("long").alias("n_matches"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).withColumnRenamed("id", "doc_id")


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ORACLE = f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{name}', {_sql_list(bigrams_of(text))})" for k, (name, text) in enumerate(TEMPLATES.items()))}) AS v(place, name, bg)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^a-z0-9\\n]+', ' ', 'g') AS x FROM documents),
u AS (SELECT rid, unnest(list_concat(string_split(x, chr(10)), list_filter(string_split_regex(x, '\\n ?\\n'), lambda p: contains(p, chr(10)) AND p <> x))) AS s, generate_subscripts(list_concat(string_split(x, chr(10)), list_filter(string_split_regex(x, '\\n ?\\n'), lambda p: contains(p, chr(10)) AND p <> x)), 1) - 1 AS i FROM d),
w AS (SELECT rid, i, regexp_extract_all(s, '[a-z0-9]+') AS ws FROM u),
b AS (SELECT rid, i, list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1])) AS bs FROM w WHERE len(ws) >= 2),
m AS (SELECT rid, i, place, name, 2.0::DOUBLE * len(list_intersect(bs, bg)) / (len(bs) + len(bg)) AS dice FROM b, t WHERE len(bs) * {2 - LEAST} >= len(bg) * {LEAST} AND len(bg) * {2 - LEAST} >= len(bs) * {LEAST}),
g AS (SELECT * FROM m WHERE dice >= {LEAST}),
f AS (SELECT rid, name, dice, i, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, place, i) AS r FROM g),
n AS (SELECT rid, count(DISTINCT i) AS n FROM g GROUP BY rid)
SELECT doc_id, f.name AS license, f.dice AS dice, CAST(f.i AS BIGINT) AS unit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_matches
FROM d LEFT JOIN f ON d.rid = f.rid AND f.r = 1 LEFT JOIN n ON d.rid = n.rid
"""
