"""Licence scan by the Dice coefficient over word bigrams, in DataFrame expressions only.

Units of a text are its lines, its paragraphs (parted by blank lines) and the whole text, so a notice is found inside other
text and a licence that fills a file is found as such.  A unit is lower-cased and cut into words of letters and digits.
2|A and B| / (|A|+|B|) >= t needs |B| t/(2-t) <= |A| <= |B| (2-t)/t, and a common bigram: these bounds pick the templates
that a unit is compared with.

Any other run of words is a unit too: a window.  The best window of a template begins and ends at bigrams of the template,
and the windows from one start are the prefixes of the distinct bigrams from there on, so all windows of any length are
compared, in texts that have at least |B| t/(2-t) of the template's bigrams.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Public licence notices and short licence texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved."),
]


def _bigrams(df: DataFrame, text: str, distinct: bool = True) -> DataFrame:
    """``df`` with ``bg``: the (distinct) word-bigram hashes of column ``text`` (array<long>, empty for under two words)."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    df = df.withColumn("_w", words)
    pairs = F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.xxhash64(F.get(F.col("_w"), i - 1), F.get(F.col("_w"), i)))
    return df.withColumn("bg", F.when(F.size("_w") > 1, F.array_distinct(pairs) if distinct else pairs).otherwise(F.array().cast("array<long>"))).drop("_w")


def _template_sets(spark: SparkSession, templates: list[tuple[str, str]] | None) -> list[tuple[str, list[int]]]:
    templates = TEMPLATES if templates is None else templates
    rows = _bigrams(spark.createDataFrame([(n, t) for n, t in templates], "name string, t string"), "t").select("name", "bg").collect()
    return [(r["name"], r["bg"]) for r in rows if r["bg"]]


def scan(spark: SparkSession, docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Units that match a template: ``key, unit, license, dice`` (the best template of each unit; ties: the later name)."""
    sets = _template_sets(spark, templates)
    lo = [threshold / (2 - threshold) * len(b) for _, b in sets]
    hi = [(2 - threshold) / threshold * len(b) for _, b in sets]
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").filter("text is not null")
    units = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", r"\n\s*\n"), F.array("text")))
    # a unit of fewer than two words, or of fewer words than any template allows, has no candidate
    u = keyed.select("key", F.posexplode(units).alias("unit", "u")).filter(F.length("u") >= 2)
    # explode() of one or no array is a filter that is not pushed below, where it would split the text again for each bigram
    u = _bigrams(u, "u").select("key", "unit", "bg")
    u = u.select("key", "unit", F.explode(F.when(F.size("bg").between(min(lo), max(hi)), F.array("bg"))).alias("bg"))
    known = sorted({x for _, b in sets for x in b})
    u = u.select("key", "unit", F.size("bg").alias("n"), F.filter("bg", lambda x: x.isin(known)).alias("some"))
    u = u.select("key", "unit", "n", F.explode(F.when(F.size("some") > 0, F.array("some"))).alias("near"))

    def against(i):
        name, b = sets[i]
        arr = F.expr("array(" + ",".join(f"{x}L" for x in b) + ")")
        dice = F.lit(2.0) * F.size(F.array_intersect("near", arr)) / (F.col("n") + len(b))
        return F.when(F.col("n").between(lo[i], hi[i]), F.struct(dice.alias("dice"), F.lit(name).alias("license")))

    best = F.array_max(F.filter(F.array(*[against(i) for i in range(len(sets))]), lambda x: x.isNotNull()))
    return u.select("key", "unit", best.alias("m")).filter(F.col("m.dice") >= threshold).select("key", "unit", "m.license", "m.dice")


def _longs(values) -> str:
    return "array(" + ",".join(f"{x}L" for x in values) + ")"


def _with(value, f):
    """``f`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def windows(spark: SparkSession, docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Windows that match a template and do not overlap a better one: ``key, start, end, license, dice`` (bigrams from 0).

    Better is the greater Dice, then the longer template, then the earlier start, then the later name.
    """
    sets = _template_sets(spark, templates)
    need = [math.ceil(threshold / (2 - threshold) * len(b) - 1e-9) for _, b in sets]
    most = [math.floor((2 - threshold) / threshold * len(b) + 1e-9) for _, b in sets]
    known = sorted({x for _, b in sets for x in b})
    # equal rows have equal windows
    d = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").filter(F.length("text") >= 2)
    d = _bigrams(d, "text", distinct=False).select("key", F.explode(F.array("bg")).alias("bg"))
    d = d.select("key", "bg", F.explode(F.array(F.array_distinct(F.filter("bg", lambda x: x.isin(known))))).alias("near"))
    fits = F.array(*[F.when(F.size(F.array_intersect("near", F.expr(_longs(b)))) >= need[i], F.lit(i)) for i, (_, b) in enumerate(sets)])
    d = d.select("key", "bg", F.explode(F.when(F.size("near") >= min(need), F.filter(fits, lambda i: i.isNotNull()))).alias("i"))
    of = lambda values: F.get(F.expr("array(" + ",".join(values) + ")"), F.col("i"))
    d = d.select(
        "key", "bg", of([_longs(b) for _, b in sets]).alias("b"), of([f"{n}" for n in need]).alias("need"), of([f"{n}" for n in most]).alias("most"),
        of(["'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n, _ in sets]).alias("license"),
    )

    def ahead(a):
        """The first ``most`` distinct bigrams from ``a`` on; only a text that repeats itself is read far for them."""
        part = lambda n: F.array_distinct(F.slice("bg", a + 1, n))
        near, far = part(F.col("most") * 4), part(F.col("most") * 64)
        rest = _with(far, lambda x: F.when(F.size(x) >= F.col("most"), x).otherwise(part(F.size("bg"))))
        return F.slice(_with(near, lambda x: F.when(F.size(x) >= F.col("most"), x).otherwise(rest)), F.lit(1), F.col("most"))

    def best(a):
        def of_ahead(x):
            dice = lambda y, j: F.struct((F.lit(2.0) * (j + 1) / (F.array_position(x, y) + F.size("b"))).alias("dice"), y.alias("last"))
            common = lambda c: F.when(F.size(c) >= F.col("need"), F.array_max(F.transform(c, dice)))
            return _with(F.array_intersect(x, "b"), common)

        end = lambda m: F.when(m["dice"] >= threshold, F.struct(m["dice"].alias("dice"), a.alias("start"), (a + F.array_position(F.slice("bg", a + 1, F.size("bg")), m["last"]) - 1).cast("int").alias("end")))
        return _with(_with(ahead(a), of_ahead), end)

    starts = F.filter(F.sequence(F.lit(0), F.size("bg") - 1), lambda a: F.array_contains("b", F.get("bg", a)))
    d = d.select("key", "license", F.size("b").alias("size"), F.explode(F.filter(F.transform(starts, best), lambda m: m.isNotNull())).alias("m")).select("key", "license", "size", "m.*")
    # windows that hang together by overlaps; in each such run, greedily the best ones
    order = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = F.sort_array(F.collect_set(F.struct("dice", "size", (-F.col("start")).alias("back"), "license", "start", "end")), asc=False)
    runs = d.groupBy("key", "run").agg(found.alias("found"))
    kind = "array<struct<dice:double,size:int,back:int,license:string,start:int,end:int>>"
    picked = F.aggregate(
        "found", F.array().cast(kind),
        lambda got, x: F.when(F.exists(got, lambda y: (x["start"] <= y["end"]) & (y["start"] <= x["end"])), got).otherwise(F.concat(got, F.array(x))),
    )
    return runs.select("key", F.explode(picked).alias("m")).select("key", "m.start", "m.end", "m.license", "m.dice")


def license_of(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for every row of ``docs``: ``doc_id, license, dice, n_units, licenses``.

    ``license`` and ``dice`` are the best match (ties: the later name) of lines, paragraphs, whole text and windows,
    ``n_units`` counts the matching lines, paragraphs and whole texts, or the matching windows apart from each other if
    these are more, and ``licenses`` lists the names found, sorted.  Null and empty texts and texts without a match have nulls, 0 and an empty list.
    Repeated rows have equal results; other columns are ignored; an empty table gives no row.
    """
    hits = scan(spark, docs, threshold=threshold).withColumn("start", F.lit(None).cast("int"))
    hits = hits.unionByName(windows(spark, docs, threshold=threshold).drop("end").withColumn("unit", F.lit(None).cast("int")))
    counts = F.greatest(F.size(F.collect_set("unit")), F.size(F.collect_set("start")))
    per = hits.groupBy("key").agg(F.max(F.struct("dice", "license")).alias("m"), counts.alias("n_units"), F.array_sort(F.collect_set("license")).alias("licenses"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"))
    out = rows.join(per, "key", "left")
    return out.select("doc_id", F.col("m.license").alias("license"), F.col("m.dice").alias("dice"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"))
