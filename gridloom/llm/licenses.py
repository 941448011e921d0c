"""License scans by MinHash over text windows, DataFrame functions only.

A text is lower-cased and cut into words of ASCII letters and digits. Templates
are put in classes by length; a class scans windows of twice its length,
starting every half window, so any occurrence of a template lies whole inside a
window. A band is one of the template's 5-word shingles with the smallest
MinHash values; a template has one band more than a window may lack shingles at
a containment of 0.8, so a window that holds the template collides in one band
at least: for certain, whatever the lengths of the two, where bands of several
rows of both sides' minima would only make it likely. Windows with a band of a
template are the candidates, verified by exact shingle containment of 0.8 or
more. A template of under five words is one shingle, as long as itself.

Texts without a band leave before windows are made. The templates are parameters
of the query plan (as many rows as the caller lists), of any length, and
broadcast.

Null, empty and short texts (shorter than a shingle) have no matches and give no
row; very long texts are scanned whole, in time proportional to their length;
repeated rows give their rows again; of equally good windows the first is
reported; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINED = 5, 0.8
#: Words of the shortest class of templates; each class is three times as long as the one before.
SHORTEST = 8

#: License notices (fixed values): name, text.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]++", " ")), " ")


def shingles(w: Column, size: int = SHINGLE) -> Column:
    """A hash of each ``size`` words, in order; none for a shorter text."""
    at = F.sequence(F.lit(0), F.size(w) - size)
    return F.when(F.size(w) >= size, F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))


def by_minhash(hashes: Column) -> Column:
    """Shingle hashes in the order of their MinHash values."""
    return F.transform(F.array_sort(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, F.lit(0)).alias("value"), h.alias("s")))), lambda x: x["s"])


def bands(ordered: list[int]) -> list[int]:
    """As many of a template's shingles that one at least is in any window that holds the template."""
    return ordered[: len(ordered) - math.ceil(len(ordered) * CONTAINED) + 1]


def _words_of(text: str) -> int:
    return len(re.findall(r"[a-z0-9]+", text.lower()))


def _class(n_words: int) -> int:
    out = SHORTEST
    while out < n_words:
        out *= 3
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, template, first_word, matched, wanted, containment: the best window of each template a text holds."""
    listed = [(k, name, text, _words_of(text)) for k, (name, text) in enumerate(TEMPLATES if templates is None else templates)]
    sizes = sorted({min(n, SHINGLE) for *_, n in listed if n})
    found = [_scan(docs, [x for x in listed if min(x[3], SHINGLE) == size], size, id_col, text_col) for size in sizes]
    if not found:
        raise ValueError("there must be a template with a word")
    return reduce(DataFrame.unionByName, found)


def _scan(docs: DataFrame, listed: list[tuple[int, str, str, int]], size: int, id_col: str, text_col: str) -> DataFrame:
    """scan for templates with shingles of ``size`` words."""
    spark = docs.sparkSession
    frame = spark.createDataFrame([(k, name, text, _class(n)) for k, name, text, n in listed], "template int, license string, text string, class int")
    known = frame.select("template", "license", "class", by_minhash(F.array_distinct(shingles(words(F.col("text")), size))).alias("wanted")).collect()  # as many rows as templates
    of_band: dict[int, list[int]] = {}
    for r in known:
        for x in bands(r["wanted"]):
            of_band.setdefault(x, []).append(r["template"])
    wanted = spark.createDataFrame([(r["template"], r["license"], r["class"], list(r["wanted"])) for r in known], "template int, license string, class int, wanted array<bigint>")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w"))
    hashed = texts.select("doc_id", "row", F.explode(F.array(F.struct("w"))).alias("x")).select("doc_id", "row", F.explode(F.array(shingles(F.col("x.w"), size))).alias("s"))
    hit = hashed.where(F.exists("s", lambda x: x.isin(*of_band)))
    windows = hit.withColumn("class", F.explode(F.array(*(F.lit(c) for c in sorted({r["class"] for r in known})))))
    count = F.greatest(F.lit(1), F.ceil((F.size("s") + size - 1 - F.col("class")) / F.col("class"))).cast("int")
    windows = windows.select("doc_id", "row", "class", "s", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    windows = windows.select("doc_id", "row", "class", (F.col("k") * F.col("class")).alias("first_word"), F.slice("s", F.col("k") * F.col("class") + 1, F.col("class") * 2 - size + 1).alias("s"))
    templates_of = F.create_map(*(F.lit(x) if k == 0 else F.array(*map(F.lit, x)) for pair in of_band.items() for k, x in enumerate(pair)))
    candidates = F.array_distinct(F.flatten(F.transform(F.filter("s", lambda x: x.isin(*of_band)), lambda x: F.element_at(templates_of, x))))
    held = windows.withColumn("template", F.explode(candidates))
    checked = held.join(F.broadcast(wanted), ["class", "template"]).withColumn("matched", F.size(F.array_intersect("s", "wanted"))).where(F.col("matched") >= F.size("wanted") * CONTAINED)
    best = checked.groupBy("doc_id", "row", "license", "template").agg(F.max(F.struct("matched", (-F.col("first_word")).alias("before"))).alias("b"), F.first(F.size("wanted")).alias("wanted"))
    return best.select(F.col("doc_id").alias(id_col), "license", "template", (-F.col("b.before")).cast("long").alias("first_word"), F.col("b.matched").alias("matched"), "wanted", (F.col("b.matched") / F.col("wanted")).alias("containment"))
