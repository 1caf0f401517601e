"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

A text's words (runs of letters and digits, lower-cased) give word 5-shingles. A template of n shingles belongs to the
size class c, the next power of two; texts are cut into windows of c + c/2 - 1 shingles, c/2 apart (1 and 1 for c = 1),
so that every place of a template lies whole in some window. A window and a template are a candidate if they agree
in one of BANDS bands of one MinHash value each. A window that holds 0.8 of a template has Jaccard similarity of at least
0.25 with it, and is retrieved with a probability of at least 1 - 0.75^48, above 0.999998. Candidates are verified by
the exact share of the template's shingles in the window.

A window agrees with a template in a band exactly if it holds the template's least shingle of that band and none that is
less. So windows are looked for around these least shingles, at most BANDS a template, and only their bands are
computed; this drops no candidate. Templates are taken in groups of TEMPLATE_GROUP, however many there are.

Defined cases: null, empty and short texts match nothing; an empty table gives an empty result; rows of equal doc_id are
pooled (the best containment and the first place of any of them; rows without a doc_id are one such group); long texts
are scanned whole; of a template's places that tie the first counts; templates of fewer than five words are refused;
further columns are ignored. All of it is DataFrame functions;
the templates are a parameter, and only they are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.runtime import table, written

WORDS, CONTAINMENT, BANDS = 5, 0.8, 48
TEMPLATE_GROUP = 200

# fixed values: public license notices and texts
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-any", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("MIT", "Released under the MIT License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC-full", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT-full", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Zlib-full", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def shingle_hashes(words: Column) -> Column:
    """xxhash64 of each run of five words; empty for fewer words."""
    starts = F.when(F.size(words) >= WORDS, F.sequence(F.lit(0), F.size(words) - WORDS)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))


def band_values(hashes: Column) -> Column:
    """For each band, the hash of its number and its MinHash value."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.array_min(F.transform(hashes, lambda h: F.xxhash64(b, h))))
    )


def band_minima(shingles: Column) -> Column:
    """For each band, the shingle whose hash is least."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.array_min(F.transform(shingles, lambda h: F.struct(F.xxhash64(b, h).alias("x"), h.alias("h"))))["h"],
    )


def size_class(n: Column) -> Column:
    return F.pow(F.lit(2), F.ceil(F.log2(n))).cast("int")


def _templates(rows: DataFrame) -> DataFrame:
    rows = rows.select("license", words_of(F.col("notice")).alias("w"))
    rows = rows.withColumn("shingles", F.array_distinct(shingle_hashes(F.col("w"))))
    rows = rows.select("license", "shingles", size_class(F.size("shingles")).alias("class"), F.size("w").alias("n_words"))
    if not rows.where(F.col("n_words") < WORDS).isEmpty():
        raise ValueError(f"a template needs at least {WORDS} words")
    return rows


def scan(docs: DataFrame, templates: DataFrame | tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment (largest over windows), first_word (of the template's first shingle found).

    `templates`: (license, notice) pairs, or a table of them.
    """
    spark = docs.sparkSession
    rows = templates if isinstance(templates, DataFrame) else spark.createDataFrame(list(templates), "license string, notice string")
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("license", "notice")) - 1  # the templates are a parameter
    known = written(_templates(rows).join(rows.select("license", "notice", number.alias("number")), "license"), "license-templates")
    groups = -(-known.count() // TEMPLATE_GROUP)
    parts = [_scan(docs, known.where(F.floor(F.col("number") / TEMPLATE_GROUP) == g)) for g in range(max(1, groups))]
    return reduce(DataFrame.unionByName, parts)


def _scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    by_class: dict[int, set[int]] = {}
    for row in known.select("class", band_minima(F.col("shingles")).alias("minima")).collect():  # at most BANDS a template
        by_class.setdefault(row["class"], set()).update(row["minima"])
    any_hash = sorted({h for hs in by_class.values() for h in hs})
    texts = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    at = F.when(F.size("w") >= WORDS, F.sequence(F.lit(0), F.size("w") - WORDS)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(at, lambda i: F.struct(i.alias("p"), F.xxhash64(*[F.get("w", i + k) for k in range(WORDS)]).alias("h")))
    # the row number also keeps the filter from being moved below this projection, which would work it out twice
    texts = texts.select("doc_id", "w", F.filter(hashed, lambda x: x["h"].isin(any_hash)).alias("hits"), F.monotonically_increasing_id().alias("row"))
    texts = texts.where(F.size("hits") > 0)
    texts = written(texts.select("doc_id", "row", shingle_hashes(F.col("w")).alias("hashes"), "hits"), "license-hits")

    def windows(size: int, minima: set[int]) -> Column:
        """(class, start, slice) of each window of this class that holds a least shingle of one of its templates."""
        step = max(1, size // 2)
        width = size + step - 1 if size > 1 else 1
        places = F.transform(F.filter("hits", lambda x: x["h"].isin(sorted(minima))), lambda x: x["p"])
        first = lambda p: F.greatest(F.lit(0), F.ceil((p - width + 1) / step)).cast("int")
        numbers = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(first(p), F.floor(p / step).cast("int")))))
        return F.transform(
            numbers,
            lambda k: F.struct(F.lit(size).alias("class"), (k * step).alias("start"), F.slice("hashes", k * step + 1, F.lit(width)).alias("held")),
        )

    none = F.array().cast("array<struct<class: int, start: int, held: array<bigint>>>")
    cut = texts.select("doc_id", F.explode(F.concat(none, *[windows(c, hs) for c, hs in sorted(by_class.items())])).alias("x"))
    cut = cut.select("doc_id", "x.class", "x.start", "x.held")
    banded = cut.select("*", F.explode(band_values(F.col("held"))).alias("band"))
    lookup = known.select("license", "class", "shingles", F.explode(band_values(F.col("shingles"))).alias("band"))
    found = banded.join(F.broadcast(lookup), ["class", "band"]).select("doc_id", "start", "license", "held", "shingles")
    share = F.size(F.array_intersect("shingles", "held")) / F.size("shingles")
    place = F.array_min(F.filter(F.transform("held", lambda h, i: F.when(F.array_contains("shingles", h), i)), lambda i: i.isNotNull()))
    exact = found.select("doc_id", "license", share.alias("containment"), (F.col("start") + place).cast("int").alias("first_word"))
    exact = exact.where(F.col("containment") >= CONTAINMENT)
    return exact.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(name, notice.replace("'", "''")) for name, notice in TEMPLATES)
    split = "string_split(trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    grams = "list_transform(range(1, greatest(1, len({w}) - 3)), lambda i: array_to_string({w}[i:i+4], ' '))"
    return f"""
WITH t AS (SELECT license, {split.format("notice")} AS w FROM (VALUES {values}) v(license, notice)),
tg AS (SELECT license, list_distinct({grams.format(w="w")}) AS g FROM t),
tc AS (SELECT license, g, CAST(pow(2, ceil(log2(len(g)))) AS INT) AS c FROM tg),
classes AS (SELECT *, greatest(1, c // 2) AS step, CASE WHEN c > 1 THEN c + c // 2 - 1 ELSE 1 END AS width FROM tc),
d AS (SELECT doc_id, {split.format("text")} AS w FROM documents),
dg AS (SELECT doc_id, {grams.format(w="w")} AS g FROM d WHERE len(w) >= 5),
pos AS (SELECT doc_id, unnest(g) AS s, unnest(range(len(g))) AS p FROM dg),
tp AS (SELECT license, len(g) AS n, step, width, unnest(g) AS s FROM classes),
hit AS (SELECT doc_id, license, n, width, step, pos.s AS s, p,
    unnest(range(greatest(0, CAST(ceil((p - width + 1) / step) AS BIGINT)), p // step + 1)) AS k FROM pos JOIN tp ON pos.s = tp.s),
win AS (SELECT doc_id, license, k, count(DISTINCT s) / max(n) AS containment, min(p) AS first_word FROM hit GROUP BY doc_id, license, k)
SELECT doc_id, license, max(containment) AS containment, CAST(min(first_word) AS INT) AS first_word
FROM win WHERE containment >= 0.8 GROUP BY doc_id, license
"""


OP4_SQL = _oracle()
