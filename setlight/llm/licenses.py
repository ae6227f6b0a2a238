"""License scan: MinHash bands over overlapping text windows, with DataFrame functions only.

Templates are rows (license, text), from a folder of license texts or from the stated notices. A text
becomes rows of hashed five-word shingles with their positions; a broadcast table of the templates'
shingles keeps the known ones. Templates with equally many shingles m form a class with windows of
m + s shingles at every s-th position (s is a quarter of m), so that some window holds the whole of
any occurrence. A shingle known to a class goes to the windows around it, and a window's known
shingles, at most its length, are one row. A window that contains at least ``containment`` of a
template has a Jaccard similarity of at least j0 with it, more so without unknown shingles, and the
number of bands is chosen from j0 so that all bands miss with a probability below ``miss``. Bands are
joined with the template bands; each pair that they retrieve is verified by exact shingle containment,
once, at the first band that the two share. Windows with fewer known shingles than any match needs are
not hashed: that loses nothing.

Defined cases: null, empty and shorter texts match nothing, as do templates of fewer than five words;
repeated rows of an id count as one document; rows with a null id share one result row for each
license; equal templates count once; an empty table of documents or templates gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "[a-z0-9]+"
SHINGLE = 5

#: Opening or identifying sentences of public license notices.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
}


def stride(m: int) -> int:
    return max(1, m // 4)


def bands_for(m: int, containment: float, miss: float) -> int:
    """Bands of one row each so that a window with the containment is missed with less than ``miss``."""
    shared = math.ceil(containment * m)
    j0 = shared / (m + stride(m) + m - shared)
    return 1 if j0 >= 1 else math.ceil(math.log(miss) / math.log(1 - j0))


def template_shingles(templates: dict[str, list[str]]) -> list[tuple[str, int, list[str]]]:
    """(license, template number, distinct shingles) in order."""
    out = []
    for name, texts in templates.items():
        for text in texts:
            w = re.findall(WORDS, text.lower())
            out.append((name, len(out), list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))))
    return out


#: Templates with more shingles in all are joined as Spark sees fit, not by a broadcast.
BROADCAST = 1_000_000


def stated_templates(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """(license, text) of a few stated notices."""
    rows = [F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, texts in templates.items() for text in texts]
    return spark.range(1).select(F.inline(F.array(*rows)))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(license, text) of a folder of license texts, a file each; the license is the file's name without .txt."""
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("license"), F.col("value").alias("text"))


def kept_apart(df: DataFrame, name: str, value: Column, *others: str) -> DataFrame:
    """``value`` as a column that is computed once: a generator keeps the optimizer from copying the expression."""
    return df.select(*others, F.explode(F.array(value)).alias(name))


def with_shingles(texts: DataFrame, *others: str) -> DataFrame:
    """``others`` and the hashes of a text's shingles in order, for texts that have any."""
    words = kept_apart(texts, "w", F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)), *others).where(F.size("w") >= SHINGLE)
    shingle = lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(SHINGLE)])
    return kept_apart(words, "h", F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE), shingle), *others)


def minima(hashes: Column, bands: Column) -> Column:
    """One minimum for each band's hash function."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda k: F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, k))))


def template_table(templates: DataFrame, containment: float, miss: float) -> DataFrame:
    """(license, template, m, step, bands, shingles), a row for each template that has shingles."""
    texts = templates.select("license", "text").distinct().withColumn("template", F.xxhash64("license", "text"))
    known = with_shingles(texts, "license", "template").select("license", "template", F.array_distinct("h").alias("shingles")).withColumn("m", F.size("shingles"))
    lengths = [r.m for r in known.select("m").distinct().collect()]  # no more than the longest template has shingles
    classes = [F.struct(F.lit(m).alias("m"), F.lit(stride(m)).alias("step"), F.lit(bands_for(m, containment, miss)).alias("bands")) for m in sorted(lengths)]
    if not classes:
        return known.withColumns({"step": F.lit(1), "bands": F.lit(1)})
    return known.join(F.broadcast(templates.sparkSession.range(1).select(F.inline(F.array(*classes)))), "m")


def known_windows(docs: DataFrame, known: DataFrame, small) -> DataFrame:
    """(doc_id, m, bands, start, window): the shingles of a class that a window holds."""
    keys = known.select("m", "step", "bands", F.explode("shingles").alias("h")).groupBy("h").agg(F.collect_set(F.struct("m", "step", "bands")).alias("classes"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.crc32(F.col("text").cast("binary")).alias("t2"))
    row = ["doc_id", "t1", "t2"]  # repeated ids with other texts have windows of their own
    at = with_shingles(texts, *row).select(*row, F.posexplode("h").alias("pos", "h"))
    hits = at.join(small(keys), "h").select(*row, "pos", "h", F.inline("classes"))
    length = F.col("m") + F.col("step")
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - length + 1) / F.col("step")) * F.col("step")).cast("int")
    last = (F.floor(F.col("pos") / F.col("step")) * F.col("step")).cast("int")
    return hits.select(*row, "m", "bands", "h", F.explode(F.sequence(first, last, F.col("step"))).alias("start")).groupBy(*row, "m", "bands", "start").agg(F.collect_set("h").alias("window"))


def scan_licenses(docs: DataFrame, templates: DataFrame | dict[str, list[str]] | None = None, containment: float = 0.75, miss: float = 1e-6) -> DataFrame:
    """(doc_id, license, containment, first_word) for each license found in a document.

    ``templates`` is a table (license, text); without one the stated notices are looked for.
    """
    if not isinstance(templates, DataFrame):
        templates = stated_templates(docs.sparkSession, templates or TEMPLATES)
    known = template_table(templates, containment, miss)
    few = (known.agg(F.sum("m")).first()[0] or 0) <= BROADCAST
    small = F.broadcast if few else lambda df: df

    windows = known_windows(docs, known, small).where(F.size("window") / F.col("m") >= containment)
    signed = kept_apart(windows, "signature", minima(F.col("window"), F.col("bands")), "doc_id", "m", "start", "window")
    banded = signed.select("*", F.posexplode("signature").alias("band", "value"))
    signatures = known.select("license", "template", "m", minima(F.col("shingles"), F.col("bands")).alias("t_signature"))
    bands = signatures.select("license", "template", "m", "t_signature", F.posexplode("t_signature").alias("band", "value"))
    met_before = F.exists(F.zip_with("signature", "t_signature", lambda x, y: x == y), lambda same: same)
    pairs = banded.join(small(bands), ["m", "band", "value"]).withColumns({c: F.slice(c, F.lit(1), F.col("band")) for c in ("signature", "t_signature")}).where(~met_before)
    share = F.size(F.array_intersect("window", "shingles")) / F.col("m")
    checked = pairs.select("doc_id", "license", "template", "m", "start", "window").join(small(known.select("template", "shingles")), "template")
    found = checked.select("doc_id", "license", "start", share.alias("containment")).where(F.col("containment") >= containment)
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"))


def oracle_sql(templates: dict[str, list[str]] | None = None, containment: float = 0.75) -> str:
    """The same scan without hashing, for DuckDB: distinct template shingles counted in every window."""
    rows = []
    for name, number, shingles in template_shingles(templates or TEMPLATES):
        m = len(shingles)
        rows += [f"('{name}', {number}, {m}, {stride(m)}, '{x}')" for x in shingles]
    return f"""
with template(license, template, m, s, shingle) as (values {", ".join(rows)}),
words as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents),
shingles as (
  select doc_id, i as pos, array_to_string(w[i + 1:i + 5], ' ') as shingle
  from (select doc_id, w, unnest(range(0, len(w) - 4)) as i from words where len(w) >= 5)
), hits as (select doc_id, pos, license, template, m, s, shingle from shingles join template using (shingle)),
windows as (
  select doc_id, license, template, m, shingle, unnest(range(greatest(0, cast(ceil((pos - m - s + 1) / s) as bigint) * s), (pos // s) * s + 1, s)) as start from hits
), counted as (
  select doc_id, license, start, count(distinct shingle) / m as containment from windows group by doc_id, license, template, m, start
)
select doc_id, license, max(containment) as containment, min(start) as first_word from counted where containment >= {containment} group by doc_id, license
"""
