"""Licence scans by MinHash bands over overlapping windows, with DataFrame functions only (operator 5).

Texts and licence templates become lower-case words of ASCII letters and digits, and runs of five
words (shingles; a shorter text is one shingle). Windows of ``WINDOW`` shingles start at every
second shingle of a text and at every shingle of a template. Each window has ``BANDS`` MinHash
values (the least of its shingles' hashes under as many permutations), each its own band: a text
retrieves a template if a window of the one and a window of the other share a value in one band.

Chance alone would lose matches: a text that holds one shingle of a template in a window of four
meets it in a band only where that shingle is nearest to the band's constant. So the single shingles
of a text are keys as well, beside the bands: if ``LEAST`` asks for k of a template's n shingles, a
text with k of them holds at least one of any n - k + 1, and the template's first n - k + 1 are looked
up. No match is lost, whatever the length of the template and however its shingles are spread.

What is retrieved is verified exactly: the share of the template's shingles (as strings) that the
text contains must reach ``LEAST``. The result says which share, how often and where.

Templates are a fixed list (or the caller's small one), so their bands are broadcast; texts are
banded where they are read and only the keys of those that meet a template move on; their texts are
read again and joined by whichever way the size of those keys allows. Nothing grows with groups of
copies. Defined cases: null and empty texts match nothing; repeated rows and ids each
give their own rows; a null id stays null. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty, written

WORDS, WINDOW, BANDS, LEAST = 5, 4, 16, 0.8
#: Fixed notices by which texts are licensed (id, text).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of "
     "the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: as the variable of a one-element transform.

    A column made in an earlier select would be copied into each of its uses by the optimizer,
    also into those inside a lambda, and computed anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.split(F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " "))), " ")


def shingle_strings(text: Column) -> Column:
    """Every run of five words, joined; all words if there are fewer, none for no words."""
    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(1))),
                           lambda i: F.array_join(F.slice(w, i, WORDS), " "))

    return F.filter(let(words(text), runs), lambda s: s != "")


def shingle_hashes(text: Column) -> Column:
    """Hashes of the same runs."""
    def runs(w: Column) -> Column:
        return F.when(F.get(w, F.lit(0)) == "", F.array().cast("array<long>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)])))

    return let(words(text), runs)


def windows(text: Column, step: int) -> Column:
    """Windows (h0..h3) of shingle hashes from every ``step``-th shingle; the last one ends with the
    text, and a text of fewer shingles fills its window with its first."""
    def cut(h: Column) -> Column:
        last = F.greatest(F.size(h) - WINDOW, F.lit(0))
        starts = F.sequence(F.lit(0), last + (step - 1), F.lit(step))
        found = F.transform(starts, lambda i: let(F.least(i, last), lambda i: F.struct(*[
            F.coalesce(F.get(h, i + k), F.get(h, i)).alias(f"h{k}") for k in range(WINDOW)])))
        return F.when(F.size(h) > 0, found)

    return let(shingle_hashes(text), cut)


def constants() -> list[int]:
    """One 64-bit number per band: multiples of the golden ratio's fraction, as signed numbers."""
    odd = [(0x9E3779B97F4A7C15 * (2 * b + 1)) & 0xFFFFFFFFFFFFFFFF for b in range(BANDS)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in odd]


def bands(rows: DataFrame, *keep: str, single: bool = False) -> DataFrame:
    """(keep..., band, value): the MinHash values of windows given as columns h0..h3.

    The permutations of the 64-bit hashes are exclusive ors with one constant each, so a value is
    the hash nearest to the band's constant. With ``single`` also each shingle's own hash, as band 0
    (no band's constant is).
    """
    h = [F.col(f"h{k}") for k in range(WINDOW)]
    own = range(-WINDOW, 0) if single else ()       # places of the window's shingles, from its end
    each = rows.select(*keep, *h, F.explode(F.array(*[F.lit(x).cast("long") for x in [*constants(), *own]])).alias("c"))
    value = F.least(*[x.bitwiseXOR(F.col("c")) for x in h])
    band = F.col("c")
    if single:
        value = F.when(F.col("c").between(-WINDOW, -1), F.get(F.array(*h), (F.col("c") + WINDOW).cast("int"))) \
            .otherwise(value)
        band = F.when(F.col("c").between(-WINDOW, -1), F.lit(0).cast("long")).otherwise(F.col("c"))
    return each.select(*keep, band.alias("band"), value.alias("value"))


def needed(template: Column, least: float) -> Column:
    """Hashes of the first n - k + 1 of a template's n shingles, where ``least`` asks for k of them."""
    def first(h: Column) -> Column:
        enough = F.filter(F.sequence(F.lit(1), F.size(h)), lambda j: j / F.size(h) >= least)
        return F.when(F.size(h) > 0, F.slice(h, F.lit(1), F.size(enough)))

    return let(F.array_distinct(shingle_hashes(template)), first)


def templates(spark: SparkSession, given=TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, t in given], "license string, template string")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", given=TEMPLATES,
         least: float = LEAST) -> DataFrame:
    """(id, license, n_shingles, n_found, containment, first_word): one row per document and template
    that it contains, from the word (from 0) where the first of its shingles stands."""
    spark = docs.sparkSession
    t = templates(spark, given)
    known = bands(t.select("license", F.inline(windows(F.col("template"), 1))), "license") \
        .union(t.select("license", F.lit(0).cast("long"), F.explode(needed(F.col("template"), least)))).distinct()
    # the key only names candidates: rows of one key by chance are verified like all others
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")) \
        .withColumn("key", F.xxhash64("id", "text"))
    cut = rows.select("key", F.inline(windows(F.col("text"), 2)))
    # written, so that its size is known when the join with the texts is planned
    met = written(bands(cut, "key", single=True).join(F.broadcast(known), ["band", "value"])
                  .groupBy("key").agg(F.collect_set("license").alias("found")), "met")
    want = t.select("license", F.array_distinct(shingle_strings(F.col("template"))).alias("want"))

    def compare(have: Column) -> Column:
        def result(both: Column) -> Column:
            first = F.array_min(F.transform(both, lambda s: F.array_position(have, s)))
            return F.struct(F.size(both).cast("long").alias("n_found"), (first - 1).cast("long").alias("first_word"))
        return let(F.array_intersect(F.col("want"), have), result)

    there = (rows.join(met, "key").select("id", "text", F.explode("found").alias("license"))
             .join(F.broadcast(want), "license")
             .select("id", "license", F.size("want").cast("long").alias("n_shingles"),
                     F.inline(F.array(let(shingle_strings(F.col("text")), compare)))))
    return (there.withColumn("containment", F.col("n_found") / F.col("n_shingles"))
            .filter(F.col("containment") >= least)
            .select(F.col("id").alias(id_col), "license", "n_shingles", "n_found", "containment", "first_word"))


def oracle(given=TEMPLATES, least: float = LEAST) -> str:
    """The same result by exact containment of every template in every text, as DuckDB SQL."""
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in given)
    cut = ("string_split(trim(lower(regexp_replace(coalesce({0}, ''), '[^A-Za-z0-9]+', ' ', 'g'))), ' ')")
    runs = ("CASE WHEN w = [''] THEN [] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), "
            "lambda i: array_to_string(w[i:i + 4], ' ')) END")
    return f"""
WITH t AS (SELECT license, list_distinct({runs}) AS want
           FROM (SELECT license, {cut.format('template')} AS w FROM (VALUES {values}) v(license, template))),
d AS (SELECT doc_id, {runs} AS have FROM (SELECT doc_id, {cut.format('text')} AS w FROM documents)),
m AS (SELECT doc_id, license, have, want, list_intersect(want, have) AS shared FROM d, t
      WHERE len(list_intersect(want, have)) >= {least} * len(want))
SELECT doc_id, license, CAST(len(want) AS BIGINT) AS n_shingles, CAST(len(shared) AS BIGINT) AS n_found,
       len(shared) / len(want) AS containment,
       CAST(list_min(list_transform(shared, lambda s: list_position(have, s))) - 1 AS BIGINT) AS first_word
FROM m"""
