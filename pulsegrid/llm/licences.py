"""Licence scans in DataFrame operations: TF-IDF cosine of statements to templates, then inheritance along paths.

* A *statement* is a line of a file that holds one of the ``ANCHORS``, alone, joined with neighbouring lines (up to ``LINES``
  in all, none longer than ``WRAP``: a longer line isn't one that somebody has wrapped), or a sentence of such a line. A *licence file* is a file with a licence file's name, or one that
  holds nothing but a statement.
* Words are runs of [a-z0-9] after lower-casing. A word weighs its count times
  ``ln((1 + documents) / (1 + documents with it)) + 1``; documents are counted over the whole table for the words
  of the templates (a bounded vocabulary), words outside it count as in none. A text's licence is the template of
  the largest cosine (ties: the first name), if that is at least ``LEAST``.
* A file's own best statement decides (``header``). Any statement of a licence file (``file``) also speaks for its directory,
  so a whole licence text does by its title or its first sentence. A file without either takes the licence of its
  nearest ancestor directory that has one (``directory``), by a join of the directories' ancestors with the licensed
  directories. Reserved rights are a class of their own: it stands behind any licence that the same file names, and
  a file or directory that states nothing else inherits nothing.

Equal statements are compared once, whatever number of files repeat them; only ids and paths are shuffled, never texts.
Defined cases: a null text holds no statement; null parts of a path count as empty; rows that repeat a path share its
result; of several licence files of a directory the largest cosine counts, then the first name; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import stored

LEAST, LINES, WRAP = 0.6, 4, 160
RESERVED = "All-Rights-Reserved"
ANCHORS = r"(?i)licen[cs]e|copyright|creative commons|public domain|permission is hereby|redistribution and use|rights reserved"
LICENCE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"
#: Short statements by which files declare public licences, and the titles of their texts.
TEMPLATES = {
    RESERVED: ["All rights reserved."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted.", "Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, all rights are waived: this work is in the public domain under CC0 1.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software under the terms of the GNU General Public License.", "GNU General Public License Version 3, 29 June 2007"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"],
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _templates(spark, templates: dict[str, list[str]]) -> DataFrame:
    """(template, licence, word, tf): a bounded table, as large as the templates."""
    import re
    from collections import Counter

    rows, number = [], 0
    for licence in sorted(templates):
        for text in templates[licence]:
            rows += [(number, licence, w, float(n)) for w, n in sorted(Counter(re.findall("[a-z0-9]+", text.lower())).items())]
            number += 1
    return spark.createDataFrame(rows, "template int, licence string, word string, tf double")


def _weights(files: DataFrame, templates: DataFrame) -> tuple[DataFrame, float]:
    """(word, idf) of the templates' words, and the weight of any other word."""
    vocabulary = sorted({r["word"] for r in templates.select("word").distinct().collect()})
    known = F.array_intersect(words_of(F.coalesce("text", F.lit(""))), F.array(*[F.lit(w) for w in vocabulary]))
    total = files.count()
    counted = files.select(F.explode(known).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log((1.0 + total) / (1.0 + F.coalesce("df", F.lit(0)))) + 1
    other = float(files.sparkSession.range(1).select(F.log(F.lit(1.0 + total)) + 1).first()[0])
    return templates.select("word").distinct().join(counted, "word", "left").select("word", idf.alias("idf")), other


def compared(units: DataFrame, templates: DataFrame, idf: DataFrame, other: float) -> DataFrame:
    """(unit, licence, score) of the distinct texts in ``units`` that reach ``LEAST``."""
    pairs = templates.join(idf, "word").withColumn("w", F.col("tf") * F.col("idf"))
    lengths = pairs.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    sides = pairs.join(lengths, "template").select("licence", "template", "word", (F.col("w") / F.col("length")).alias("tw"))
    counts = units.select("unit", F.explode(words_of(F.col("unit"))).alias("word")).groupBy("unit", "word").agg(F.count("*").alias("tf"))
    weighed = counts.join(idf, "word", "left").select("unit", "word", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("uw"))
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("uw") * F.col("uw"))).alias("norm"))
    dots = weighed.join(sides, "word").groupBy("unit", "licence", "template").agg(F.sum(F.col("uw") * F.col("tw")).alias("dot"))
    cosines = dots.join(norms, "unit").select("unit", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    best = cosines.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("b"))
    return best.select("unit", F.col("b.licence").alias("licence"), (-F.col("b.less")).alias("score")).where(F.col("score") >= LEAST)


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """path, licence, score, basis, declared_in of every distinct path of ``files`` (columns path, text)."""
    spark = files.sparkSession
    files = files.select(F.coalesce("path", F.lit("")).alias("path"), "text")
    table = _templates(spark, templates or TEMPLATES)
    idf, other = _weights(files, table)
    idf = stored(idf, "licence-words")
    name = F.element_at(F.split("path", "/"), -1)
    body = F.trim(F.regexp_replace("text", r"[\x09-\x0D]+", " "))
    spoken = files.where(F.col("text").rlike(ANCHORS) | name.rlike(LICENCE_NAME))
    lines = F.split("text", "\n")
    # places of anchored lines first: windows are cut only around them
    anchored = spoken.select("path", lines.alias("lines"), F.explode(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(ANCHORS), i)), lambda i: i.isNotNull())).alias("i"))
    groups = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(LINES)), lambda k: F.transform(F.sequence(F.greatest(F.lit(0), F.col("i") - k + 1), F.col("i")), lambda j: F.slice("lines", j + 1, k))))
    short = F.when(F.length(F.get("lines", F.col("i"))) <= WRAP, F.filter(groups, lambda g: F.forall(g, lambda x: F.length(x) <= WRAP))).otherwise(F.slice(groups, 1, 0))
    windows = F.concat(F.array(F.get("lines", F.col("i"))), F.transform(short, lambda g: F.array_join(g, " ")))
    sentences = F.filter(F.split(F.get("lines", F.col("i")), r"(?<=[.;])\s+"), lambda x: x.rlike(ANCHORS))
    parts = anchored.select("path", F.explode(F.array_distinct(F.concat(windows, sentences))).alias("unit")).select("path", F.trim(F.regexp_replace("unit", r"[\x09-\x0D]+", " ")).alias("unit"), F.lit(False).alias("whole"))
    wholes = spoken.where(~F.col("text").rlike(r"\n[\s\S]*\S")).where("text is not null").select("path", body.alias("unit"), F.lit(True).alias("whole"))
    units = stored(parts.unionByName(wholes), "statements")
    found = stored(compared(units.select("unit").distinct(), table, idf, other), "statement-licences")
    better = F.min(F.struct((F.col("licence") == RESERVED).alias("reserved"), (-F.col("score")).alias("less"), "licence"))
    own = units.join(found, "unit").groupBy("path").agg(better.alias("b"), F.bool_or("whole").alias("whole"))
    speaks = F.col("whole") | name.rlike(LICENCE_NAME)
    own = own.select("path", F.col("b.licence").alias("licence"), (-F.col("b.less")).alias("score"), F.when(speaks, "file").otherwise("header").alias("basis"))
    own = stored(own, "own-licences")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    licensed = own.where("basis = 'file'").groupBy(folder.alias("at")).agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("b")).select("at", F.col("b.licence").alias("licence"), (-F.col("b.less")).alias("score"))
    paths = files.groupBy("path").agg(F.count("*").alias("rows")).select("path", folder.alias("folder"))
    folders = paths.select("folder").distinct()
    steps = F.split("folder", "/")
    ancestors = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth"), steps.alias("parts")).select("folder", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("at"))
    nearest = ancestors.join(licensed, "at").groupBy("folder").agg(F.max(F.struct("depth", "licence", "score", "at")).alias("n"))
    nearest = stored(nearest.select("folder", F.col("n.licence").alias("near_licence"), F.col("n.score").alias("near_score"), F.col("n.at").alias("near")), "near-licences")
    joined = paths.join(own, "path", "left").join(nearest, "folder", "left")
    return joined.select(
        "path", F.coalesce("licence", "near_licence").alias("licence"), F.coalesce("score", "near_score").alias("score"),
        F.coalesce("basis", F.when(F.col("near_licence").isNotNull(), "directory"), F.lit("none")).alias("basis"),
        F.when(F.col("licence").isNull(), F.col("near")).alias("declared_in"),
    )


def licence_rows(docs: DataFrame) -> DataFrame:
    """doc_id, path, licence, score, basis, declared_in of every document; its path is source/lang/doc_id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    files = docs.select("doc_id", path.alias("path"), "text")
    found = scan(files.select("path", "text"))
    return files.select("doc_id", "path").join(found, "path").select("doc_id", "path", "licence", F.round("score", 6).alias("score"), "basis", "declared_in")
