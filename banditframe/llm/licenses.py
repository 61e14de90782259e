"""License scans, in DataFrame functions only: TF-IDF cosine of headers and licence files to templates, then inheritance.

Segments of a text that speak of a licence are compared with the templates as sparse vectors of TF-IDF weights: its lines, cut at
sentence ends, and its sentences, which may be wrapped over lines with comment marks. A file's licence is the one it tags by SPDX,
or else that of its best segment. A file with no licence of its own inherits that of the nearest directory above it in which a
licence file lies: a file whose licence segments make up half of its words, or that has the name of one.

Cases: null and empty texts have no segments but may inherit; a null path is the root; equal segments are compared once,
however often they occur, while their frequencies count every occurrence; of equal scores the first licence by name wins; a
segment without any word of a template has score 0; each row is one row of the result, whatever other rows of its id or path are;
segments of any length are shuffled once, and by their MD5 after that; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banditframe.llm.common import cut, n_words

#: Fixed list: the notices by which texts name their licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License, CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
]
SPEAKS = r"(?i)licen[cs]e|copyright|permission is hereby|redistribution and use|public domain|spdx|permission to use|neither the name of"
#: A tag that names the licence, and what marks a comment's line.
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9][A-Za-z0-9.+-]*)"
_MARK = r"[ \t]*(?:[#*;%/]+|--)?[ \t]*"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)[^/]*$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*)"), F.lit(1))


def segments(text: Column) -> Column:
    """What of a text speaks of a licence: pieces of its lines, and of its paragraphs with their lines joined."""
    joined = F.regexp_replace(F.regexp_replace(text, rf"\n{_MARK}(?=\n)", "\x01"), rf"\n{_MARK}|^{_MARK}", " ")
    cut_at = lambda x, ends: F.split(x, rf"{ends}|(?<=[.;!?])\s+(?=\p{{Lu}})")
    parts = F.transform(F.concat(cut_at(text, r"\n"), cut_at(joined, "\x01")), lambda s: F.trim(F.regexp_replace(s, rf"^{_MARK}|\s+$", "")))
    spoken = F.array_distinct(F.filter(parts, lambda s: s.rlike(SPEAKS)))
    return F.when(text.rlike(SPEAKS), spoken).otherwise(F.array().cast("array<string>"))


def _weights(rows: DataFrame, idf: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, text) -> (key, term, w) of unit length."""
    counts = rows.select(*key, F.explode(terms(F.col("text"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    raw = counts.join(idf, "term").select(*key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(*key, "term", (F.col("w") / F.col("norm")).alias("w"))


def scores(segments: DataFrame, templates: DataFrame) -> DataFrame:
    """segments (of: a key, text, n: how often) and templates (license, text) -> (of, license, score): the nearest template."""
    segments = segments.select("of", "text", "n")
    both = segments.select("text", "n").unionByName(templates.select("text", F.lit(1).cast("long").alias("n")))
    total = both.agg(F.sum("n")).first()[0] or 0
    df = both.select("n", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.sum("n").alias("df"))
    idf = cut(df.select("term", (F.ln(F.lit(1.0 + total) / (1 + F.col("df"))) + 1).alias("idf")))
    ours = _weights(segments, idf, ["of"])
    named = templates.select("license", F.md5("text").alias("template"), "text").distinct()
    theirs = cut(_weights(named, idf, ["license", "template"])).select("license", "template", "term", F.col("w").alias("v"))
    dots = ours.join(theirs, "term").groupBy("of", "license", "template").agg(F.sum(F.col("w") * F.col("v")).alias("score"))
    dots = dots.withColumn("score", F.round("score", 6))
    best = F.min(F.struct((-F.col("score")).alias("s"), "license"))
    return dots.groupBy("of").agg(best.alias("b")).select("of", "b.license", (-F.col("b.s")).alias("score"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", templates: list | DataFrame = TEMPLATES, threshold: float = 0.7) -> DataFrame:
    """(id, path, license, score, origin: header, inherited or none, origin_dir) of files."""
    spark: SparkSession = files.sparkSession
    given = templates if isinstance(templates, DataFrame) else spark.createDataFrame(templates, "license string, text string")
    text = F.col(text_col)
    rows = files.select(F.xxhash64(id_col, path_col, text_col).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), n_words(text).alias("size"), F.regexp_extract(text, SPDX, 1).alias("tag"), segments(text).alias("parts"))
    rows = cut(rows.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    # rows of one number are equal, so one of them will do
    said = rows.select("row", "path", "dir", "size", "parts").dropDuplicates(["row"]).select("row", "path", "dir", "size", F.explode("parts").alias("text"))
    said = said.withColumn("of", F.md5("text"))
    often = rows.select(F.explode("parts").alias("text")).groupBy(F.md5("text").alias("of")).agg(F.any_value("text").alias("text"), F.count("*").alias("n"))
    seen = cut(scores(cut(often), given).filter(F.col("score") >= threshold))
    named = said.join(seen, "of").withColumn("words", n_words(F.col("text")))
    best = F.min(F.struct((-F.col("score")).alias("s"), "license"))
    own = named.groupBy("row", "path", "dir", "size").agg(best.alias("b"), F.sum("words").alias("words")).select("row", "path", "dir", "size", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), "words")
    tagged = rows.filter("tag <> ''").select("row", "path", "dir", "size", F.col("tag").alias("license"), F.lit(1.0).alias("score"), F.lit(0).cast("long").alias("words")).distinct()
    own = own.join(tagged.select("row"), "row", "left_anti").unionByName(tagged)
    own = cut(own.select("row", "dir", "license", "score", ((F.col("words") * 2 >= F.col("size")) | F.col("path").rlike(LICENCE_FILE)).alias("whole")))
    dirs = own.filter("whole").groupBy("dir").agg(best.alias("b")).select(F.col("dir").alias("above"), F.col("b.license").alias("from"), (-F.col("b.s")).alias("by"))
    steps = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda k: F.array_join(F.slice(F.split("dir", "/"), 1, k), "/"))))
    near = rows.select("dir").distinct().select("dir", F.explode(F.array_distinct(steps)).alias("above")).join(dirs, "above")
    near = cut(near.groupBy(F.col("dir").alias("d")).agg(F.max_by(F.struct("above", "from", "by"), F.length("above")).alias("heir")))
    found = rows.select("row", "id", "path", "dir").join(own.select("row", "license", "score"), "row", "left").join(near, F.col("dir") == F.col("d"), "left")
    return found.select(
        F.col("id").alias(id_col),
        F.col("path").alias(path_col),
        F.coalesce("license", "heir.from").alias("license"),
        F.coalesce("score", "heir.by", F.lit(0.0)).alias("score"),
        F.when(F.col("license").isNotNull(), "header").when(F.col("heir").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("license").isNull(), F.col("heir.above")).alias("origin_dir"),
    )
