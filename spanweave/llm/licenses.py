"""Licences of files: TF-IDF cosine of headers and licence files to templates, then inheritance along folders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices as their licences word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the Software without restriction MIT License"),
    ("MIT", "SPDX License Identifier MIT"),
    ("ISC", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Released under the ISC License"),
    ("ISC", "SPDX License Identifier ISC"),
    ("Apache-2.0", "Licensed under the Apache License Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License Apache License Version 2.0 "
                   "distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("Apache-2.0", "SPDX License Identifier Apache 2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License version 3"),
    ("GPL-3.0", "free software you can redistribute it and or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation either version 3 of the License"),
    ("GPL-3.0", "SPDX License Identifier GPL 3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License version 2"),
    ("GPL-2.0", "free software you can redistribute it and or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation either version 2 of the License"),
    ("GPL-2.0", "SPDX License Identifier GPL 2.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License version 3"),
    ("LGPL-3.0", "free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License "
                 "as published by the Free Software Foundation either version 3 of the License"),
    ("LGPL-3.0", "SPDX License Identifier LGPL 3.0"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License version 3"),
    ("AGPL-3.0", "SPDX License Identifier AGPL 3.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0"),
    ("MPL-2.0", "SPDX License Identifier MPL 2.0"),
    ("CC0-1.0", "Released under CC0 1.0 Universal Public Domain Dedication"),
    ("CC0-1.0", "SPDX License Identifier CC0 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "SPDX License Identifier CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "SPDX License Identifier CC BY SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "SPDX License Identifier CC BY NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY ND 4.0"),
    ("CC-BY-ND-4.0", "SPDX License Identifier CC BY ND 4.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms with or without modification are permitted BSD 3 Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission"),
    ("BSD-3-Clause", "BSD 3 Clause License"),
    ("BSD-3-Clause", "SPDX License Identifier BSD 3 Clause"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms with or without modification are permitted BSD 2 Clause License"),
    ("BSD-2-Clause", "BSD 2 Clause License"),
    ("BSD-2-Clause", "SPDX License Identifier BSD 2 Clause"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", "SPDX License Identifier Unlicense"),
]
#: Lines that can be a header, before anything is weighed.
_HINT = r"(?i)licen[cs]|copyright|permission is hereby|permission to use|redistribution and use|creative commons|spdx|unencumbered|cc0|\bcc[ -]by\b|neither the name"
#: Characters of a line that can be part of a notice wrapped over several.
WRAPPED = 160
#: File names that speak for their folder.
_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)\b[^/]*$"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def template_weights(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``license``, ``template``, ``word``, ``weight`` (unit vectors) and ``idf``; as large as the list of templates."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    counts = rows.select("template", "license", F.explode(_words(F.col("text"))).alias("word")).groupBy("template", "license", "word").agg(
        F.count(F.lit(1)).alias("tf"))
    idf = counts.groupBy("word").agg((F.log(F.lit((1.0 + len(templates))) / (1.0 + F.count(F.lit(1)))) + 1.0).alias("idf"))
    weighed = counts.join(F.broadcast(idf), "word").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(F.broadcast(norm), "template").select("license", "template", "word", (F.col("w") / F.col("norm")).alias("weight"), "idf")


def notice_runs(text: Column) -> Column:
    """Lines of a text that read like a notice, and each with neighbours as one header: with one or two after it, the one before it, or one
    on both sides, if none is longer than ``WRAPPED``. Linear in the text."""
    lines = F.split(text, "\n", -1)
    rest = F.greatest(F.size(lines) - 1, F.lit(0))
    # Fields by place: a line, the two after it, the one before it.
    zipped = F.arrays_zip(lines, F.slice(lines, F.lit(2), rest), F.slice(lines, F.lit(3), rest), F.concat(F.array(F.lit(None).cast("string")), lines))

    def run(x: Column, *at: str) -> Column:
        fits = [F.char_length(x[i]) <= WRAPPED for i in at]
        return F.when(F.array_min(F.array(*[F.coalesce(f, F.lit(False)) for f in fits])), F.concat_ws(" ", *[x[i] for i in at]))

    hinted = F.filter(zipped, lambda x: F.coalesce(x["0"].rlike(_HINT), F.lit(False)))
    return F.array_compact(F.flatten(F.transform(hinted, lambda x: F.array(
        x["0"], run(x, "0", "1"), run(x, "0", "1", "2"), run(x, "3", "0"), run(x, "3", "0", "1")))))


def scan_licenses(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.6, margin: float = 0.02) -> DataFrame:
    """The licence of each file of a media library: its own, or that of the nearest folder above.

    ``files``: ``media_id``, ``media_path`` ('/' between folders), ``text``; other columns are left out. A licence file (by
    its name) is compared as a whole and by its notices, any other file by its notices alone, see ``notice_runs``.
    The best cosine of at least ``least`` names the licence of a notice if it leads the next licence by ``margin``: a notice that says
    as much for one as for another (a public licence without its version) names none. Of the notices of a file the
    best one counts; ties go to the smaller name. A licence file speaks for
    its folder and all below; of several in a folder the best match, then the smaller path. Files without a notice take
    the licence of the deepest such folder. Result, one row per input row: ``media_id``, ``media_path``, ``license``,
    ``score`` (null unless own), ``origin`` ('own', 'inherited' or null), ``license_path`` (file that it comes from).
    Null path: no folder, so nothing is inherited. Null or empty text: no notice. Repeated rows get equal results.

    Words of notices alone meet the templates, which are broadcast: their size is that of the list. Folders are
    resolved once each and joined to the files, so a folder with most files is one row of one side.
    """
    vectors = template_weights(files.sparkSession, templates)
    given = files.select("media_id", F.col("media_path").cast("string").alias("media_path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    name = F.substring_index("media_path", "/", -1)
    folder = F.when(F.col("media_path").contains("/"), F.regexp_replace("media_path", r"/[^/]*$", "")).otherwise(F.lit(""))
    keyed = given.withColumns({"file_key": F.xxhash64("text"), "is_license": F.coalesce(name.rlike(_FILE), F.lit(False)), "folder": F.when(F.col("media_path").isNotNull(), folder)})
    # Texts of licence files count as a whole too; the scan drops all other lines before any shuffle.
    lines = notice_runs(F.col("text"))
    notices = F.when(F.col("is_license"), F.array_append(lines, F.regexp_replace("text", "\n", " "))).otherwise(lines)
    noticed = keyed.where(F.col("text").rlike(_HINT) | F.col("is_license"))
    # Equal notices are weighed once, however many files hold one.
    held = noticed.select("media_id", "media_path", "file_key", "is_license", "folder", F.explode(notices).alias("run")).withColumn(
        "notice", F.md5("run")).distinct()  # a digest stands for a notice, so that no word of a long one carries all its text
    words = held.select("notice", "run").dropDuplicates(["notice"]).select("notice", F.explode(_words(F.col("run"))).alias("word")).groupBy("notice", "word").agg(F.count(F.lit(1)).alias("tf"))
    idf = F.broadcast(vectors.select("word", "idf").distinct())
    rare = math.log(1.0 + len(templates)) + 1.0  # idf of a word of no template
    weighed = words.join(idf, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    norms = weighed.groupBy("notice").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(vectors.select("license", "template", "word", "weight")), "word").groupBy("notice", "license", "template").agg(
        F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = dots.join(norms, "notice").select("notice", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= least)
    # At most as many scores per notice as there are licences; the two highest decide.
    scored = cosine.groupBy("notice", "license").agg(F.max("score").alias("score")).groupBy("notice").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "license"))).alias("by"))
    second = F.get("by", F.lit(1))["s"]
    matched = scored.where(second.isNull() | (second - F.get("by", F.lit(0))["s"] >= margin - 1e-12)).select("notice", F.get("by", F.lit(0)).alias("m"))
    own = held.join(matched, "notice").groupBy("media_id", "media_path", "file_key", "is_license", "folder").agg(F.min("m").alias("m"))
    speaking = own.where("is_license AND folder IS NOT NULL").groupBy("folder").agg(F.min(F.struct(F.col("m.s").alias("s"), "media_path", F.col("m.license").alias("license"))).alias("f"))
    # Each folder and those above it, the root among them; the deepest that has a licence.
    folders = keyed.where("folder IS NOT NULL").select("folder").distinct()
    parts = F.split("folder", "/", -1)
    above = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("up", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    inherited = above.join(speaking.withColumnRenamed("folder", "up"), "up").groupBy("folder").agg(F.max_by("f", F.col("depth")).alias("f"))
    o = own.select("media_id", "media_path", "file_key", "m").alias("o")
    base = keyed.select("media_id", "media_path", "file_key", "folder").alias("k")
    same = F.col("k.media_id").eqNullSafe(F.col("o.media_id")) & F.col("k.media_path").eqNullSafe(F.col("o.media_path")) & (F.col("k.file_key") == F.col("o.file_key"))
    with_own = base.join(o, same, "left").select("k.media_id", "k.media_path", "k.folder", "o.m")
    joined = with_own.join(inherited, "folder", "left")
    is_own = F.col("m").isNotNull()
    return joined.select(
        "media_id", "media_path", F.coalesce(F.col("m.license"), F.col("f.license")).alias("license"), (-F.col("m.s")).alias("score"),
        F.when(is_own, "own").when(F.col("f").isNotNull(), "inherited").alias("origin"),
        F.when(is_own, F.col("media_path")).otherwise(F.col("f.media_path")).alias("license_path"))
