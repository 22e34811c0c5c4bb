"""5. Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory. Native.

Headers are lines with a licence cue, and the blocks (up to a blank line) that such lines stand in, each as one; a licence
file is compared as one text. Templates are notices, standard headers, SPDX lines, and the whole texts of the folder
``licences``. Texts move once, to be made distinct; from there on a unit is its MD5. A notice of a third of all files and a
directory above a third of them are hot keys, and are joined by ``joined``. Terms are words and word pairs, weighted by
their rarity among the templates; each text goes to the template of the largest cosine of at least LEAST. The templates'
weights are a table of fixed size, which is broadcast. A file that states no licence takes that of the nearest directory
above it with a licence file: its directories, one row each, join the licensed directories by path.

Defined results: a null or empty text states nothing; a null path has no directories and inherits nothing; ties between
templates go to the first name, between licence files of one directory to the first path; null doc_ids and repeated rows
are scanned as rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import documents, joined, stored, table

LEAST = 0.5
CUE = "(?i)licen[sc]e|copyright|permission is|warrant|redistribut|spdx|creative commons|public domain|\\bCC[ -]BY"
FILE = "(?i)(?:^|/)(?:licen[sc]e|copying|notice|unlicense)[^/]*$"
#: The beginning of a text that is a whole licence: titles and copyright lines, then its first words or its title.
WHOLE = (
    "(?i)^\\s*(?:[^\\n.]{0,60}licen[sc]e[^\\n.]{0,40}\\n\\s*|copyright[^\\n]{0,200}\\n\\s*|all rights reserved\\.?\\s*\\n\\s*)*"
    "(?:permission is hereby granted, free|permission to use, copy, modify|redistribution and use in source and binary|this is free and unencumbered"
    "|this software is provided 'as-is'|(?:gnu )?(?:(?:affero|lesser|library) )?(?:general public|free documentation) licen[sc]e\\s+version|apache licen[sc]e\\s+version"
    "|mozilla public licen[sc]e,?\\s+version|eclipse public licen[sc]e - v|creative commons legal code|(?:gnu )?(?:affero |lesser |library )?general public licen[sc]e\\s*\\n)"
)
#: Notices by which works state their licence.
NOTICES = {
    "0BSD": ["Licensed under the BSD Zero Clause License.", "Released under the Zero-Clause BSD License (0BSD)."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero GPL version 3 (AGPL)."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the Simplified BSD License."],
    "BSD-3-Clause": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted.", "Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under Creative Commons Attribution."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under Creative Commons Attribution NonCommercial."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Licensed under Creative Commons Attribution ShareAlike."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "Dedicated to the public domain under Creative Commons Zero."],
    "EPL-1.0": ["Licensed under the Eclipse Public License, version 1.0."],
    "EPL-2.0": ["Licensed under the Eclipse Public License, version 2.0."],
    "GFDL-1.3": ["Licensed under the GNU Free Documentation License, version 1.3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["Licensed under the ISC License."],
    "LGPL-2.0": ["This library is licensed under the GNU Library General Public License, version 2."],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "MPL-1.1": ["This file is subject to the terms of the Mozilla Public License, version 1.1."],
    "MPL-2.0": ["This file is subject to the terms of the Mozilla Public License, version 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["Licensed under the zlib License."],
}
#: Standard headers of several lines.
HEADERS = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
}
for _name, _program, _license, _version in (
    ("AGPL-3.0", "program", "GNU Affero General Public License", "version 3"),
    ("GPL-2.0", "program", "GNU General Public License", "version 2"),
    ("GPL-3.0", "program", "GNU General Public License", "version 3"),
    ("LGPL-2.1", "library", "GNU Lesser General Public License", "version 2.1"),
    ("LGPL-3.0", "library", "GNU Lesser General Public License", "version 3"),
):
    HEADERS[_name] = f"This {_program} is free software: you can redistribute it and/or modify it under the terms of the {_license} as published by the Free Software Foundation, either {_version} of the License, or (at your option) any later version."


def _identifiers(name: str) -> list[str]:
    """SPDX lines of a template; those of the GNU licences say whether later versions count too."""
    ends = ("", "-only", "-or-later") if "GPL" in name or "GFDL" in name else ("",)
    return [f"SPDX-License-Identifier: {name}{end}" for end in ends]


#: Whole texts, without their copyright lines.
TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
TEMPLATES = {name: [*notices, *([HEADERS[name]] if name in HEADERS else []), *_identifiers(name), *([TEXTS[name]] if name in TEXTS else [])] for name, notices in NOTICES.items()}
_TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


def terms(text: Column) -> Column:
    """Words and word pairs, lower-cased."""
    w = F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))

    def both(w: Column) -> Column:
        pairs = F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
        return F.array_compact(F.concat(w, pairs))

    return F.flatten(F.transform(F.array(w), both))  # one element, so that the words are split once


def _weights(templates: dict[str, list[str]]) -> tuple[list[tuple[str, str, float, float]], float]:
    """Rows (template#notice, term, idf, weight in the normalized template) and the idf of terms in no template."""
    counts = {}
    for name, text in ((f"{name}#{i}", text) for name, texts in templates.items() for i, text in enumerate(texts)):
        w = re.findall(_TERM, text.lower())
        counts[name] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    n = len(counts)
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((n + 1) / (k + 1)) + 1 for t, k in df.items()}
    rows = []
    for name, c in counts.items():
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in c.items()))
        rows += [(name, t, idf[t], k * idf[t] / norm) for t, k in c.items()]
    return rows, math.log(n + 1) + 1


def stated(units: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """unit, license, score: the best template of each unit (columns unit, text) that reaches ``least``."""
    spark = units.sparkSession
    rows, rare = _weights(templates or TEMPLATES)
    known = F.broadcast(spark.createDataFrame([(t, i) for t, i in {r[1]: r[2] for r in rows}.items()], "term string, idf double"))
    vectors = F.broadcast(spark.createDataFrame([(t, n, w) for n, t, _, w in rows], "term string, license string, w double"))
    tf = units.select("unit", F.explode(terms(F.col("text"))).alias("term")).groupBy("unit", "term").count()
    tf = tf.join(known, "term", "left").withColumn("w", F.col("count") * F.coalesce("idf", F.lit(rare)))
    norm = tf.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = tf.select("unit", "term", F.col("w").alias("own")).join(vectors, "term").groupBy("unit", "license").agg(F.sum(F.col("own") * F.col("w")).alias("dot"))
    score = F.round(F.col("dot") / F.col("norm"), 9)
    best = dot.join(norm, "unit").select("unit", F.struct((-score).alias("s"), F.substring_index("license", "#", 1).alias("license")).alias("x")).groupBy("unit").agg(F.min("x").alias("x"))
    return best.select("unit", F.col("x.license").alias("license"), (-F.col("x.s")).alias("score")).where(F.col("score") >= least)


def license_scan(files: DataFrame, path: Column, is_file: Column | None = None, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, path, license, score, origin ('header', 'file' or 'inherited'), license_dir for every row of ``files``.

    ``is_file`` says which rows are licence files (by default those named like one); the licence a licence file states is
    that of its directory and of all below without a nearer one.
    """
    rows = documents(files.select("doc_id", "text", path.alias("_path")), F.col("_path").alias("path"))
    is_file = F.coalesce(F.rlike(F.col("path"), F.lit(FILE)), F.lit(False)) if is_file is None else is_file
    rows = rows.withColumn("licence_file", is_file)
    cued = F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(CUE)))
    blocks = F.filter(F.split("text", "\n\\s*\n"), lambda b: F.contains(F.trim(b), F.lit("\n")) & F.rlike(b, F.lit(CUE)))
    cued = F.concat(cued, blocks)
    headers = F.when(F.col("licence_file"), F.array("text")).when(F.rlike("text", F.lit(CUE)), cued).otherwise(F.array().cast("array<string>"))
    row = F.xxhash64("doc_id", "path", "headers")
    # The texts are read once; what follows uses the headers alone.
    rows = rows.withColumn("headers", F.array_distinct(headers)).select("doc_id", "path", "licence_file", "headers", row.alias("row"))
    rows = stored(rows, "headers")
    # Equal headers are scored once: most documents that state a licence state it in the same words.
    name = F.unhex(F.md5("text"))
    texts = rows.select(F.explode("headers").alias("text")).groupBy(name.alias("unit")).agg(F.first("text").alias("text"))
    best = stored(stated(texts, templates, least), "scored")
    said = stored(rows.select("row", F.explode("headers").alias("text")).select("row", name.alias("unit")), "said")
    own = joined(said, best, "unit", sizes=said.groupBy("unit").agg(F.count("*").alias("n")))
    own = own.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("x")).select("row", F.col("x.license").alias("own"), (-F.col("x.s")).alias("score"))
    rows = stored(rows.drop("headers").join(own, "row", "left"), "licensed")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    given = rows.where("licence_file and own is not null and path is not null").groupBy(folder.alias("dir")).agg(F.min(F.struct("path", "own", "score")).alias("x"))
    given = given.select("dir", F.col("x.own").alias("theirs"), F.col("x.score").alias("their_score"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    given = stored(given, "given")
    bare = rows.where("own is null and path is not null").select("path").distinct().select("path", F.explode(above).alias("dir"))
    bare = stored(bare, "above")
    nearest = joined(bare, given, "dir", sizes=bare.groupBy("dir").agg(F.count("*").alias("n"))).groupBy("path").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "theirs", "their_score")).alias("x"))
    rows = rows.join(nearest.withColumnRenamed("x", "up"), "path", "left")
    header = F.col("own").isNotNull()
    return rows.select(
        "doc_id", "path",
        F.coalesce("own", "up.theirs").alias("license"), F.coalesce("score", "up.their_score").alias("score"),
        F.when(header & F.col("licence_file"), "file").when(header, "header").when(F.col("up.theirs").isNotNull(), "inherited").alias("origin"),
        F.when(~header, F.col("up.dir")).alias("license_dir"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source: source/<thousands>/<doc_id>. A document that is little but a licence notice,
    or a whole licence, stands for its directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    notice = F.rlike("text", F.lit(CUE)) & ((F.length("text") <= 600) | F.rlike("text", F.lit(WHOLE)))
    return license_scan(docs, path, notice)
