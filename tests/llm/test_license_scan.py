from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from kgspark.llm import license_scan as s

FILES = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/x.txt", "Plain prose without any statement."),
    (3, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
    (4, "a/b/c/d/y.txt", "More prose."),
    (5, "a/b/c/d/z.txt", "Prose.\nLicensed under the Apache License, Version 2.0."),
    (6, "w.txt", "Prose of the root."),
    (7, None, "Prose without a path."),
    (7, None, "Prose without a path."),
    (8, "a/b/empty.txt", None),
]


def scan(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, file string, text string").withColumn("path", F.lit("clash")).withColumn("term", F.lit("clash"))
    return {r.doc_id: r for r in s.license_scan(df, F.col("file")).collect()}


def test_nearest_ancestor(spark):
    got = {k: (r.license, r.origin, r.license_dir) for k, r in scan(spark, FILES).items()}
    assert got == {
        1: ("MIT", "file", None),
        2: ("MIT", "inherited", "a"),
        3: ("GPL-3.0", "file", None),
        4: ("GPL-3.0", "inherited", "a/b/c"),
        5: ("Apache-2.0", "header", None),
        6: (None, None, None),
        7: (None, None, None),
        8: ("MIT", "inherited", "a"),
    }
    assert scan(spark, []) == {}


def test_cosine_is_that_of_a_loop(spark):
    texts = [t for notices in s.TEMPLATES.values() for t in notices] + ["Licensed, perhaps, under some public licence.", "Released under the MIT License and more."]

    def vector(text, idf, rare):
        w = re.findall(s._TERM, text.lower())
        c = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
        v = {t: n * idf.get(t, rare) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    notices = [(name, t) for name, x in s.TEMPLATES.items() for t in x]
    df = Counter(t for _, text in notices for t in vector(text, {}, 1.0))
    idf = {t: math.log((len(notices) + 1) / (n + 1)) + 1 for t, n in df.items()}
    rare = math.log(len(notices) + 1) + 1
    got = {r.unit: (r.license, r.score) for r in s.stated(spark.createDataFrame([(t, t) for t in texts], "unit string, text string"), least=0.0).collect()}
    for text in texts:
        v = vector(text, idf, rare)
        best = min((-round(sum(x * u.get(t, 0) for t, x in v.items()), 9), name) for name, u in ((n, vector(x, idf, rare)) for n, x in notices))
        assert got[text][0] == best[1] and abs(got[text][1] + best[0]) < 1e-8


def test_query_covers_every_document(spark, sf, texts):
    rows = s.op5_license_scan(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        stated = any(n[0] in (texts[r.doc_id] or "") for n in s.TEMPLATES.values())
        assert not stated or r.origin in ("header", "file")


MIT = """MIT License

Copyright (c) 2021 Jane Roe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_whole_licence_files(spark):
    whole = {"MIT": MIT} | {name: f"Copyright 2019 The {name} Authors\n\n{' '.join(text.split())}\n\nAll rights not granted are kept." for name, text in s.TEXTS.items() if name != "MIT"}
    rows = [(i, f"d{i}/LICENSE", text) for i, text in enumerate(whole.values())] + [(100 + i, f"d{i}/src/x.txt", "Prose.") for i in range(len(whole))]
    got = scan(spark, rows)
    assert {name: got[i].license for i, name in enumerate(whole)} == {name: name for name in whole}
    assert [(got[100 + i].license, got[100 + i].origin) for i in range(len(whole))] == [(name, "inherited") for name in whole]


def test_notices_of_near_names(spark):
    lines = {"Released under the BSD 2-Clause License.": "BSD-2-Clause", "Licensed under GNU Affero GPL version 3.": "AGPL-3.0", "Licensed under the ISC license": "ISC", "Released under the BSD License.": "BSD-3-Clause"}
    got = {r.unit: r.license for r in s.stated(spark.createDataFrame([(t, t) for t in lines], "unit string, text string")).collect()}
    assert got == lines


def test_documents_that_begin_as_a_licence_are_licence_files(spark, tmp_path):
    spark.createDataFrame([(1, MIT, "src"), (2, "Prose.", "src"), (3, s.TEXTS["GPL-3.0"] + "\nEnd", "other")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.license, r.origin) for r in s.op5_license_scan(spark, str(tmp_path)).collect()}
    assert got == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("GPL-3.0", "file")}


def test_common_headers(spark):
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\nimport os\n"
    heads = {
        "# SPDX-License-Identifier: MIT\nimport os\n": "MIT",
        "// SPDX-License-Identifier: Apache-2.0\nint x;\n": "Apache-2.0",
        "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;\n": "GPL-2.0",
        gpl: "GPL-3.0",
        "// Copyright 2009 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\npackage x\n": "BSD-3-Clause",
        "Prose about nothing.\nIt says that a licence is a fine thing to have.\n": None,
    }
    got = scan(spark, [(i, f"s/{i}.txt", text) for i, text in enumerate(heads)])
    assert [got[i].license for i in range(len(heads))] == list(heads.values())


def test_inheritance_equals_a_loop_over_a_random_tree(spark):
    """Long paths, repeated rows, null doc_ids, very long texts and a root that is a hot directory."""
    rng = random.Random(4)
    dirs = [""] + ["/".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    licences = {d: rng.choice(["Released under the MIT License.", "Licensed under the ISC License.", "No statement."]) for d in sorted(set(dirs)) if rng.random() < 0.5}
    rows = [(None if i % 50 == 0 else i, f"{d}/LICENSE" if d else "LICENSE", text) for i, (d, text) in enumerate(licences.items())]
    plain = [(1000 + i, f"{d}/f{i}.txt" if d else f"f{i}.txt", "Prose. " * (40_000 if i == 3 else 1)) for i, d in enumerate(rng.choices(dirs, k=400))]
    rows += plain + plain[:5]
    names = {"Released under the MIT License.": "MIT", "Licensed under the ISC License.": "ISC"}
    given = {d: names[t] for d, t in licences.items() if t in names}

    def of(path):
        at = path.rpartition("/")[0]
        while True:
            if at in given:
                return given[at]
            if not at:
                return None
            at = at.rpartition("/")[0]

    df = spark.createDataFrame(rows, "doc_id long, file string, text string")
    got = sorted((r.path, r.license or "") for r in s.license_scan(df, F.col("file")).collect())
    assert got == sorted((path, (names.get(text) or of(path)) or "") for _, path, text in rows)
