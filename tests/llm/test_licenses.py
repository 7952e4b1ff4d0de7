import math
import pathlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from blockloom.llm import licenses
from blockloom.llm.common import shared_dir, table

MIT = """The MIT License (MIT)

Copyright (c) 2021 Somebody Else

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL_HEADER = """/*
 * A tool of ours.
 *
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 */
int main() { return 0; }
"""
APACHE = """# Copyright 2020 Them
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
"""
ROWS = [
    ("a/LICENSE", MIT),
    ("a/b/x.txt", "no statement here, the license of that is under it"),
    ("a/b/c/COPYING.md", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nEveryone is permitted to copy"),
    ("a/b/c/d/y.txt", ""),
    ("a/b/z.txt", "text\n\n# LICENSED under CC BY-NC 4.0"),
    ("a/b/v.txt", "Some prose comes before. Released under the MIT License. And some after it, all in a line."),
    ("a/b/c/main.c", GPL_HEADER),
    ("top.txt", None),
    ("a2/q.txt", "word " * 100000 + "license"),
    ("a/b/x.txt", "no statement here, the license of that is under it"),
    (None, "Licensed under the Apache License, Version 2.0."),
    (None, "nothing"),
    ("e/COPYING", "nothing here"),
    ("e/f", "x"),
    ("s/a.py", "# SPDX-License-Identifier: Apache-2.0\nimport os"),
    ("s/b.py", "# SPDX-License-Identifier: GPL-3.0-or-later\n\nimport os"),
    ("s/c.py", APACHE + "import os"),
    ("s/d.txt", "Apache License\nVersion 2.0, January 2004"),
]


def scan(spark, rows):
    files = spark.createDataFrame([(p, t, 1) for p, t in rows], "path string, text string, paragraph int")
    return licenses.scan(files, F.col("path"), F.col("text"), ["text"])


def test_own_and_nearest(spark):
    got = sorted(((r.path or "", r.license, r.inherited, r.license_file, r.paragraph) for r in scan(spark, ROWS).collect()), key=str)
    mit, gpl = ("MIT", True, "a/LICENSE", None), ("GPL-3.0", True, "a/b/c/COPYING.md", None)
    none = (None, False, None, None)
    want = [("a/LICENSE", "MIT", False, None, 2), ("a/b/x.txt", *mit), ("a/b/x.txt", *mit), ("a/b/c/COPYING.md", "GPL-3.0", False, None, 0), ("a/b/c/d/y.txt", *gpl), ("a/b/z.txt", "CC-BY-NC-4.0", False, None, 1)]
    want += [("a/b/v.txt", "MIT", False, None, 0), ("a/b/c/main.c", "GPL-2.0", False, None, 0), ("s/a.py", "Apache-2.0", False, None, 0), ("s/b.py", "GPL-3.0", False, None, 0), ("s/c.py", "Apache-2.0", False, None, 0), ("s/d.txt", "Apache-2.0", False, None, 0)]
    want += [("top.txt", *none), ("a2/q.txt", *none), ("", "Apache-2.0", False, None, 0), ("", *none), ("e/COPYING", *none), ("e/f", *none)]
    assert [g[:4] for g in got if g[0] == "a/LICENSE"] == [("a/LICENSE", "MIT", False, None)]
    assert [g for g in got if g[0] != "a/LICENSE"] == sorted([w for w in want if w[0] != "a/LICENSE"], key=str)


def test_cosine_same_as_in_full(spark):
    w = licenses.Weights()
    said = [s for some in licenses.TEMPLATES.values() for s in some] + ["License License apache version 2.0 2.0", "under the terms of the license", "released released under the mit license, and more words here", *(t for _, t in ROWS if t and len(t) < 5000)]

    def cosine(text):
        tf = Counter(re.findall(licenses.PLAIN_WORDS, text.lower()))
        a = {x: n.bit_length() * w.idf.get(x, w.rare) for x, n in tf.items()}
        size = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return max((sum(a.get(x, 0) * y for x, y in v.items()) / size(a) / size(v) for _, v in w.vectors), default=0) if a else 0

    want = []
    for s in said:
        pieces = set()
        for p in re.split(r"\n[ \t\r]*\n[ \t\r\n]*", s):
            flat = re.sub(r"[ \t\r]*\n[ \t\r]*", " ", p)
            pieces |= {p, *p.split("\n"), *re.sub(r"([.!?])[ \t]+([A-Z])", "\\1\x01\\2", flat).split("\x01")}
        score = max(map(cosine, pieces))
        want.append(round(score, 9) if score >= licenses.LEAST else None)
    got = {r.path: r.score for r in scan(spark, [(f"{k}/f", s) for k, s in enumerate(said)]).collect()}
    assert [got[f"{k}/f"] and round(got[f"{k}/f"], 9) for k in range(len(said))] == want
    assert all(want[: -len(ROWS)][: sum(map(len, licenses.TEMPLATES.values()))])


def test_some_documents_inherit(spark):
    got = licenses.op6_licenses(table(spark, "/root/testdata/sf0.001", "documents")).collect()
    assert any(r.inherited and r.license for r in got) and any(r.license and not r.inherited for r in got) and any(r.license is None for r in got)


def test_empty(spark, documents):
    assert licenses.op6_licenses(documents([])).collect() == []
    assert [r.license for r in licenses.op6_licenses(documents([(None, None, None, None)])).collect()] == [None]


def test_words_are_counted_once_and_bound_the_cosine(spark):
    weights, draw = licenses.Weights(), random.Random(6)
    some = [*list(weights.idf)[::9], "zebra", "quux", "naïve"]
    rows = [[], ["zebra"], *[[draw.choice(some) for _ in range(draw.randrange(1, 60))] for _ in range(60)], [*(some * 40), *["license"] * 5000]]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(rows)], "k int, words array<string>")
    found = df.select("k", licenses.counted(F.col("words")).alias("n"), licenses.mostly_known(F.col("words"), weights, 0.75).alias("near")).collect()
    for r in found:
        n = Counter(rows[r.k])
        assert (r.n or {}) == n
        mass = sum((c.bit_length() * weights.idf[w]) ** 2 for w, c in n.items() if w in weights.idf)
        others = sum(w not in weights.idf for w in n) * weights.rare**2
        if n:
            assert r.near == (mass * (1 - 0.75**2) >= others * (0.75**2 * 0.999))
    assert {r.near for r in found if rows[r.k]} == {True, False}


def test_only_the_rows_of_the_result_stay_stored(spark):
    files = spark.createDataFrame([("a/LICENSE", MIT), ("a/b/x", "nothing"), (None, None)], "path string, text string")
    folder = pathlib.Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("*")) if folder.exists() else set()
    found = licenses.scan(files, F.col("path"), F.col("text"), [])
    assert [p.name.split("-")[0] for p in set(folder.glob("*")) - before] == ["own"]
    assert {(r.path, r.license, r.inherited) for r in found.collect()} == {("a/LICENSE", "MIT", False), ("a/b/x", "MIT", True), (None, None, False)}
