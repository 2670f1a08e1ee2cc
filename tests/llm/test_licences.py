import math

from tallystone.llm import licences
from tallystone.llm.queries import op3_licence_scans
from tests.llm.fixtures import ROWS, awkward, empty
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


def test_query_matches_sql(spark):
    assert differences(op3_licence_scans(spark, SF), licences.oracle(), SF) == []


def test_inheritance(spark):
    mit, gpl = licences.TEMPLATES["MIT"], licences.TEMPLATES["GPL-3.0"]
    plain = "int main() { return 0; } // nothing about it here"
    rows = [
        ("/a/LICENSE", mit), ("/a/b/c/x.c", plain), ("/a/b/LICENSE", gpl), ("/a/b/y.c", plain), ("/a/z.c", plain),
        ("/q/own.c", plain * 20 + "\n" + gpl), ("/q/other.c", plain), (None, plain), ("/a/dup.c", plain), ("/a/dup.c", plain), ("root.txt", plain),
    ]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r for r in licences.scan(df).collect()}
    assert got["/a/b/c/x.c"].licence == "GPL-3.0" and got["/a/b/c/x.c"].inherited_from == "/a/b"
    assert got["/a/z.c"].licence == "MIT" and got["/a/LICENSE"].is_licence_file
    assert got["/q/own.c"].own_licence == "GPL-3.0" and not got["/q/own.c"].is_licence_file
    assert got["/q/other.c"].licence is None and got[None].licence is None
    assert licences.scan(df).count() == len(rows)


def test_headers_tags_names_and_relative_paths(spark):
    plain = "int main() { return 0; }"
    wrap = lambda text: "/*\n" + "\n".join(" * " + " ".join(text.split()[i : i + 8]) for i in range(0, len(text.split()), 8)) + "\n *\n */\n"
    rows = [(f"h/{name}.c", wrap("Copyright 2020 A. Writer") + wrap(t) + plain * 30) for name, t in licences.HEADERS.items()]
    rows += [
        ("LICENSE", licences.full_texts()["MIT"]), ("a.py", plain), ("deep/er/b.py", plain), ("c/COPYING", "all rights reserved by nobody"), ("c/x.c", plain),
        ("d/c.py", "# " + licences.TEMPLATES["Apache-2.0"]), ("d/e.py", plain), ("f/mit.c", "/*\n" + licences.full_texts()["MIT"] + "*/\nint x;"), ("f/g.c", plain),
        ("s/tag.c", "// SPDX-License-Identifier: EUPL-1.2\n" + plain),
    ]
    plain_rows = [(f"/p{i}/x.c", f"the loop {i} adds the values of a list and of the other to any of them") for i in range(50)]
    got = {r.path: r for r in licences.scan(spark.createDataFrame(rows + plain_rows, "path string, text string")).collect()}
    for name in licences.HEADERS:
        assert got[f"h/{name}.c"].own_licence == name and not got[f"h/{name}.c"].is_licence_file
    assert got["LICENSE"].is_licence_file and got["a.py"].licence == "MIT" and got["a.py"].inherited_from == "" and got["deep/er/b.py"].licence == "MIT"
    assert got["c/COPYING"].licence is None and got["c/x.c"].licence == "MIT"  # a licence file never inherits
    assert got["d/c.py"].own_licence == "Apache-2.0" and not got["d/c.py"].is_licence_file and got["d/e.py"].licence == "MIT"
    assert got["f/mit.c"].own_licence == "MIT" and not got["f/mit.c"].is_licence_file
    assert got["s/tag.c"].own_licence == "EUPL-1.2" and got["s/tag.c"].own_score == 1.0


def test_everyday_words_weigh_what_the_corpus_says(spark):
    line = "This program is licensed under the GNU General Public License, version 3."
    rows = [(i, f"the program is version {i} of a general work licensed to this public") for i in range(3000)]
    df = spark.createDataFrame([(str(i), t) for i, t in [*rows, (3000, line)]], "path string, text string")
    got = {r.path: r for r in licences.scan(df).where("path = '3000'").collect()}["3000"]
    words = {t: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()] for t in [line, licences.TEMPLATES["GPL-3.0"], *[t for _, t in rows]]}
    texts = [set(words[t]) for t in [*[t for _, t in rows], line]]
    idf = lambda w: math.log(1 + len(texts) / max(1, sum(w in t for t in texts)))
    a, b = ({w: words[t].count(w) * idf(w) for w in words[t]} for t in (line, licences.TEMPLATES["GPL-3.0"]))
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    assert got.own_licence == "GPL-3.0" and abs(got.own_score - sum(a[w] * b.get(w, 0) for w in a) / norm(a) / norm(b)) < 1e-5


def test_full_texts_are_licence_files(spark):
    texts = licences.full_texts()
    plain = [(f"/p{i}/x.c", f"the loop {i} adds the values of a list and of the other to any of them") for i in range(50)]
    rows = [row for name, t in texts.items() for row in ((f"/{name}/LICENSE", "Copyright (c) 2020 A. Writer\n\n" + t), (f"/{name}/src/x.c", "int x;"))]
    rows.append(("/wrapped/COPYING", "\n".join("# " + w for w in texts["MIT"].split())))
    got = {r.path: r for r in licences.scan(spark.createDataFrame(rows + plain, "path string, text string")).collect()}
    for name in texts:
        assert got[f"/{name}/LICENSE"].own_licence == name and got[f"/{name}/LICENSE"].is_licence_file
        assert got[f"/{name}/src/x.c"].licence == name and got[f"/{name}/src/x.c"].inherited_from == f"/{name}"
    assert got["/wrapped/COPYING"].own_licence == "MIT" and all(got[p].licence is None for p, _ in plain)


def test_what_was_labelled_wrongly(spark):
    """Headers with code right behind, unknown notices, expressions, notices in long lines, and a retitled licence text."""
    code = "int main() { return 0; } // nothing about it here\n" * 40
    gpl2 = licences.HEADERS["GPL-2.0"]
    agpl = licences.full_texts()["GPL-3.0"].replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", 1)
    rows = [
        ("/a/LICENSE", licences.full_texts()["MIT"]), ("/a/gpl.c", "/* " + gpl2 + "\n" + code + "*/"), ("/a/bsd.c", "// Use of this source code is governed by a BSD-style license\n// that can be found in the LICENSE file.\n" + code),
        ("/a/or.c", "// SPDX-License-Identifier: (MIT OR Apache-2.0)\n" + code), ("/a/plain.c", "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */\n" + code), ("/a/brackets.c", "(SPDX-License-Identifier: MIT)"),
        ("/a/nested.c", "# SPDX-License-Identifier: MIT AND (BSD-3-Clause OR Zlib)\n"), ("/a/line.txt", "the loop adds the values " * 60 + licences.TEMPLATES["Apache-2.0"] + " and others of the list" * 60), ("/b/COPYING", agpl), ("/b/x.c", code), ("/a/free.c", code),
        ("/a/head.c", "x\n" * 60 + "the license of this is unknown"), ("/a/text.c", "/*\n" + licences.full_texts()["ISC"] + "*/\n" + code * 10),
    ]
    plain = [(f"/p{i}/x.c", f"the loop {i} adds the values of a list and of the other to any of them") for i in range(50)]
    df = spark.createDataFrame(rows + plain, "path string, text string")
    for name in ("best", "is_file", "in_lines", "__dir", "__salt", "__row", "__text", "w", "n", "i"):
        df = df.withColumn(name, licences.F.lit("mine"))
    got = {r.path: r for r in licences.scan(df).collect()}
    assert got["/a/gpl.c"].own_licence == "GPL-2.0"
    assert got["/a/bsd.c"].licence is None and got["/a/bsd.c"].inherited_from is None
    assert got["/a/or.c"].licence == "MIT OR Apache-2.0" and got["/a/plain.c"].licence == "GPL-2.0-only WITH Classpath-exception-2.0"
    assert got["/a/brackets.c"].licence == "MIT" and got["/a/nested.c"].licence == "MIT AND (BSD-3-Clause OR Zlib)"
    assert got["/a/line.txt"].own_licence == "Apache-2.0" and not got["/a/line.txt"].is_licence_file
    assert got["/b/COPYING"].licence == "AGPL-3.0" and got["/b/x.c"].licence == "AGPL-3.0"
    assert got["/a/free.c"].licence == "MIT" and got["/a/head.c"].licence == "MIT" and got["/a/text.c"].own_licence == "ISC"
    assert all(r["best"] == r["__row"] == r["__dir"] == "mine" for r in got.values())


def test_awkward(spark):
    assert licences.report(awkward(spark)).count() == len(ROWS)
    assert licences.report(empty(spark)).count() == 0
