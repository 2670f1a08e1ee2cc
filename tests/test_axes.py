"""Bodies by tags, tables by reference, prior matrices, closure along two axes, chunks, and the cache of annotations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallystone.operators import audit, retrieval, statements
from tallystone.sinks import cache
from tallystone.sources import markup


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def body_by_scan(html, mark, tag="div"):
    at = html.find(mark)
    begin = html.find(">", at) + 1
    if at < 0 or begin == 0:
        return ""
    depth = 1
    for m in re.finditer(rf"(?i)<{tag}(?![a-zA-Z0-9-])|</{tag}\s*>", html[begin:]):
        depth += -1 if m.group().startswith("</") else 1
        if depth == 0:
            return html[begin : begin + m.start()]
    return ""


def test_bodies_by_balanced_tags(spark):
    rng = random.Random(3)
    parts = ["<div>", "</div>", "<DIV a='1'>", "</div >", "<divide>", "<br>", "<div/>", "text", "<p>", ">", 'class="m"', "<div class=\"m\">", "<div"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["", '<div class="m"', '<div class="m"></div>', '<div class="m">a<div>b</div>c</div>d']
    df = spark.createDataFrame([(p,) for p in pages], "h string").coalesce(1)
    assert [r[0] for r in df.select(markup.balanced(F.col("h"), 'class="m"')).collect()] == [body_by_scan(p, 'class="m"') for p in pages]
    assert spark.createDataFrame([(None,)], "h string").select(markup.article_body(F.col("h"))).first()[0] is None


def test_marks_are_tried_in_order(spark):
    pages = ['<div class="trs_editor_view x">b</div><div class="pages_content">a</div>', '<div class="trs_editor_view x">b</div>', '<div class="pages_content">never closed<div class="trs_editor_view">b</div>', "<div>none</div>"]
    df = spark.createDataFrame([(p,) for p in pages], "h string").coalesce(1)
    assert [r[0] for r in df.select(markup.article_body(F.col("h"))).collect()] == ["a", "b", "", ""]
    mains = ['<body><div class="theme vp-doc">x</div><article>y</article></body>', "<body><articles>n</articles><article><article>y</article></article></body>", "<body>z<main>", "none"]
    df = spark.createDataFrame([(p,) for p in mains], "h string").coalesce(1)
    assert [r[0] for r in df.select(markup.main_content(F.col("h"))).collect()] == ["x", "<article>y</article>", "", ""]


def test_readable_text(spark):
    html = '<header>h</header><script>var a="<p>";</script><h1> 标题 </h1><p>甲&amp;lt;乙<br>丙</p><ul><li>one</li><li><b>two</b></li></ul><!-- <p>c</p> --><p>end&nbsp;</p>'
    assert spark.createDataFrame([(html,)], "h string").select(markup.readable(F.col("h"))).first()[0] == "# 标题\n\n甲&lt;乙\n丙\n\n- one\n- two\n\nend"


def test_prior_matrices_by_pairs(spark):
    rng = random.Random(4)
    make = lambda n, first: [(rng.randint(1, 3), first + i, rng.choice([None, 2019, 2020, 2021]), rng.randint(3, 9)) for i in range(n)]
    mains, others = make(40, 1000), make(40, 0)
    schema = "d int, k int, y int, w int"
    got = statements.prior_matrices(spark.createDataFrame(mains, schema), spark.createDataFrame(others, schema), "d", "k", "y", "w")
    want = [(d, k, min((c[1] for c in others if c[0] == d and c[2] is not None and (y is None or c[2] < y) and abs(c[3] - w) <= 2), default=None)) for d, k, y, w in mains]
    assert rows(got) == sorted(want, key=str)


def test_references_by_id_name_and_words(spark):
    telling = [["营业收入", "1"], ["营业成本"], ["x", "营业利润"]]
    tables = [("r", 1, 1, "合并资产负债表", [["a"]]), ("r", 2, 2, None, telling), ("r", 3, 3, "", [["y"]] * 29 + telling), ("r", 4, 4, "7", [["资产总计"]]), ("s", 5, 5, None, telling[:2])]
    known = spark.createDataFrame(tables, "d string, id int, o int, name string, r array<array<string>>")
    asked = [("r", "2"), ("r", "99"), ("r", "资产负债表"), ("r", "见合并资产负债表之后"), ("r", "利润表"), ("r", "母公司利润表"), ("s", "利润表"), ("r", "7"), ("r", None)]
    refs = spark.createDataFrame(asked, "d string, ref string")
    got = rows(statements.tables_by_reference(refs, known, "d", "ref", "id", "o", "name", "r"))
    # A number is an id and nothing else, also where a name is that number; words count within 30 rows.
    assert got == sorted([("r", "2", 2, "id"), ("r", "99", None, None), ("r", "资产负债表", 1, "name"), ("r", "见合并资产负债表之后", 1, "name"), ("r", "利润表", 2, "words"), ("r", "母公司利润表", 2, "words"), ("s", "利润表", None, None), ("r", "7", None, None)], key=str)


def matrix(change=None, table="t"):
    values = {("opening", "a"): 10, ("opening", "b"): 5, ("opening", "total"): 15, ("m1", "a"): 1, ("m1", "b"): 2, ("m1", "total"): 3, ("m2", "a"): -4, ("m2", "b"): 0, ("m2", "total"): -4, ("closing", "a"): 7, ("closing", "b"): 7, ("closing", "total"): 14}
    for place, off in (change or {}).items():
        values[place] += off
    kind = lambda r: r if r in ("opening", "closing") else "movement"
    return [(table, r, c, kind(r), "total" if c == "total" else "part", str(v)) for (r, c), v in values.items()]


def test_any_single_wrong_cell_is_found(spark):
    places = [(r, c) for r in ("opening", "m1", "m2", "closing") for c in ("a", "b", "total")]
    data = matrix() + [x for i, p in enumerate(places) for x in matrix({p: 2.5 if i % 2 else -3}, f"t{i}")] + matrix({("m1", "a"): 1, ("m2", "b"): 1}, "two") + matrix({("m1", "a"): 0.01}, "near")
    cells = spark.createDataFrame(data, "t string, r string, c string, rk string, ck string, v string")
    breaks = audit.matrix_closure(cells, "t", "r", "c", "rk", "ck", "v")
    found = audit.broken_cells(cells, breaks, "t", "r", "c", "rk", "ck")
    assert rows(found) == sorted([(f"t{i}", r, c, 2.5 if i % 2 else -3.0) for i, (r, c) in enumerate(places)], key=str)
    assert {r.t for r in breaks.collect()} == {f"t{i}" for i in range(12)} | {"two"}
    assert rows(breaks.where("t = 'two'").select("axis", "place", "difference")) == [("column", "a", -1.0), ("column", "b", -1.0), ("row", "m1", -1.0), ("row", "m2", -1.0)]


def test_unusual_matrices(spark):
    data = [("no total", "opening", "a", "opening", "part", "1"), ("no total", "closing", "a", "closing", "part", "1"), ("odd", "x", "a", "heading", "part", "9"), ("text", "opening", "a", "opening", "part", "n/a"), ("text", "closing", "a", "closing", "part", None)]
    cells = spark.createDataFrame(data, "t string, r string, c string, rk string, ck string, v string")
    assert audit.matrix_closure(cells, "t", "r", "c", "rk", "ck", "v").collect() == []
    sheet = spark.createDataFrame([("t", "a", "7"), ("t", "b", "8"), ("t", "c", "1")], "t string, item string, current string")
    links = audit.equity_links(spark.createDataFrame(matrix(), cells.schema), sheet, "t", "c", "rk", "v")
    assert rows(links.select("item", "matrix", "sheet", "passed", "severity")) == [("a", 7.0, 7.0, True, "info"), ("b", 7.0, 8.0, False, "error")]


def test_chunks_make_up_their_text(spark):
    rng = random.Random(5)
    bits = ["甲乙丙。", "\n", "\n\n", "\n第一章 总则", "\n第二十三章 附则", "\n# A", "\n## B", "\n### C", "x" * 90, "😀é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(40)] + ["", "y" * 2001]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "k int, t string")
    for strategy in retrieval.STRATEGIES:
        pieces = retrieval.chunks(df, "k", "t", strategy, 300, 0.15, 50).cache()
        assert {r.k: r.text for r in retrieval.reassembled(pieces, "k").collect()} == {i: t for i, t in enumerate(texts) if t}
        for r in pieces.collect():
            assert 0 < len(r.core) <= 300 and texts[r.k][r.start : r.start + len(r.core)] == r.core
            after = texts[r.k][r.start + len(r.core) :]
            assert after.startswith(r.overlap) and len(r.overlap) <= 45 and (r.overlap or not after)


def test_chapters_up_to_99_begin_chunks(spark):
    text = "".join(f"\n第{n}章 " + "文" * 150 for n in retrieval.chapter_numbers())
    pieces = retrieval.chunks(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", size=200).orderBy("chunk_index").collect()
    assert len(pieces) == 99 and all(p.core.startswith("\n第") for p in pieces)
    assert retrieval.chapter_numbers()[20:23] == ["二十一", "二十二", "二十三"]


def test_cache_by_content(spark, tmp_path):
    root = str(tmp_path)
    found = lambda *pairs: spark.createDataFrame(list(pairs), "hash string, annotation string")
    assert cache.read(spark, root, "m").collect() == []
    first = cache.write(spark, root, "m", found(("a", "1"), ("b", "1"), ("b", "0")))
    reader = cache.read(spark, root, "m")
    second = cache.write(spark, root, "m", found(("b", "2"), ("c", "2")))
    assert rows(cache.read(spark, root, "m")) == [("a", "1"), ("b", "2"), ("c", "2")]
    assert rows(reader) == [("a", "1"), ("b", "1")]  # a reader of the version before still finds its files
    cache.write(spark, root, "m", found(("d", "3")))
    assert not (tmp_path / first).exists() and (tmp_path / second).exists()
    assert cache.read(spark, root, "other").collect() == []
    cache.write(spark, root, "other", found(("a", "9")))
    assert rows(cache.read(spark, root, "other")) == [("a", "9")]
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("version-")]) <= 3
    assert not list(tmp_path.glob("CURRENT-*"))


def test_a_failed_version_is_not_seen(spark, tmp_path):
    cache.write(spark, str(tmp_path), "m", spark.createDataFrame([("a", "1")], "hash string, annotation string"))
    broken = spark.createDataFrame([("b", "x")], "hash string, annotation string").withColumn("annotation", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        cache.write(spark, str(tmp_path), "m", broken)
    assert rows(cache.read(spark, str(tmp_path), "m")) == [("a", "1")]


def test_hashes_tell_contents_apart(spark):
    data = [("s", "n", None, ["h"], [["1"]]), ("s", "n", "", ["h"], [["1"]]), ("s", "n", "c", ["h"], [["1"]]), ("s", "n", "", ["h"], [["1"], []]), ("n", "s", "", ["h"], [["1"]]), ("s", "n", "", None, None)]
    df = spark.createDataFrame(data, "s string, n string, c string, h array<string>, r array<array<string>>")
    got = [r[0] for r in df.coalesce(1).select(cache.table_hash(*[F.col(c) for c in ("s", "n", "c", "h", "r")])).collect()]
    assert got[0] == got[1] and len(set(got)) == 5 and all(len(h) == 32 for h in got)
    assert cache.missing(df.withColumn("hash", F.col("n")), df.limit(0).select(F.col("n").alias("hash"))).count() == 2
