"""Gates, files and plans on small tables: awkward cells, empty tables, many ranges."""

import zipfile

from pyspark.sql import functions as F

from tallystone.operators import companies, display, gates, graph, retrieval
from tallystone.sources import files, office
from tallystone.sinks import tables


def one(df):
    return df.first()[0]


def table(spark, headers, rows):
    return spark.createDataFrame([(headers, rows)], "h array<string>, r array<array<string>>")


def test_gates_of_empty_and_null_tables(spark):
    for headers, rows in ((None, None), ([], []), (["项目", "金额"], [])):
        got = table(spark, headers, rows).select(
            gates.useful(F.col("h"), F.col("r")).alias("u"), gates.balance_part(F.col("r")).alias("p"), gates.matrix_value_column(F.col("h"), F.col("r")).alias("c"), gates.table_total(F.col("r")).alias("t"), gates.names_subjects(F.col("r"), ["净利润"]).alias("s"),
        ).first()
        assert (got.u, got.p, got.t, got.s) == (False, None, None, False) and got.c == (1 if headers else 0)


def test_large_and_mixed_tables_are_not_useful(spark):
    row = ["货币资金", "1"]
    for rows, want in (([row] * 20, True), ([row] * 21, False), ([["美元", "1"], ["人民币", "2"]], False), ([["甲", "乙"]] * 4, False), ([["甲", "乙"]] * 4 + [["合计", ""]], True)):
        assert one(table(spark, ["项目", "金额"], rows).select(gates.useful(F.col("h"), F.col("r")))) is want


def test_equity_matrix_needs_period_headers(spark):
    rows = [[w, "1"] for w in gates.EQUITY_ITEMS[:4]]
    for headers, want in ((["2024", "2023", "本期金额", "上期金额"], 4 / 6), (["2024", "2023", "本期金额"], 0.0)):
        assert abs(one(table(spark, headers, rows).select(gates.statement_scores(F.col("h"), F.col("r"))["equity"])) - want) < 1e-9


def test_total_falls_back_to_sums(spark):
    got = table(spark, ["a", "b"], [["甲", "1,000"], ["乙", "-"], ["丙", "2"]]).select(gates.table_total(F.col("r")), gates.table_total(F.col("r"), F.lit(1)), gates.table_total(F.col("r"), F.lit(5))).first()
    assert tuple(got) == (1002.0, 1002.0, None)


def test_names_that_hold_each_other_agree(spark):
    text = "甲星股份有限公司\n编制单位：甲星有限公司\n甲星股份有限公司"
    rows = spark.createDataFrame([(1, text, "甲星"), (2, text, "乙月有限公司"), (3, None, None), (4, "本有限公司", "丙")], "k int, t string, l string")
    got = {r.k: (r.main_core, r.passed) for r in companies.company_consistency(rows, "k", "t", "l").collect()}
    assert got == {1: ("甲星股份", True), 2: ("甲星股份", False), 3: ("", True), 4: ("", True)}


def test_longer_keys_are_substituted_first(spark):
    df = spark.sql("select map('A', '1', 'AB', '2', 'ABC', '3') as m")
    assert one(df.select(display.substituted(F.lit("A+AB+ABC"), F.col("m")))) == "1+2+3"


def test_lanes_over_many_ranges(spark):
    nodes = spark.range(0, 500).select(F.col("id"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("lane"))
    got = {r.id: (r.lane_no, r.row_no) for r in graph.lanes(nodes, "lane", "id", rows_a_range=20).collect()}
    assert got == {i: (1, i // 5 + 1) if i % 5 == 0 else (2, i - i // 5) for i in range(500)}


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    monkeypatch.setattr(retrieval, "PART", 5)
    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in retrieval.top_k(v, v.where("vec_id % 5 = 0"), 4).collect())

    def cosine(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return round(dot / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 5)

    want = [(q, k + 1, i) for q, e in rows if q % 5 == 0 for k, (_, i) in enumerate(sorted((-cosine(e, x), i) for i, x in rows)[:4])]
    assert got == want


def test_office_files(spark, tmp_path):
    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>合计</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>5</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", word)
    (tmp_path / "b.xlsx").write_bytes(b"no archive")
    got = {r.path.rsplit("/", 1)[1]: (r.table_name, r.cells, r.error is None) for r in office.read_office(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("table0", ["合计", "合计", "5"], True), "b.xlsx": (None, None, False)}
    (tmp_path / "a.pdf").write_bytes(b"x")
    kept = files.one_per_name(files.listing(spark, str(tmp_path)), "path").select("path").collect()
    assert [r.path.rsplit("/", 1)[1] for r in kept] == ["a.docx"]


def test_sheets_and_statements(spark, tmp_path):
    rows = spark.createDataFrame([(1, "竖加", "利润表", True), (2, "文本", "x", False)], "result_id int, kind string, place string, passed boolean")
    tables.write_sheets(rows, str(tmp_path / "book"), display.sheet_category(F.col("kind"), F.col("place")))
    got = spark.read.option("header", True).csv(str(tmp_path / "book" / "sheets"))
    assert {(r.result_id, r.sheet) for r in got.collect()} == {("1", "报表内勾稽"), ("2", "文本格式")}
    tables.write_statements(rows, str(tmp_path / "s"), "kind", ["result_id"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert tables.first_row_columns(rows.limit(0), "result_id").count() == 0
