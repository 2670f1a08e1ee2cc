"""Operators on small hand-written tables: edge cases of amounts, statements, tables, texts and stores."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallystone.functions import numbers, text
from tallystone.functions.formulas import compile_formula, is_subsequence, signed_sum
from tallystone.operators import audit, documents, graph, linkage, matching, related, report, statements
from tallystone.sinks import store, tables
from tallystone.sources import office


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_parse_number(spark):
    cases = {"1,234,567.89": 1234567.89, "1.234.567,89": 1234567.89, "1,234": 1234.0, "1,23": 1.23, "(1,234.56)": -1234.56, "（1，234）": -1234.0, "—": 0.0, "": 0.0, "3.5万": 35000.0, "abc": None}
    got = spark.createDataFrame(list(cases.items()), "t string, want double").select("want", numbers.parse_number(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == pytest.approx([r.want for r in got], nan_ok=True) or [r.v for r in got] == [r.want for r in got]


def test_formula_refuses_calls():
    with pytest.raises(ValueError):
        compile_formula("__import__('os')", F.col)
    with pytest.raises(ValueError):
        compile_formula("a +", F.col)


def test_formula_by_zero_is_null(spark):
    df = spark.createDataFrame([(6.0, 0.0), (6.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(compile_formula("a / b + 1", F.col)).collect()] == [None, 3.0]


def test_item_aliases(spark):
    df = spark.createDataFrame([(n,) for n in ("股东权益合计", "期初余额", "存货", None)], "n string")
    assert [r[0] for r in df.select(statements.canonical_name(F.col("n"))).collect()] == ["所有者权益合计", "上年年末余额", "存货", None]
    assert len(statements.ALIASES) == 24


def test_signed_sum(spark):
    df = spark.createDataFrame([("a-b+c", {"a": 5.0, "b": 2.0, "c": 1.0}), ("a-x", {"a": 5.0})], "f string, v map<string,double>")
    assert [r[0] for r in df.select(signed_sum(F.col("f"), F.col("v"))).collect()] == [4.0, None]


def test_subsequence(spark):
    df = spark.createDataFrame([("abc", "xaybzc"), ("abc", "acb"), ("", "x"), ("aa", "a")], "s string, l string")
    assert [r[0] for r in df.select(is_subsequence(F.col("s"), F.col("l"))).collect()] == [True, False, True, False]


def test_clean_item(spark):
    # Numbers without a mark, and 其中 and 减 without a colon, are taken off as well.
    names = ["一．货币资金", "1）货币资金", "其中应收账款", "减营业成本", "十二利息收入", "一、营业 收入", "（二）其中：利息收入", "减：营业成本", "3. 净利润（亏损以号填列）", "应收账款（附注5）"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(statements.clean_item(F.col("n"))).collect()] == ["货币资金", "货币资金", "应收账款", "营业成本", "利息收入", "营业收入", "利息收入", "营业成本", "净利润", "应收账款（附注5）"]


def test_footing_takes_last_total_and_skips_subtotals(spark):
    cells = [("t", 1, "c", "甲", "100"), ("t", 2, "c", "小计", "100"), ("t", 3, "c", "减：乙", "30"), ("t", 4, "c", "合计", "999"), ("t", 5, "c", "合 计", "70"), ("u", 1, "c", "甲", "1"), ("u", 2, "c", "合计", "-"), ("p", 1, "c", "甲", "5%"), ("p", 2, "c", "合计", "5%")]
    got = report.foot_tables(spark.createDataFrame(cells, "t string, r int, c string, l string, v string"), "t", "r", "c", "l", "v")
    assert rows(got.select("t", "footed", "total", "passed")) == [("p", 5.0, 5.0, True), ("t", 70.0, 70.0, True)]


def test_footing_takes_off_rows_with_a_colon_only_and_needs_a_total(spark):
    cells = [("t", 1, "c", "甲", "100"), ("t", 2, "c", "减值准备", "30"), ("t", 3, "c", "（2）减: 乙", "10"), ("t", 4, "c", "合计", "120"), ("u", 1, "c", "甲", "1"), ("u", 2, "c", "合计", "0.00"), ("v", 1, "c", "甲", "1"), ("v", 2, "c", "小计", "2"), ("v", 3, "c", "合计（小计）", "1")]
    got = report.foot_tables(spark.createDataFrame(cells, "t string, r int, c string, l string, v string"), "t", "r", "c", "l", "v")
    assert rows(got.select("t", "footed", "passed")) == [("t", 120.0, True), ("v", 1.0, True)]


def test_header_rows_are_merged(spark):
    cases = [
        (["项目", "a"], [["项目", "金额"], ["x", "1"]], (["项目 项目", "a 金额"], [["x", "1"]])),
        (["项目", "a"], [["", "b"], ["类别", "c"], ["x", "1"]], (["项目  类别", "a b c"], [["x", "1"]])),
        (["项目", "a"], [["x", "1"], ["y", "2"]], (["项目", "a"], [["x", "1"], ["y", "2"]])),
        (["项目", "a"], [["项目", "金额"]], (["项目", "a"], [["项目", "金额"]])),
        (["项目", "a"], [["项目", "金额", "z"], ["y", "2"]], (["项目", "a"], [["项目", "金额", "z"], ["y", "2"]])),
        (["项目", "a"], [], (["项目", "a"], [])),
        (None, None, (None, None)),
    ]
    df = spark.createDataFrame([(i, h, r) for i, (h, r, _) in enumerate(cases)], "i int, h array<string>, r array<array<string>>")
    got = {x.i: (x.h, x.r) for x in report.with_merged_headers(df, "h", "r").collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]
    assert report.foot_matrices(df, "i", "h", "r").count() == 0


def test_cross_foot_without_pattern_is_null(spark):
    df = spark.createDataFrame([(["名称", "金额"], ["x", "1"]), (["账面余额", "坏账准备", "账面价值"], ["1,000", "100", "900"])], "h array<string>, c array<string>")
    assert rows(report.cross_foot_tables(df, "h", "c").select("pattern", "passed")) == [("A", True), (None, None)]


def test_cells_count_by_their_first_number_and_large_ones_do_not_end_the_job(spark):
    cells = [("t", 1, "c", "甲", "100元"), ("t", 2, "c", "乙", "1"), ("t", 3, "c", "合计", "101"), ("u", 1, "c", "甲", "9" * 30), ("u", 2, "c", "合计", "1"), ("v", 1, "c", "甲", "约3,000"), ("v", 2, "c", "合计", "3,000.00"), ("w", 1, "c", "甲", ""), ("w", 2, "c", "合计", "5"), ("x", 1, "损失率", "甲", "1"), ("x", 2, "损失率", "合计", "2")]
    df = spark.createDataFrame(cells, "t string, r int, c string, l string, v string")
    got = report.foot_tables(df, "t", "r", "c", "l", "v", "c")
    assert rows(got.select("t", "footed", "total", "passed", "severity")) == [("t", 101.0, 101.0, True, "info"), ("u", None, 1.0, False, "warning"), ("v", 3000.0, 3000.0, True, "info")]
    assert rows(report.unreadable(df, "t", "r", "c", "v")) == [("u", 1, "c", "9" * 30)]


def test_tables_of_currencies_and_statements_are_not_footed(spark):
    lines = lambda *first: [[f, "1"] for f in first]
    cases = [
        (1, ["项目", "金额"], lines("美元", "日元", "合计")), (2, ["项目", "金额"], lines("美元", "日元", "总计")), (3, ["项目", "金额"], lines(*["甲"] * 30, "美元", "日元", "合计")), (4, ["项目", "金额"], lines("净利润", "合计")), (5, ["项目", "金额"], lines("甲", "合计")),
    ]
    df = spark.createDataFrame(cases, "i int, h array<string>, r array<array<string>>")
    assert [r[0] for r in df.select(statements.multi_currency(F.col("h"), F.col("r"))).collect()] == [True, False, False, False, False]
    assert rows(report.foot_matrices(df, "i", "h", "r").select("i", "passed")) == [(2, False), (3, False), (5, True)]


def test_columns_by_words_years_and_digits(spark):
    cases = [
        (["项目", "期初余额", "期末余额"], [["a", "1", "2"]], (0, 2, 1)), (["项目", "2023", "2024年", "2022"], [["a", "1", "2", "3"]], (0, 2, 1)), (["项目", "附注", "甲", "乙"], [["a", "", "1", "2"], ["b", "x", "1"]], (0, 2, 3)),
        (["项目", "附注", "期末"], [["a", "注1", "2"], ["b", "", "3"]], (0, 2, 1)), (["项目"], [["a"]], (0, 0, 0)), (["项目", "金额"], [], (0, 1, 1)),
    ]
    df = spark.createDataFrame([(i, h, r) for i, (h, r, _) in enumerate(cases)], "i int, h array<string>, r array<array<string>>")
    got = {x.i: tuple(x.c) for x in df.select("i", statements.linear_columns(F.col("h"), statements.numeric_shares(F.col("h"), F.col("r"))).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]


def test_headers_of_one_role(spark):
    df = spark.createDataFrame([(["期初余额", "本期增加", "本期减少", "期末余额"], ["1", "2", "1", "2"]), (["期初数", "增加", "减少", "期末数"], ["1", "2", "-", "3"]), (["原值", "折旧", "减值", "净值"], ["9", "", "1", "8"]), (["原值", "折旧", "减值准备", "账面价值"], ["9", "1", "1", "7"]), (["余额", "准备", "价值"], ["1", "x", "1"])], "h array<string>, c array<string>")
    assert [tuple(r) for r in report.cross_foot_tables(df, "h", "c", chain=True).select("pattern", "passed").collect()] == [(None, None), ("B", True), ("C", True), (None, None), ("A", None)]
    assert [tuple(r) for r in report.cross_foot_tables(df, "h", "c").select("pattern", "passed").collect()] == [("B", True), ("B", True), ("C", True), ("C", True), ("A", None)]


def test_landlines_with_and_without_area_code_meet(spark):
    df = spark.createDataFrame([("021-55556666",), ("55556666",), ("+86 13812345678、(0755)82284751",), ("8613812345678",), ("12345678901",), (None,)], "t string")
    assert [r[0] for r in df.select(text.phones(F.col("t"))).collect()] == [["02155556666", "55556666"], ["55556666"], ["075582284751", "13812345678", "582284751"], ["13812345678"], [], []]


def test_neighbours_of_shared_numbers_are_linked(spark):
    df = spark.createDataFrame([(1, "0755-82284751"), (2, "0755-82284750"), (3, "0755-82284750")], "k int, phone string")
    assert rows(related.phone_segments(df, "k").select("entity", "class_id", "n_links")) == [(1, 1, 2), (2, 1, 1), (3, 1, 1)]


def test_mails_of_any_script(spark):
    df = spark.createDataFrame([("写信给 张三@firm.cn, <b>A.b+c</b>@Mail.example.com; x@y; q@z.co.",)], "t string")
    assert df.select(text.emails(F.col("t")).alias("e")).first()["e"] == ["张三@firm.cn", "a.b+c@mail.example.com", "q@z.co"]


def test_paragraphs_fold_as_by_hand(spark):
    lines = [f"word{i}" + ("." if i % 7 == 6 else "") + "x" * (i % 5 * 30) for i in range(60)]
    want, now = [], []
    for line in lines:
        now.append(line)
        if len(" ".join(now)) > 200 or line[-1] in "。！？.!?":
            want.append(" ".join(now))
            now = []
    want += [" ".join(now)] if now else []
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k int, i int, t string")
    assert [r.paragraph for r in documents.paragraphs(df, "k", "i", "t").orderBy("paragraph_no").collect()] == want


def test_subtitle_lines(spark):
    lines = ["1", "00:00:01,000 --> 00:00:02", "<i>hello</i>", "hello", "", "world position:10%"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "k int, i int, t string")
    assert [r.t for r in documents.subtitle_lines(df, "k", "i", "t").orderBy("i").collect()] == ["hello", "world"]


def test_persona_gates(spark):
    good = "### 模型1\n### 模型2\n### 模型3\n局限\n## 表达DNA\n句式 词汇 语气\n## 诚实边界\n- a\n- b\n- c\n## 来源\n一手 一手 二手\n张力 矛盾"
    got = documents.persona_gates(spark.createDataFrame([(good,), ("",), (None,)], "t string"), "t")
    assert [r[0] for r in got.select("gates_passed").collect()]== [6, 1, 1]  # no marked source is no fault
    cases = {"has_models": "## 心智模型\n### a\n### b\n### c\n## next\n### d", "has_boundary": "## honest boundary\n* a\n* b\n* c", "mostly_primary": "## Source\nprimary secondary"}
    got = {c: documents.persona_gates(spark.createDataFrame([(x,)], "t string"), "t").first()[c] for c, x in cases.items()}
    assert got == {"has_models": True, "has_boundary": True, "mostly_primary": False}
    assert not documents.persona_gates(spark.createDataFrame([("句式 词汇 语气",)], "t string"), "t").first()["has_style"]


def test_adjacent_landlines_only(spark):
    numbers = [(1, "075582284751"), (2, "075582284750"), (3, "075582284750"), (4, "13822847501"), (5, "13822847502"), (6, "02112345678"), (7, "02112345678")]
    got = linkage.adjacent(spark.createDataFrame(numbers, "k int, n string"), "k", "n")
    assert rows(got.select("entity", "class_id", "n_links")) == [(1, 1, 2), (2, 1, 1), (3, 1, 1)]


def test_public_domains_are_no_link(spark):
    df = spark.createDataFrame([("a@yahoo.com b@firm.cn c@icloud.com d@vip.163.com",)], "t string")
    assert df.select(text.private_domains(text.emails(F.col("t"))).alias("d")).first()["d"] == ["firm.cn"]


def test_statement_identities(spark):
    flows = ["经营活动产生的现金流量净额", "投资活动产生的现金流量净额", "筹资活动产生的现金流量净额"]
    cash = lambda key, increase, exchange: [(key, n, "10") for n in flows] + [(key, "现金及现金等价物净增加额", increase)] + ([(key, audit.EXCHANGE[0], exchange)] if exchange else [])
    sheet = [("full", n, v) for n, v in (("流动资产合计", "60"), ("非流动资产合计", "40.01"), ("资产总计", "100"), ("流动负债合计", "30"), ("非流动负债合计", "10"), ("负债合计", "40"), ("所有者权益合计", "60"), ("负债和所有者权益总计", "100.02"))]
    profit = [("full", n, v) for n, v in (("营业利润", "50"), ("营业外收入", "5"), ("营业外支出", "3"), ("利润总额", "52"), ("所得税费用", "12"), ("净利润", "41"), ("期初现金及现金等价物余额", "7"), ("期末现金及现金等价物余额", "37"))]
    items = sheet + profit + cash("full", "30", "5") + cash("exchange", "35", "5") + cash("off", "36", "5") + cash("none", "35", None)
    got = {(r.stmt, r.rule_id): r.passed for r in audit.identities(spark.createDataFrame(items, "stmt string, item string, current string")).collect()}
    assert [got["full", r] for r in ("R1", "R2", "R3", "R4", "R6", "R7", "R8", "R9")] == [True, True, False, False, True, False, True, True]
    assert [got[k, "R8"] for k in ("exchange", "off", "none")] == [True, False, False]


def test_sheets_follow_their_relations():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" r:id="r2"/><sheet name="two" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        for n in (1, 2):
            book.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet {ns}><sheetData><row><c r="B1"><v>{n}</v></c></row></sheetData></worksheet>')
    assert list(office.xlsx_rows(out.getvalue())) == [("one", 0, ["", "2"]), ("two", 0, ["", "1"])]


def test_contained_titles(spark):
    names = spark.createDataFrame([("中华人民共和国公司法",), ("会计法实施细则",), ("无关名称",)], "n string")
    records = spark.createDataFrame([("中华人民共和国公司法", 2), ("公司法", 1), ("会计法实施", 3)], "r string, id int")
    assert rows(matching.contained_titles(names, records, "n", "r", "id")) == [("中华人民共和国公司法", "中华人民共和国公司法", 2), ("会计法实施细则", "会计法实施", 3)]


def test_crossed_never_links_an_entity_to_itself(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "entity int, value string")
    assert rows(related.crossed(df, df, "former_name", 2).select("entity", "class_id", "n_links")) == [(1, 2, 1), (2, 1, 1)]


def test_penetration_stops_at_the_threshold_and_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "51%"), ("b", "c", "60%"), ("c", "a", "90%"), ("c", "d", "n/a"), ("b", "e", "")], "parent string, child string, ratio string")
    assert rows(graph.penetrate(edges, spark.createDataFrame([("a",)], "node string"))) == [("a", 0), ("b", 1), ("c", 2)]


def test_reviewed_by_id(spark):
    results = spark.createDataFrame([(1, False, "error"), (2, False, "warning"), (3, False, "error")], "result_id int, passed boolean, severity string")
    decisions = spark.createDataFrame([(1, "downgrade"), (2, "needs_review")], "result_id int, decision string")
    assert rows(report.reviewed(results, decisions).select("result_id", "severity", "needs_review")) == [(1, "info", False), (2, "warning", True), (3, "error", False)]


def test_sinks(spark, tmp_path):
    hits = spark.createDataFrame([("phone", [1, 2], True), ("email", [3], None)], "dimension string, ids array<int>, ok boolean")
    tables.write_dimensions(hits, f"{tmp_path}/hits")
    back = spark.read.option("header", True).csv(f"{tmp_path}/hits").select("dimension", "ids", "ok")
    assert rows(back) == [("email", "3", None), ("phone", "1, 2", "是")]
    tables.write_names(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "n string, i int"), "n", "i", f"{tmp_path}/names")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/names").collect()) == ["a", "b"]


def test_store_reads_the_last_version(spark, tmp_path):
    one = spark.createDataFrame([("x", "old"), ("y", "old")], "id string, text string")
    store.write_version(spark, str(tmp_path), "p", one, 1)
    store.write_version(spark, str(tmp_path), "p", store.upsert(store.read_project(spark, str(tmp_path), "p"), spark.createDataFrame([("x", "new")], "id string, text string")), 2)
    assert rows(store.read_project(spark, str(tmp_path), "p")) == [("x", "new"), ("y", "old")]
    with pytest.raises(KeyError):
        store.read_project(spark, str(tmp_path), "none")
