"""Automata, formulas that differ by row, and what is built on them, against plain Python."""

import ast
import random

import pytest
from pyspark.sql import functions as F

from tallystone.functions import formulas, numbers
from tallystone.functions.automaton import Automaton
from tallystone.operators import terms


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute(known, texts):
    out = []
    for i, text in enumerate(texts):
        for k, term in enumerate(known):
            at = text.find(term)
            while at >= 0:
                out.append((i, at, k))
                at = text.find(term, at + 1)
    return sorted(out)


def test_automaton_finds_overlapping_and_nested_terms():
    rng = random.Random(1)
    for _ in range(150):
        letters = rng.choice(["ab", "abc", "资产负债表合计", "aé😀资"])
        known = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 30))]
        texts = ["".join(rng.choice(letters + " ") for _ in range(rng.choice([0, 3, 40, 1500]))) for _ in range(rng.randint(0, 5))]
        made = Automaton(known, table_bytes=rng.choice([200, 4000, 1 << 26]))
        text, term, start = made.find(texts)
        assert sorted(zip(text.tolist(), start.tolist(), term.tolist())) == brute(made.terms, texts)


def test_terms_longer_than_a_lane_and_none_at_all():
    long = "x" * 3000 + "y"
    text, term, start = Automaton([long, "y", "xy"]).find(["x" * 5000 + "y", long])
    assert sorted(zip(text.tolist(), start.tolist(), term.tolist())) == brute(sorted([long, "y", "xy"]), ["x" * 5000 + "y", long])
    assert [len(a) for a in Automaton([]).find(["abc"])] == [0, 0, 0]


def test_a_hundred_thousand_terms_in_several_tables():
    rng = random.Random(2)
    known = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9))) for _ in range(120_000)})[:100_000]
    made = Automaton(known, table_bytes=4 << 20)
    assert len(made.tables) > 3
    texts = ["".join(rng.choice("abcdefghij") for _ in range(4000)) for _ in range(3)]
    text, term, start = made.find(texts)
    held = set(known)
    want = sorted((i, a, t[a : a + n]) for i, t in enumerate(texts) for n in range(4, 10) for a in range(len(t) - n + 1) if t[a : a + n] in held)
    assert sorted((i, a, made.terms[k]) for i, a, k in zip(text.tolist(), start.tolist(), term.tolist())) == want


def test_occurrences_keep_keys_and_pass_over_nulls(spark, monkeypatch):
    texts = [(1, "a", "资产总计与流动资产总计"), (2, "b", None), (3, "c", ""), (3, "c", "总计总计")]
    df = spark.createDataFrame(texts, "k int, term2 string, t string").repartition(2)
    found = terms.occurrences(df, ["k", "term2"], "t", ["总计", "资产总计", "流动资产", "", "无"])
    assert rows(found) == sorted([(1, "a", "总计", 2), (1, "a", "总计", 9), (1, "a", "资产总计", 0), (1, "a", "资产总计", 7), (1, "a", "流动资产", 5), (3, "c", "总计", 0), (3, "c", "总计", 2)], key=str)
    assert rows(terms.contained(df, ["k"], "t", ["总计"])) == [(1, "总计", 2, 2), (3, "总计", 0, 2)]
    known = spark.createDataFrame([("总计",), ("资产",), (None,), ("",), ("总计",)], "w string")
    monkeypatch.setattr(terms, "ROUND_BYTES", 4)
    assert rows(terms.contained(df, ["k"], "t", known, "w").select("k", "w", "n")) == [(1, "总计", 2), (1, "资产", 2), (3, "总计", 2)]
    assert terms.contained(df.limit(0), ["k"], "t", known, "w").collect() == [] and terms.contained(df, ["k"], "t", []).collect() == []


def test_subjects_in_names_and_first_cells(spark):
    data = [(1, "应收账款明细", ["a"], [["货币资金", "应收票据"]]), (2, None, ["存货表"], [["原材料", "1"], [None, "x"], []]), (3, "", None, None), (4, "存", ["x"], [["货"]])]
    df = spark.createDataFrame(data, "id int, name string, h array<string>, r array<array<string>>")
    got = rows(terms.subject_tables(df, ["id"], "name", "h", "r", ["应收账款", "货币资金", "应收票据", "存货", "原材料"]))
    # Cells beyond the first do not count, and no subject reaches over two cells.
    assert got == sorted([(1, "应收账款"), (1, "货币资金"), (2, "存货"), (2, "原材料")], key=str)


def test_summaries_list_subjects_in_more_than_two_rows(spark):
    lines = lambda n: [["净利润", "1"]] * n + [["x", "营业收入"]]
    df = spark.createDataFrame([(1, lines(1)), (2, lines(2)), (3, [["x"]] * 10 + lines(5)), (4, [["净利润净利润 营业收入"]])], "id int, r array<array<string>>")
    assert rows(terms.summary_tables(df, ["id"], "r", ["净利润", "营业收入"])) == [(2, 3)]


def test_typos_as_in_a_report(spark):
    text = (
        "<!-- SOURCE file=\"a\" page=3 method=x -->\n编制基础其\n本原则。<!-- 员债 -->\n<!-- SOURCE file=\"a\" page=4 -->\n"
        "合并润表与合并利润表，审诉　报告。"
    )
    df = spark.createDataFrame([(1, text), (2, "润表"), (3, None), (4, "员<!-- x -->债")], "k int, t string")
    got = rows(terms.typos(df, "k", "t").select("k", "typo", "suggestion", "page"))
    # 润表 is cut from 利润表 in text 1 and stands alone in text 2; 其本 is broken over lines; a comment inside a word hides its page.
    assert got == sorted([(1, "其本", "基本", "3"), (1, "审诉报告", "审计报告", "4"), (2, "润表", "利润表", None), (4, "员债", "负债", None)], key=str)
    assert terms.typos(df, "k", "t").where("k = 2").first()["context"] == "润表"


def python_value(text):
    """What Python makes of a formula of numbers; None where it is none or has no finite real value."""
    try:
        tree = ast.parse(text.replace(",", ""), mode="eval")
        allowed = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Constant, ast.operator, ast.unaryop)
        if not all(isinstance(n, allowed) for n in ast.walk(tree)) or any(isinstance(n, (ast.Not, ast.Invert, ast.BitAnd, ast.BitOr, ast.BitXor, ast.LShift, ast.RShift, ast.MatMult)) for n in ast.walk(tree)):
            return None
        value = float(eval(compile(tree, "f", "eval")))
        return value if abs(value) < float("inf") else None
    except (SyntaxError, TypeError, ZeroDivisionError, OverflowError, ValueError):
        return None


def test_formulas_of_every_shape(spark):
    fixed = ["-2**2", "2**-1", "2**3**2", "-2**-2", "7//2*3", "7%3-8%-3", "-7//2", "-7%3", "1/0", "0**-1", "(1+2)*3", "((4))", "1,234.5+1", "2*-3", "--2", "+-+2", "2**-3*4", "1e3+1", "1E-2*100", ".5+5.", "8/4/2", "8-4-2", "5//(1-1)+1", "(-8)**0.5"]
    bad = ["", " ", "1 2", "1+", "*2", "()", "(1", "1)", "1)+(2", "a+1", "2 ** ", "1..2", "资产", "1//", "1(2)", "(1)(2)", "1 . 5"]
    rng = random.Random(4)

    def made(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["0", "1", "2", "3", "0.5", "7", "12.25"])
        kind = rng.random()
        if kind < 0.15:
            return "(" + made(depth - 1) + ")"
        if kind < 0.3:
            return rng.choice("+-") + made(depth - 1)
        return made(depth - 1) + rng.choice([" ", ""]) + rng.choice(["+", "-", "*", "/", "%", "//"] + ["**"] * (depth == 1)) + rng.choice([" ", ""]) + made(depth - 1)

    texts = fixed + bad + [made(4) for _ in range(300)]
    got = [r["v"] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(formulas.evaluate(F.col("t")).alias("v")).collect()]
    for text, value in zip(texts, got, strict=True):
        want = python_value(text)
        assert value == pytest.approx(want, rel=1e-9, abs=1e-9) if want is not None else value is None, text
    assert [r[0] for r in spark.createDataFrame([(None,)], "t string").select(formulas.evaluate(F.col("t"))).collect()] == [None]


def test_formulas_need_no_python_worker(spark):
    df = spark.createDataFrame([("1+1",)], "t string").select(formulas.evaluate(F.col("t")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_note_values(spark):
    data = [
        ("账面余额-坏账准备=账面价值", "账面价值", {"账面余额": "1,000.50", "坏账准备": "(100)", "账面价值": "7"}, "1100.50"),
        ("存货原值-存货", None, {"存货": "1", "存货原值": "5"}, "4.00"),  # the longer name first
        ("账面余额-未知", "账面价值", {"账面余额": "1", "账面价值": "7"}, "7"),
        ("账面余额-坏账准备", "账面价值", {"账面余额": "1", "坏账准备": "-", "账面价值": "7"}, "7"),  # no amount for a name
        ("期末余额", "年末余额", {"期末余额合计": "12"}, "12"),  # by synonym, then by containing
        (None, "年末余额", {"账面价值": "2", "账面余额": "1"}, "1"),  # synonyms in their order
        (None, "本期金额", {"x": "2"}, None),
        (None, "", {"x": "2"}, None),
        ("(甲+乙)*2", None, {"甲": "1", "乙": "2"}, "6.00"),
        ("甲/乙-1", "甲", {"甲": "3", "乙": "0"}, "3"),
        ("甲-乙", "甲", {"甲": "3万", "乙": "10000000"}, "-9970000.00"),
    ]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, f string, n string, v map<string,string>, want string")
    for r in df.select("i", "want", formulas.note_value(F.col("f"), F.col("n"), F.col("v")).alias("got")).collect():
        assert r["got"] == r["want"], data[r["i"]]


def test_amounts_as_the_calculator_reads_them(spark):
    cases = {
        "100元": 100.0, "约3,000": 3000.0, "12%": 12.0, "3F": 3.0, "1D": 1.0, "Infinity": None, "NaN": None, "": 0.0, " - ": 0.0, "－": 0.0, "—": 0.0, "1,234,567.89": 1234567.89, "1.234.567,89": 1234567.89, "1,234": 1234.0, "1,23": 1.23,
        "-1,23": -123.0, "(1,234.56)": -1234.56, "（1，234）": -1234.0, "(-5)": 5.0, "3.5万": 35000.0, "2亿": 2.0, "abc": None, "1 234": 1234.0, "1e30": 1.0, "..5": 0.5, "()": None, "+7": 7.0, "1,234,5": 12345.0,
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", numbers.calculator_number(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == cases
    cells = {"": None, "-": None, "_": None, "100元": 100.0, "(1,5)": -15.0, "（5）": 5.0, "2万": 2.0, "x": None, "12%": 12.0, "3.": 3.0, "(－)": None}
    got = spark.createDataFrame([(k,) for k in cells], "t string").select("t", numbers.table_number(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == cells


def test_people_shared_in_several_roles(spark):
    from tallystone.operators import related

    data = [(1, "王五", "legal_person"), (2, "王五", "legal_person"), (3, "王五", "shareholder"), (1, "李四", "shareholder"), (2, "李四", "shareholder"), (3, "李四", "core_team"), (1, "公", "legal_person"), (2, "公", "legal_person"), (1, "财政部", "controller"), (2, "财政部", "controller"), (4, "赵六", "main_person")]
    excluded = spark.createDataFrame([("财政部",)], "value string")
    got = related.shared_people(spark.createDataFrame(data, "entity int, value string, role string"), excluded)
    want = [(1, "王五", 1, "legal_person", 3, 1), (2, "王五", 1, "legal_person", 3, 1), (1, "王五", 1, "person", 2, 1), (2, "王五", 1, "person", 2, 1), (3, "王五", 1, "person", 2, 2)]
    want += [(1, "李四", 1, "person", 3, 1), (1, "李四", 1, "person", 2, 1), (2, "李四", 1, "person", 3, 1), (2, "李四", 1, "person", 2, 1), (3, "李四", 1, "person", 3, 2)]
    assert rows(got.select("entity", "value", "class_id", "dimension", "level", "n_links")) == sorted(want, key=str)


def test_a_rule_that_fails_leaves_the_others(spark):
    from tallystone.operators import related

    good = spark.createDataFrame([(1, "x")], "entity int, value string")

    def broken():
        raise KeyError("no column")

    found, errors = related.isolated({"a": lambda: good, "b": broken, "c": lambda: good.withColumn("value", F.raise_error(F.lit("stop")).cast("string")), "d": lambda: good.select("entity", F.lit(3).alias("level")), "e": lambda: good.select("nothing")})
    assert rows(found.select("entity", "value", "level", "rule")) == sorted([(1, "x", None, "a"), (1, None, 3, "d")], key=str)
    assert set(errors) == {"b", "c", "e"}
    assert related.isolated({"b": broken})[0] is None


def test_terms_are_no_wrong_words(spark):
    data = [(1, "金融机 构", "x"), (2, "x", "所得税"), (3, "现金流理表", "现金流量表"), (4, None, None)]
    got = terms.without_terms(spark.createDataFrame(data, "k int, original string, suggestion string"))
    assert [r.k for r in got.orderBy("k").collect()] == [3, 4]
    assert len(set(terms.AUDIT_TERMS)) == len(terms.AUDIT_TERMS)
