"""How results, labels and values are shown: row-wise expressions, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.operators.gates import has_any
from tallystone.operators.report import effective_severity

#: Statements whose footing is a check inside the statements, and the sheets by kind of check.
STATEMENT_NAMES = ["资产负债表", "利润表", "现金流量表", "权益变动表", "所有者权益变动表"]
SHEETS = {"报表间": "报表内勾稽", "表注": "表注勾稽", "附注内": "附注内勾稽", "横加": "横加竖加", "竖加": "横加竖加", "文本": "文本格式", "格式": "文本格式"}
#: Why a result of each kind is doubtful.
DOUBTS = {
    "表注": "报表数与附注数不一致或取数失败，需核对附注披露口径/人工提数复核",
    "附注内": "变动表期初+增-减≠期末，需核对是否有重分类或取数误差",
    "横加": "列间加减不平，需核对是否百分比列/子项等特殊结构",
    "竖加": "明细之和≠合计，需核对是否百分比列/子项/取数误差",
    "文本": "疑似错别字或格式问题，需核对原文确认（可能 PDF 提取误差）",
    "格式": "页码/公司名/单位等格式可疑，需人工核实",
    "报表间": "报表间勾稽不平衡，需核对报表数据",
}
DOUBT = "需人工核实"
#: Names of colours.
COLOURS = {
    "红色": "#FF0000", "red": "#FF0000", "绿色": "#00FF00", "green": "#00FF00", "蓝色": "#0000FF", "blue": "#0000FF", "黄色": "#FFFF00", "yellow": "#FFFF00", "橙色": "#FFA500", "orange": "#FFA500",
    "紫色": "#800080", "purple": "#800080", "粉色": "#FFC0CB", "pink": "#FFC0CB", "青色": "#00FFFF", "cyan": "#00FFFF", "白色": "#FFFFFF", "white": "#FFFFFF", "黑色": "#000000", "black": "#000000",
    "灰色": "#808080", "gray": "#808080", "浅蓝色": "#b4bff5", "淡蓝色": "#b4bff5", "深蓝色": "#2c3e50", "浅红": "#f8cecc", "浅黄": "#fff2cc", "浅绿": "#d5e8d4",
}
#: Labels of edges that are drawn dashed.
NEGATIVE = ["否", "不符合", "不", "未", "fail"]
#: Codes of a law's state and of its kind.
LAW_STATES = {1: "已废止", 2: "已修改", 3: "有效", 4: "尚未生效"}
LAW_KINDS = {"宪法": [100], "法律": [102], "行政法规": [210], "监察法规": [220], "地方性法规": [230], "地方法规": [230], "司法解释": [320, 330, 340]}
#: What counts as no value of a picked key.
BLANKS = ["", "-", "—"]


def _literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def decoded(code: Column, labels: dict, default: str) -> Column:
    """The label of a code, or the default for unknown and null ones."""
    return F.coalesce(F.try_element_at(_literal_map(labels), code), F.lit(default))


def sheet_category(kind: Column, location: Column) -> Column:
    """The sheet of a result; footings of a statement go with the checks between statements, unknown kinds keep their name."""
    inside = (kind == "竖加") & F.coalesce(has_any(location, STATEMENT_NAMES), F.lit(False))
    return F.when(inside, SHEETS["报表间"]).otherwise(F.coalesce(F.try_element_at(_literal_map(SHEETS), kind), kind))


def result_label(passed: Column, level: Column) -> Column:
    """通过, 问题 or 存疑."""
    failed = ~F.coalesce(passed, F.lit(False))
    return F.when(failed & (F.lower(level) == "error"), "问题").when(failed & (F.lower(level) == "warning"), "存疑").otherwise("通过")


def review_conclusion(evidence: Column, passed: Column, level: Column, kind: Column) -> Column:
    """What a reviewer wrote behind ``Agent复核：``, else why a warning is doubtful, else the evidence itself."""
    said = F.regexp_extract(evidence, r"Agent复核[：:]\s*([^\[\n]*)", 1)
    why = F.concat(F.lit("存疑："), F.coalesce(F.try_element_at(_literal_map(DOUBTS), kind), F.lit(DOUBT)))
    doubtful = F.coalesce(effective_severity(passed, level) == "warning", F.lit(False))
    return F.when(evidence.rlike("Agent复核[：:]"), F.trim(said)).when(doubtful, why).otherwise(F.coalesce(evidence, F.lit("")))


def review_hints(description: Column, context: Column, evidence: Column, actual: Column) -> Column:
    """Which of four traits of its table a reviewer of a warning has to look at, as names: column, parts, total, percent."""
    text = lambda c: F.coalesce(c, F.lit(""))
    hints = F.array_compact(F.array(
        F.when(text(description).contains("列"), "column"), F.when(text(context).contains("其中") | text(evidence).contains("sub_detail"), "parts"),
        F.when(text(context).contains("合计") & text(actual).isin("", "0.00"), "total"), F.when(has_any(F.lower(text(description)), ["%", "比例", "百分比", "rate"]), "percent"),
    ))
    return F.when(F.size(hints) > 0, F.array_join(hints, "|")).otherwise("none")


def colour(name: Column) -> Column:
    """#RRGGBB in capitals of a hex value or a Chinese or English name; black for others."""
    text = F.trim(name)
    return F.when(text.startswith("#"), F.upper(text)).otherwise(F.upper(F.coalesce(F.try_element_at(_literal_map(COLOURS), F.lower(text)), F.lit(COLOURS["black"]))))


def on_grid(value: Column, grid: int = 10) -> Column:
    """The nearest multiple of the grid, halves to the even one."""
    return (F.bround(value / grid) * grid).cast("long")


def dashed(label: Column, words: list[str] = NEGATIVE) -> Column:
    return F.coalesce(has_any(label, words), F.lit(False))


def xml_escaped(text: Column) -> Column:
    """Text for an XML attribute or element; null becomes empty."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(text, F.lit("")))


def picked(values: Column, keys: list[str]) -> Column:
    """The first non-blank value of a map under one of the keys, else under a name (in order) that holds a key."""
    some = F.map_filter(values, lambda _, v: v.isNotNull() & ~v.isin(BLANKS))
    exact = [F.try_element_at(some, F.lit(k)) for k in keys]
    holding = F.array_sort(F.filter(F.map_keys(some), lambda n: has_any(n, keys)))
    return F.coalesce(*exact, F.try_element_at(some, F.get(holding, F.lit(0))))


def substituted(text: Column, values: Column) -> Column:
    """A text with a map's keys replaced by its values, longer keys first, so none is cut by a shorter one."""
    by_length = F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("k"), e["value"].alias("v"))))
    return F.aggregate(by_length, text, lambda t, e: F.replace(t, e["k"], e["v"]))


def location_text(kind: Column, location: Column, page: Column, context: Column) -> Column:
    """Where a result stands, in words: no table ids, the context for footings, the page if known."""
    bare = F.trim(F.regexp_replace(F.coalesce(location, F.lit("")), r"^表格ID\s*\d+\s*[:：]?\s*", ""))
    told = F.concat(F.lit("（第"), F.coalesce(page, F.lit("")), F.lit("页）"))
    known = F.coalesce(page, F.lit("")) != ""
    footing = F.when(F.coalesce(context, F.lit("")) != "", context).otherwise(bare)
    text = F.when(known, F.concat(F.lit("第"), page, F.lit("页"))).otherwise("全文检查")
    return F.when(kind == "报表间", F.concat(bare, told)).when(kind.isin("竖加", "横加"), F.concat(footing, told)).when(kind.isin("文本", "格式"), text).otherwise(F.when(known, F.concat(bare, told)).otherwise(bare))


def fixed_two(value: Column) -> Column:
    """An amount with two decimals and no separators; null becomes empty."""
    return F.coalesce(F.replace(F.format_number(value, 2), F.lit(","), F.lit("")), F.lit(""))


def result(check: str, rule: str, level: Column, passed: Column, description: Column, expected: Column | None = None, actual: Column | None = None, difference: Column | None = None, confidence: Column | None = None) -> Column:
    """A result as a struct: missing texts are empty, the difference is text with two decimals, confidence 1."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit("")
    return F.struct(
        F.lit(check).alias("check_type"), F.lit(rule).alias("rule_name"), level.alias("severity"), passed.alias("passed"), text(description).alias("description"), text(expected).alias("expected"), text(actual).alias("actual"),
        (fixed_two(difference) if difference is not None else F.lit("")).alias("difference"), (F.coalesce(confidence, F.lit(1.0)) if confidence is not None else F.lit(1.0)).alias("confidence"),
    )


def without_blank_runs(text: Column) -> Column:
    """A text whose lines lose trailing blanks and of whose runs of empty lines one stays; trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?m)[^\S\n]+$", ""), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def key_findings(text: Column, most: int = 3) -> Column:
    """The first second-level headings, else bold words, else plain lines cut at 50 characters."""
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^##\s+(.+)$"), 1)
    bold = F.regexp_extract_all(text, F.lit(r"\*\*(.+?)\*\*"), 1)
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#")), lambda x: F.trim(x))
    short = F.transform(lines, lambda x: F.when(F.length(x) > 50, F.concat(F.substring(x, 1, 50), F.lit("..."))).otherwise(x))
    return F.slice(F.when(F.size(heads) > 0, heads).when(F.size(bold) > 0, bold).otherwise(short), 1, most)


#: Words by which texts contradict each other, with what follows them.
CONTRADICTION = r"(?:矛盾|相反|但实际上|然而.*?不同|争议).{0,100}"


def contradictions(files: DataFrame, topic: str, order: str, name: str, text: str, most: int = 5, width: int = 80) -> DataFrame:
    """(topic, places): the first places in a topic's files, in their order, that speak of a contradiction, with the file's name."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(CONTRADICTION), 0)
    shown = F.transform(found, lambda m: F.concat(F.coalesce(F.col(name), F.lit("")), F.lit(": "), F.substring(m, 1, width)))
    rows = files.select(topic, F.col(order).alias("__o"), F.slice(shown, 1, most).alias("__s")).where(F.size("__s") > 0)
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__s"))), lambda x: x["__s"]))
    return rows.groupBy(topic).agg(F.slice(listed, 1, most).alias("places"))


def fenced_json(text: Column, schema: str) -> Column:
    """A model's answer as a struct: what stands inside a fence, or all of it; null where it is no JSON of the schema."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    return F.from_json(F.trim(F.when(text.contains("```"), inside).otherwise(text)), schema, {"mode": "PERMISSIVE", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"})


def all_addresses(current: Column, invoice: Column, changes: Column) -> Column:
    """Present, invoice and former addresses; ``changes`` holds structs with item and before."""
    former = F.transform(F.filter(changes, lambda c: c["item"].contains("地址")), lambda c: c["before"])
    empty = F.array().cast("array<string>")
    return F.filter(F.concat(F.coalesce(current, empty), F.array(invoice), F.coalesce(former, empty)), lambda a: a.isNotNull() & (a != ""))
