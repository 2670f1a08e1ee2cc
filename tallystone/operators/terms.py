"""Where the terms of a dictionary stand in texts: a join on ``contains`` without comparing every pair.

Each task runs an automaton over its texts; the texts are not shuffled, and the
work does not grow with the number of terms but for the tables' number. A
dictionary that is a DataFrame is measured first: up to ROUND_BYTES are handed
to the tasks at once, and a longer one in as many passes as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.functions.automaton import Automaton
from tallystone.functions.text import BLANK, join_broken_cjk

#: Bytes of terms handed to the tasks at once, bytes of text run at once, rows that leave a task at once.
ROUND_BYTES, SLICE_BYTES, OUT_ROWS = 32 << 20, 2 << 20, 50_000
#: Wrong words and what they should be.
TYPOS = {
    "先讲先出": "先进先出", "其本": "基本", "员债": "负债", "所有都权益": "所有者权益", "润表": "利润表", "计报告": "审计报告", "资负债表": "资产负债表", "现金流理表": "现金流量表", "财国报表": "财务报表",
    "合计师事务所": "会计师事务所", "特殊普通合饮": "特殊普通合伙", "财务报麦": "财务报告", "审诉报告": "审计报告",
}
#: Whole words that a wrong one may be cut from; a text that has one has no such typo.
WHOLE_WORDS = ["利润表", "审计报告", "资产负债表", "现金流量表", "财务报表", "会计师事务所", "特殊普通合伙", "财务报告", "所有者权益", "先进先出"]
#: Terms of the trade, which no finding of a wrong word is about.
AUDIT_TERMS = [
    "金融机构", "所得税", "决策", "所有者权益", "非经常性损益", "关联方", "合并报表", "资产负债", "现金流量", "营业收入", "营业成本", "应收账款", "固定资产", "无形资产",
    "长期股权投资", "应付账款", "存货", "资本公积", "盈余公积", "未分配利润", "递延所得税", "公允价值", "减值准备", "坏账准备", "累计折旧", "累计摊销", "应付职工薪酬", "应收票据",
    "其他应收款", "其他应付款", "预付账款", "预收账款", "投资性房地产", "在建工程", "长期待摊费用", "短期借款", "长期借款", "应付债券", "股本", "实收资本", "专项储备",
    "其他综合收益", "营业利润", "利润总额", "净利润", "每股收益", "基本每股收益", "稀释每股收益", "归属于母公司所有者的净利润", "少数股东损益", "经营活动", "投资活动", "筹资活动",
    "现金及现金等价物净增加额", "期初现金及现金等价物余额", "期末现金及现金等价物余额", "流动资产", "非流动资产", "流动负债", "非流动负债", "资产总计", "负债合计", "所有者权益合计",
    "负债和所有者权益总计", "一年内到期的", "长期应收款", "长期应付款", "预计负债", "递延收益", "递延所得税资产", "递延所得税负债", "应付股利", "应交税费", "其他流动资产", "其他非流动资产",
    "交易性金融资产", "债权投资", "其他债权投资", "投资收益", "资产处置收益", "其他收益", "营业外收入", "营业外支出", "所得税费用", "持续经营净利润", "终止经营净利润", "综合收益总额",
    "归属于母公司", "少数股东权益", "财务费用", "销售费用", "管理费用", "研发费用", "税金及附加", "信用减值损失", "资产减值损失", "净敞口套期收益", "其他权益工具投资", "合同资产",
    "合同负债", "合同取得成本", "合同履约成本", "应收款项融资",
]
#: What parts a table's name and its labels, so that no term reaches over two of them.
PART = "\x1f"

_built: dict[tuple[str, ...], Automaton] = {}


def _automaton(terms: tuple[str, ...]) -> Automaton:
    """The worker's last automaton again where its terms are the same."""
    if terms not in _built:
        _built.clear()
        _built[terms] = Automaton(list(terms))
    return _built[terms]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of texts of bounded bytes; a longer text is a run of its own."""
    at = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > at and size + n > SLICE_BYTES:
            yield at, i - at
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts) - at


def _pass(rows: DataFrame, keys: list[str], text: str, terms: tuple[str, ...], term: str, once: bool) -> DataFrame:
    base = rows.select(*keys, F.col(text).cast("string").alias("__text")).where("__text is not null")
    more = [T.StructField(term, T.StringType()), T.StructField("start", T.IntegerType())] + [T.StructField("n", T.LongType())] * once
    schema = T.StructType([*base.schema.fields[:-1], *more])

    def run(batches):
        automaton = _automaton(terms)
        names = pa.array(automaton.terms, pa.string())
        for whole in batches:
            for at, length in _slices(whole.column("__text")):
                batch = whole.slice(at, length)
                row, which, start = automaton.find(batch.column("__text").to_pylist())
                columns = [start]
                if once and len(row):
                    # By text, term and place: the first place of every term in a text, and how many there are.
                    order = np.lexsort((start, which, row))
                    row, which, start = row[order], which[order], start[order]
                    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (which[1:] != which[:-1])])
                    columns = [start[first], np.diff(np.r_[first, len(row)])]
                    row, which = row[first], which[first]
                elif once:
                    columns = [start, start]
                for a in range(0, len(row), OUT_ROWS):
                    part = slice(a, a + OUT_ROWS)
                    kept = batch.select(list(range(batch.num_columns - 1))).take(pa.array(row[part]))
                    new = [names.take(pa.array(which[part])), pa.array(columns[0][part].astype(np.int32))] + [pa.array(c[part].astype(np.int64)) for c in columns[1:]]
                    yield pa.RecordBatch.from_arrays([*kept.columns, *new], [*kept.schema.names, *schema.names[len(kept.columns) :]])

    return base.mapInArrow(run, schema)


def _rounds(terms: DataFrame | list[str], term: str) -> list[tuple[str, ...]]:
    """The distinct terms in parts of at most about ROUND_BYTES."""
    if not isinstance(terms, DataFrame):
        return [tuple(sorted({t for t in terms if t}))]
    known = terms.select(F.col(term).cast("string").alias("t")).where("t <> ''").distinct()
    size = known.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // ROUND_BYTES))
    return [tuple(sorted(r[0] for r in known.where(F.pmod(F.xxhash64("t"), F.lit(n)) == i).collect())) for i in range(n)]


def _found(rows: DataFrame, keys: list[str], text: str, terms: DataFrame | list[str], term: str, once: bool) -> DataFrame:
    parts = [_pass(rows, keys, text, part, term, once) for part in _rounds(terms, term)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def occurrences(rows: DataFrame, keys: list[str], text: str, terms: DataFrame | list[str], term: str = "term") -> DataFrame:
    """(keys, term, start) of every place of every term, overlapping and nested ones too; places count code points from 0."""
    return _found(rows, keys, text, terms, term, False)


def contained(rows: DataFrame, keys: list[str], text: str, terms: DataFrame | list[str], term: str = "term") -> DataFrame:
    """(keys, term, start, n) once for every row and term it contains: the first place, and the number of places."""
    return _found(rows, keys, text, terms, term, True)


def contained_within(holders: DataFrame, parts: DataFrame, group: str, text: str, part: str) -> DataFrame:
    """(group, text, part): every distinct part that a distinct text of the same group contains; empty parts are none.

    Both may be as many as rows, so neither is handed to the tasks: the runs of a
    text that are as long as a part of its group, and may be one by 64 bits that
    its group's parts of that length set, meet the parts by equality.
    """
    head, number = lambda t, n: F.substring(t, F.lit(1), F.least(n, F.lit(16))), F.length(part).alias("__n")
    bit = lambda t, n: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(head(t, n)), F.lit(64)).cast("int"))
    known = parts.select(group, F.col(part).cast("string").alias(part)).where(F.length(part) > 0).distinct()
    lengths = known.groupBy(group, number).agg(F.bit_or(bit(F.col(part), F.length(part))).alias("__bits")).groupBy(group).agg(F.collect_list(F.struct("__n", "__bits")).alias("__lengths"))
    texts = holders.select(group, F.col(text).cast("string").alias(text)).where(F.length(text) > 0).distinct()
    size, t = F.length(text), F.col(text)
    runs = lambda x: F.transform(F.sequence(F.lit(1), size - x["__n"] + 1), lambda i: F.substring(t, i, x["__n"]))
    likely = lambda x: F.filter(runs(x), lambda r: bit(r, x["__n"]).bitwiseAND(x["__bits"]) != 0)
    held = F.array_distinct(F.flatten(F.transform(F.filter("__lengths", lambda x: x["__n"] <= size), likely)))
    cut = texts.join(lengths.hint("merge"), group).select(group, text, F.explode(held).alias(part))
    return cut.join(known.hint("merge"), [group, part]).select(group, text, part)


def subject_tables(tables: DataFrame, keys: list[str], name: str, headers: str, rows: str, subjects: DataFrame | list[str], subject: str = "subject") -> DataFrame:
    """(keys, subject) once for every subject that stands in a table's name or in the first cell of a row.

    A table without a name goes by its first header.
    """
    labels = F.transform(F.coalesce(F.col(rows), F.array().cast("array<array<string>>")), lambda r: F.get(r, F.lit(0)))
    known = F.coalesce(F.nullif(F.col(name), F.lit("")), F.get(F.col(headers), F.lit(0)))
    text = F.concat_ws(PART, known, F.array_join(labels, PART))
    return contained(tables.select(*keys, text.alias("__where")), keys, "__where", subjects, subject).select(*keys, subject)


def summary_tables(tables: DataFrame, keys: list[str], rows: str, subjects: DataFrame | list[str], sample: int = 10, most: int = 2) -> DataFrame:
    """Keys of tables that list several subjects: more than ``most`` of the first ``sample`` rows name one."""
    lines = tables.select(*keys, F.posexplode(F.slice(F.col(rows), 1, sample)).alias("__line", "__cells"))
    text = F.array_join(F.transform("__cells", lambda c: F.coalesce(c, F.lit("None"))), " ")
    hits = contained(lines.select(*keys, "__line", text.alias("__where")), [*keys, "__line"], "__where", subjects, "__subject")
    return hits.groupBy(*keys).agg(F.count_distinct("__line").alias("n_lines")).where(F.col("n_lines") > most)


def without_blanks(text: Column) -> Column:
    """A text without comments and blanks, so that words broken over lines are whole."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), BLANK + "+", "")


def page_of(text: Column, word: Column) -> Column:
    """The page that the last marker before the first place of ``word`` names; blanks may stand inside the word. Null without either."""
    letters = F.transform(F.split(word, ""), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E")))
    spread = F.array_join(letters, BLANK + "*")
    before = F.call_function("regexp_extract", text, F.concat(F.lit("(?s)^(.*?)"), spread), F.lit(1))
    found = F.regexp_extract_all(before, F.lit(r"<!-- SOURCE[^>]*page=(\d+)[^>]*-->"), 1)
    return F.when(F.regexp_like(text, spread), F.try_element_at(found, F.lit(-1)))


def typos(documents: DataFrame, key: str, text: str, words: dict[str, str] = TYPOS, right: list[str] = WHOLE_WORDS, around: int = 20) -> DataFrame:
    """(key, typo, suggestion, context, page): a dictionary's wrong words, once a text.

    Comments and blanks are taken out first. A text that has a whole word which
    holds the wrong one has no such typo. The context is that of the first place;
    the page is that of the last marker before it in the text as it stands. One
    row a document and word, all the words of a document in one task.
    """
    bare = documents.select(key, F.col(text).alias("__raw"), without_blanks(F.col(text)).alias("__bare"))
    within = {w: [r for r in right if w in r] for w in words}
    found = contained(bare, [key, "__raw", "__bare"], "__bare", [*words, *{r for rs in within.values() for r in rs}])
    # Both are looked up in the text at hand, so nothing is joined back.
    covered = F.lit(False)
    for w, whole in within.items():
        for r in whole:
            covered = covered | ((F.col("term") == w) & F.contains(F.col("__bare"), F.lit(r)))
    hits = found.where(F.col("term").isin(list(words)) & ~covered)
    fix = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    start = F.greatest(F.col("start") - around, F.lit(0))
    context = F.substring(F.col("__bare"), start + 1, F.col("start") - start + F.length("term") + around)
    return hits.select(key, F.col("term").alias("typo"), F.try_element_at(fix, F.col("term")).alias("suggestion"), context.alias("context"), page_of(F.col("__raw"), F.col("term")).alias("page"))


def without_terms(findings: DataFrame, original: str = "original", suggestion: str = "suggestion", known: list[str] = AUDIT_TERMS) -> DataFrame:
    """Findings of wrong words that are no term of the trade: neither the word nor what should stand there is one, blanks between letters aside."""
    is_term = lambda c: F.coalesce(join_broken_cjk(F.col(c)).isin(known), F.lit(False))
    return findings.where(~is_term(original) & ~is_term(suggestion))
