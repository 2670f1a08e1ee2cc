"""Checks of a report's tables, notes and texts, and the roll-up of their results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.functions.formulas import signed_sum
from tallystone.functions.numbers import TOLERANCE, calculator_number, check_equal
from tallystone.operators.statements import not_to_foot, whole_text

#: Endings that a note's subject may have beyond the statement's item.
SUBJECT_ENDINGS = ["净值", "净额", "账面价值", "账面余额", "原值"]
#: Cells of a total row that hold no total.
NO_TOTAL = ["-", "—", "–", "——", "", "0", "0.00"]
#: Words of header rows below the headers, and of columns of percentages.
HEADER_WORDS = ["金额", "比例", "余额", "价值", "准备", "类别"]
PERCENT_WORDS = ["%", "比例", "百分比", "rate", "损失率", "计提比例", "占比"]
#: Row kinds of an annotation that hold totals, column kinds that are no amounts.
TOTAL_KINDS = ["total", "subtotal", "sum", "合计", "小计"]
RATIO_KINDS = ["percentage", "percent", "ratio"]
MONEY = "decimal(24,4)"


def _amount(text: Column) -> Column:
    """A cell's amount as an exact decimal: null for empty cells, those without a number, and numbers beyond MONEY."""
    return F.when(text != "", calculator_number(text)).try_cast(MONEY)


def _beyond(text: Column) -> Column:
    """True for cells whose number is too large to be summed exactly."""
    number = F.when(text != "", calculator_number(text))
    return number.isNotNull() & number.try_cast(MONEY).isNull()


def unreadable(cells: DataFrame, table: str, row: str, column: str, text: str) -> DataFrame:
    """(table, row, column, text) of cells whose number is too large to be summed; their columns do not pass."""
    return cells.where(_beyond(F.col(text))).select(table, row, column, text)


def foot_tables(cells: DataFrame, table: str, row: str, column: str, label: str, text: str, header: str | None = None) -> DataFrame:
    """Footing of every amount column of every table, from cells in long form.

    Rows labelled 合计 or 总计 (else 小计; a row that names both is a 小计) hold the
    total, the last such row counts, and no summary row is summed. Rows with 减 and
    a colon are taken off. A cell counts by the first number in it. Columns whose
    ``header`` tells of percentages, columns without a total and placeholder totals
    are left out; a mismatch is a warning, as is a number too large to be summed
    (then ``footed`` is null). One aggregation, combined before its shuffle.
    """
    if header is not None:
        cells = cells.where(~_of_percentages(F.col(header)))
    # Names and amounts are made once a cell, before the aggregation uses them several times.
    named = cells.select(table, column, row, _bare(F.col(label)).alias("__name"), F.col(text).alias("__text"))
    return _foot(_marked(named, table, column, row, "__text"), table, row, column)


def _of_percentages(header: Column) -> Column:
    return F.coalesce(F.lower(header).rlike("|".join(PERCENT_WORDS)), F.lit(False))


def _bare(label: Column) -> Column:
    return F.translate(F.coalesce(label, F.lit("")), " \t\r\n\u3000", "")


def _marked(named: DataFrame, *keep: str) -> DataFrame:
    """The columns to ``keep``, with __g, __s and __m by __name: rows of a total, of a subtotal, and to be taken off."""
    name = F.col("__name")
    grand = (name.contains("合计") | name.contains("总计")) & ~name.contains("小计")
    return named.select(*keep, grand.alias("__g"), name.contains("小计").alias("__s"), (name.contains("减") & name.rlike("[:：]")).alias("__m"))


def _foot(marked: DataFrame, table: str, row: str, column: str) -> DataFrame:
    """The footing of ``foot_tables`` from cells whose rows are marked."""
    text = F.col("__text")
    number = F.when(text != "", calculator_number(text))
    cells = marked.select(table, column, row, "__g", "__s", "__m", number.alias("__number"), F.trim(text).isin(NO_TOTAL).alias("__none"))
    cells = cells.withColumn("__value", F.col("__number").try_cast(MONEY))
    value = F.col("__value")
    grand, part, shown = F.col("__g"), F.col("__s"), ~F.coalesce("__none", F.lit(True))
    detail = F.when(~grand & ~part, F.when(F.col("__m"), -F.abs(value)).otherwise(value))
    sums = cells.groupBy(table, column).agg(
        F.sum(detail).alias("footed"),
        F.max_by(F.when(grand & shown, value), F.when(grand, F.col(row))).alias("__grand"), F.max(grand).alias("__has"),
        F.max_by(F.when(part & shown, value), F.when(part, F.col(row))).alias("__part"),
        F.max(F.col("__number").isNotNull() & value.isNull()).alias("__beyond"),
    )
    total = F.when(F.col("__has"), F.col("__grand")).otherwise(F.col("__part"))
    found = sums.withColumn("total", total).withColumn("footed", F.when(~F.col("__beyond"), F.col("footed")))
    found = found.where((F.col("total").isNotNull() & F.col("footed").isNotNull()) | F.col("__beyond"))
    gap = F.abs(F.col("total") - F.col("footed"))
    passed = F.coalesce(gap <= TOLERANCE, F.lit(False))
    return found.select(table, column, F.col("footed").cast("double").alias("footed"), F.col("total").cast("double").alias("total"), gap.cast("double").alias("difference"), passed.alias("passed"), F.when(passed, "info").otherwise("warning").alias("severity"))


def with_merged_headers(tables: DataFrame, headers: str, rows: str) -> DataFrame:
    """Header rows that stand among the rows move into the headers, column by column.

    Of two rows at least, the second is one if it is as long as the headers and
    has a header word, and takes the first along; else the first is one if it
    has a header word or its first cell repeats the first header. No shuffle.
    """
    t = tables.withColumn("__n", _header_rows(F.col(headers), F.col(rows)))
    kept = F.when(F.col("__n") == 0, F.col(rows)).otherwise(F.slice(rows, F.col("__n") + 1, F.greatest(F.size(rows) - F.col("__n"), F.lit(0))))
    return t.withColumns({headers: _joined_headers(F.col(headers), F.col(rows), F.col("__n")), rows: kept}).drop("__n")


def _header_rows(top: Column, body: Column) -> Column:
    """How many rows belong to the headers."""
    row = lambda i: F.get(body, F.lit(i))
    fits = lambda i: (F.size(body) >= 2) & (F.size(row(i)) == F.size(top))
    worded = lambda i: F.concat_ws(" ", row(i)).rlike("|".join(HEADER_WORDS))
    start = F.get(row(0), F.lit(0))
    repeated = (start != "") & start.contains(F.get(top, F.lit(0)))
    return F.when(fits(1) & worded(1), 2).when(fits(0) & (worded(0) | F.coalesce(repeated, F.lit(False))), 1).otherwise(0)


def _joined_headers(top: Column, body: Column, n: Column) -> Column:
    row = lambda i: F.get(body, F.lit(i))
    return F.transform(top, lambda h, i: F.concat_ws(" ", h, F.when(n > 0, F.get(row(0), i)), F.when(n > 1, F.get(row(1), i))))


def foot_matrices(tables: DataFrame, table: str, headers: str, rows: str) -> DataFrame:
    """``foot_tables`` of tables held as arrays of cells: header rows are merged, columns headed as percentages left out.

    Statements and tables of several currencies are left out. The first cell of
    a row is its label. The result's ``col`` counts from 0.
    """
    # Each step has a column of its own: a filter, or an array exploded by its name, would make the tables again for each condition.
    h, r = F.col(headers), F.col(rows)
    t = tables.select(table, headers, rows, whole_text(h, r).alias("__said"))
    t = t.select(table, headers, rows, not_to_foot(F.col("__said"), h, r).alias("__out"), _header_rows(h, r).alias("__n"))
    # Headers are read once a table and labels once a row, before there are cells.
    heads = F.transform(_joined_headers(h, r, F.col("__n")), lambda head, i: F.when((i > 0) & head.isNotNull() & ~_of_percentages(head), i))
    t = t.select(table, rows, "__out", "__n", F.filter(heads, lambda i: i.isNotNull()).alias("__columns"))
    lines = t.select(table, "__n", "__columns", F.posexplode(F.when(~F.col("__out"), r)).alias("row", "__cells")).where(F.col("row") >= F.col("__n"))
    lines = _marked(lines.withColumn("__name", _bare(F.get("__cells", F.lit(0)))), table, "row", "__columns", "__cells")
    cells = lines.select("*", F.explode(F.when(F.size("__cells") > 0, F.col("__columns"))).alias("col"))
    return _foot(cells.withColumn("__text", F.get("__cells", F.col("col"))), table, "row", "col")


def annotated_foot(cells: DataFrame, row_notes: DataFrame, column_notes: DataFrame, table: str, row: str, column: str, text: str) -> DataFrame:
    """Footing by annotation: the signed detail rows of every amount column against each of its total rows.

    Row notes are (table, row, kind, op, is_subitem): parts of another row are
    not summed. Column notes are (table, column, kind). Totals that are no number
    or placeholders are left out, as are columns without details. Cells meet their
    notes by keys, the last time by column: its cells are then sorted by column already,
    and a window adds the sum of the details to the totals without a further shuffle or sort.
    """
    kind = F.lower("kind")
    amount = (kind == "amount") | (~F.col("kind").isin(RATIO_KINDS) & kind.contains("amount"))
    noted = cells.select(table, row, column, text).join(row_notes.select(table, row, F.col("kind").alias("__kind"), "op", "is_subitem"), [table, row])
    noted = noted.join(column_notes.where(amount).select(table, column).distinct(), [table, column]).withColumn("__value", _amount(F.col(text)))
    is_total = F.col("__kind").isin(TOTAL_KINDS) & ~F.trim(F.col(text)).isin(NO_TOTAL) & F.col("__value").isNotNull()
    detail = F.when((F.col("__kind") == "detail") & ~F.coalesce("is_subitem", F.lit(False)), F.when(F.col("op") == "-", -F.col("__value")).otherwise(F.col("__value")))
    marked = noted.select(table, row, column, F.col("__value").alias("total"), is_total.alias("__total"), detail.alias("__detail"))
    summed = marked.withColumn("footed", F.sum("__detail").over(Window.partitionBy(table, column)))
    both = summed.where(F.col("__total") & F.col("footed").isNotNull())
    gap = F.abs(F.col("total") - F.col("footed"))
    passed = gap <= TOLERANCE
    return both.select(table, row, column, F.col("footed").cast("double").alias("footed"), F.col("total").cast("double").alias("total"), gap.cast("double").alias("difference"), passed.alias("passed"), F.when(passed, "info").otherwise("warning").alias("severity"))


@dataclass(frozen=True)
class Pattern:
    """A relation across a row: header patterns of signed operands and of the result."""

    id: str
    operands: tuple[tuple[int, str], ...]
    result: str


#: Relations across a note's row by its headers, tried in this order.
CROSS_PATTERNS = (
    Pattern("A", ((1, "余额"), (-1, "准备")), "价值"),
    Pattern("B", ((1, "期初"), (1, "增加"), (-1, "减少")), "期末"),
    Pattern("C", ((1, "原价|原值"), (-1, "折旧"), (-1, "减值")), "净值|价值"),
)


#: Words that give a header its role, in this order; every header has one role at most.
CHAIN = (("余额", "balance"), ("坏账准备|减值准备", "provision"), ("^(?!.*价值).*准备", "provision"), ("价值", "net"), ("期初", "opening"), ("增加", "increase"), ("减少", "decrease"), ("期末", "closing"), ("原价|原值", "cost"), ("折旧", "depreciation"), ("减值", "impairment"), ("净值", "carrying"))
#: The relations by roles: 期初余额 and 期末余额 are balances here, so B needs headers such as 期初数, and C needs 净值.
CHAIN_PATTERNS = (
    Pattern("A", ((1, "^balance$"), (-1, "^provision$")), "^net$"),
    Pattern("B", ((1, "^opening$"), (1, "^increase$"), (-1, "^decrease$")), "^closing$"),
    Pattern("C", ((1, "^cost$"), (-1, "^depreciation$"), (-1, "^impairment$")), "^carrying$"),
)


def header_roles(headers: Column) -> Column:
    """Every header's role by the chain of words; empty text where no word stands in it."""

    def role(h: Column) -> Column:
        out = F.when(h.rlike(CHAIN[0][0]), CHAIN[0][1])
        for words, name in CHAIN[1:]:
            out = out.when(h.rlike(words), name)
        return out.otherwise("")

    return F.transform(headers, role)


def _column_of(headers: Column, pattern: str) -> Column:
    """Place (from 0) of the last header that matches; null if none does."""
    places = F.filter(F.transform(headers, lambda h, i: F.when(h.rlike(pattern), i)), lambda i: i.isNotNull())
    return F.try_element_at(places, F.lit(-1))


def cross_foot_tables(rows: DataFrame, headers: str, cells: str, patterns: tuple[Pattern, ...] | None = None, chain: bool = False) -> DataFrame:
    """Append pattern, expected, actual and passed: the first pattern whose headers are all there.

    With ``chain`` headers are told by ``header_roles``, one role a header, which
    finds fewer relations. Empty cells and dashes are zero; null where no pattern
    fits, a row is too short or a cell is no amount. Row-wise, no shuffle.
    """
    known = patterns or (CHAIN_PATTERNS if chain else CROSS_PATTERNS)
    # Each step has a column of its own, so that roles, places and amounts are made once a row.
    out = rows.withColumn("__heads", header_roles(F.col(headers)) if chain else F.col(headers))
    places = [F.array(*[_column_of(F.col("__heads"), h) for _, h in p.operands], _column_of(F.col("__heads"), p.result)) for p in known]
    out = out.withColumn("__all", F.transform(F.array(*places), lambda c: F.when(F.forall(c, lambda i: i.isNotNull()), c)))
    out = out.withColumn("__c", F.coalesce(*[F.when(F.get("__all", F.lit(n)).isNotNull(), F.struct(F.lit(n).alias("n"), F.get("__all", F.lit(n)).alias("places"))) for n in range(len(known))]))
    amount = lambda c: calculator_number(F.coalesce(F.get(F.col(cells), c), F.lit(""))).try_cast(MONEY)
    out = out.withColumn("__v", F.when(F.size(F.col(cells)) > F.array_max("__c.places"), F.transform("__c.places", amount)))
    value = lambda i: F.get("__v", F.lit(i))
    found = [F.struct(F.lit(p.id).alias("pattern"), sum(value(i) * s for i, (s, _) in enumerate(p.operands)).cast("double").alias("expected"), value(len(p.operands)).cast("double").alias("actual")) for p in known]
    out = out.withColumn("__c", F.coalesce(*[F.when(F.col("__c.n") == n, f) for n, f in enumerate(found)])).drop("__heads", "__all", "__v")
    gap = F.round(F.abs(F.col("__c.expected") - F.col("__c.actual")), 6)
    return out.select("*", F.col("__c.pattern").alias("pattern"), F.col("__c.expected").alias("expected"), F.col("__c.actual").alias("actual"), (gap <= TOLERANCE).alias("passed")).drop("__c")


def annotated_cross_foot(rows: DataFrame, annotations: DataFrame, table: str, values: str) -> DataFrame:
    """Append expected, actual and passed by each table's annotation (operands, result_col).

    Operands are structs (col, op) with op + or -; places beyond a row and empty
    cells add nothing, a cell that is no amount leaves the row open. Cells are
    amounts or written ones. The join is on the
    table's id; the sum runs over the array, so rows are not multiplied.
    """
    both = rows.join(annotations, table)
    written = isinstance(rows.schema[values].dataType.elementType, T.StringType)
    amount = lambda c: (calculator_number(c) if written else c).try_cast(MONEY)
    empty = lambda c: c.isNull() | (c == "") if written else c.isNull()
    place = lambda o: F.get(F.col(values), o["col"])
    part = lambda o: F.when(empty(place(o)), F.lit(0).cast(MONEY)).otherwise(amount(place(o))) * F.when(o["op"] == "-", -1).when(o["op"] == "+", 1).otherwise(0)
    expected = F.aggregate("operands", F.lit(0).cast("decimal(36,4)"), lambda s, o: (s + part(o)).cast("decimal(36,4)"))
    actual = amount(F.get(F.col(values), F.col("result_col")))
    return both.withColumn("expected", expected.cast("double")).withColumn("actual", actual.cast("double")).withColumn("passed", F.coalesce(F.abs(expected - actual) <= TOLERANCE, F.lit(False))).drop("operands", "result_col")


def replace_annotated(found: DataFrame, annotated: DataFrame, table: str) -> DataFrame:
    """Results by annotation take the place of code results on the same tables."""
    return found.join(annotated.select(table), table, "left_anti").unionByName(annotated)


def note_tie_out(notes: DataFrame, statements: DataFrame) -> DataFrame:
    """Notes (subject, formula, values) against statements (item, scope, current).

    The formula's names are looked up in the note's map of values. The
    statement's item is the subject itself or the subject without an ending,
    consolidated statements first. No item: info; no value: warning; else an
    error unless both agree.
    """
    names = F.array_distinct(F.array(F.col("subject"), F.regexp_replace("subject", f"(?:{'|'.join(SUBJECT_ENDINGS)})$", "")))
    asked = notes.select("subject", signed_sum(F.col("formula"), F.col("values")).alias("note"), F.posexplode(names).alias("__k", "item"))
    rank = F.struct((F.col("scope") != "consolidated").alias("a"), F.col("__k").alias("b"))
    found = asked.join(statements.select("item", "scope", "current"), "item", "left")
    best = found.groupBy("subject").agg(F.first("note", ignorenulls=True).alias("note"), F.min_by("current", F.when(F.col("current").isNotNull(), rank)).alias("stated"))
    passed = F.col("stated").isNull() | check_equal(F.col("note"), F.col("stated"))
    level = F.when(passed, "info").when(F.col("note").isNull(), "warning").otherwise("error")
    return best.select("subject", "note", "stated", passed.alias("passed"), level.alias("severity"))


def candidates(rows: DataFrame, key: str, confidence: str, value: str, stated: str, name_hit: str, order: str) -> DataFrame:
    """The best candidate table of each subject after its confidence is corrected.

    Values within 5% raise it by 0.2 (at most 0.95), else a name hit by 0.1 (at
    most 0.8), else it loses 0.3 (at least 0.4); under 0.5 nothing starts, under
    0.6 nothing is accepted.
    """
    near = F.abs(F.col(value) - F.col(stated)) <= F.abs(F.col(stated)) * 0.05
    c = F.col(confidence)
    corrected = F.when(near, F.least(F.lit(0.95), c + 0.2)).when(F.col(name_hit), F.least(F.lit(0.8), c + 0.1)).otherwise(F.greatest(F.lit(0.4), c - 0.3))
    kept = rows.where(c >= 0.5).withColumn("corrected", F.round(corrected, 6)).where("corrected >= 0.6")
    return kept.groupBy(key).agg(F.max_by(order, F.struct(F.col("corrected"), -F.col(order))).alias(order), F.max("corrected").alias("corrected"))


def continuity(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Missing numbers of each key: info up to min(20, a tenth of those present), else a warning."""
    sums = rows.where(F.col(number).isNotNull()).groupBy(key).agg(F.count_distinct(F.col(number)).alias("n_present"), (F.max(number) - F.min(number) + 1).alias("__span"))
    missing = F.col("__span") - F.col("n_present")
    allowed = F.least(F.lit(20), F.floor(F.col("n_present") * 0.1))
    return sums.select(key, "n_present", missing.alias("n_missing"), F.when(missing == 0, "passed").when(missing <= allowed, "info").otherwise("warning").alias("verdict"))


def banded(findings: DataFrame, kind: str = "kind", confidence: str = "confidence") -> DataFrame:
    """Findings by confidence: typos from 0.5 on (errors from 0.85), grammar from 0.85 on."""
    c = F.col(confidence)
    kept = findings.where(((F.col(kind) == "typo") & (c >= 0.5)) | (c >= 0.85))
    return kept.withColumn("severity", F.when((F.col(kind) == "typo") & (c >= 0.85), "error").otherwise("warning"))


def effective_severity(passed: Column, level: Column) -> Column:
    """Errors and warnings of what failed; null for the rest."""
    return F.when(~passed & level.isin("error", "warning"), level)


def reviewed(results: DataFrame, decisions: DataFrame, key: str = "result_id") -> DataFrame:
    """Review decisions applied by id: a downgrade makes info, needs_review marks, confirm and none leave a result."""
    both = results.join(decisions.select(key, "decision").dropDuplicates([key]), key, "left")
    level = F.when(F.col("decision") == "downgrade", "info").otherwise(F.col("severity"))
    return both.withColumn("severity", level).withColumn("needs_review", F.coalesce(F.col("decision") == "needs_review", F.lit(False))).drop("decision")


def summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Totals, passed, errors, warnings and the share of issues in percent."""
    n = lambda c: F.sum(c.cast("long"))
    level = effective_severity(F.col("passed"), F.col("severity"))
    out = results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), n(F.col("passed")).alias("n_passed"), n(F.coalesce(level == "error", F.lit(False))).alias("n_error"), n(F.coalesce(level == "warning", F.lit(False))).alias("n_warning"))
    return out.withColumn("issue_rate", F.round(100.0 * (F.col("n_error") + F.col("n_warning")) / F.col("n"), 4))


def compliance(text: Column, missing: list[str], failing: list[str], advice: str) -> Column:
    """/ where nothing was found to judge by, then 不符合, 建议项 or 符合."""
    has = lambda words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    return F.when(text.isNull() | has(missing), "/").when(has(failing), "不符合").when(text.rlike(advice), "建议项").otherwise("符合")


def subject_tables(tables: DataFrame, subjects: DataFrame, table: str, text: str, subject: str) -> DataFrame:
    """(table, subject) once for each subject a table's words name; words meet subjects by equality."""
    words = tables.select(table, F.explode(F.array_distinct(F.split(text, r"\s+"))).alias(subject))
    return words.join(subjects.select(subject).distinct(), subject).select(table, subject)


def top_for_role(rows: DataFrame, key: str, score: str, order: str, n: int = 2, least: float = 0.5) -> DataFrame:
    """The best ``n`` tables of each role whose score is ``least`` or more."""
    over = Window.partitionBy(key).orderBy(F.desc(score), order)
    return rows.where(F.col(score) >= least).withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= n)
