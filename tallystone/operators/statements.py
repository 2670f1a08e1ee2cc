"""Statements out of table rows, and what a table is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.text import BLANK
from tallystone.operators.audit import TOLERANCE, Rule, severity

#: Currencies that mark a table of several currencies.
CURRENCIES = ["美元", "人民币", "欧元", "日元", "英镑", "港币", "林吉特", "瑞士法郎", "加元", "澳元", "韩元", "新台币", "新加坡元", "泰铢", "越南盾", "卢布"]
#: Words of a statement, which footing of notes leaves out.
STATEMENT_WORDS = ["资产总计", "负债合计", "所有者权益合计", "营业收入", "营业利润", "流动资产合计", "非流动资产合计", "流动负债合计", "非流动负债合计", "现金流量", "利润总额", "净利润"]
#: Printed names of items and the names that the rules know them by.
ALIASES = {
    "负债和所有者权益合计": "负债和所有者权益总计", "负债及所有者权益合计": "负债和所有者权益总计", "负债和股东权益总计": "负债和所有者权益总计", "负债及股东权益总计": "负债和所有者权益总计",
    "负债和股东权益合计": "负债和所有者权益总计", "负债及股东权益合计": "负债和所有者权益总计", "股东权益合计": "所有者权益合计", "归属于母公司股东的权益合计": "归属于母公司所有者权益合计",
    "营业总收入": "营业收入", "归属于母公司股东的净利润": "归属于母公司所有者的净利润",
    "年初现金及现金等价物余额": "期初现金及现金等价物余额", "年末现金及现金等价物余额": "期末现金及现金等价物余额", "现金及现金等价物净增加额": "现金及现金等价物净增加额",
    "上期期末余额": "上年年末余额", "上期末余额": "上年年末余额", "上年期末余额": "上年年末余额", "期初余额": "上年年末余额", "年初余额": "上年年末余额", "本年期初余额": "上年年末余额", "本期期初余额": "上年年末余额",
    "本期期末余额": "本年年末余额", "本年期末余额": "本年年末余额", "期末余额": "本年年末余额", "本年余额": "本年年末余额",
}
#: Words of headers of this period's and the last one's amounts.
CURRENT_WORDS, PRIOR_WORDS = ["期末", "本期", "本年", "当年"], ["期初", "上期", "上年", "年初"]

#: Operating profit from its terms; losses are taken off whatever sign they are printed with.
OPERATING_PROFIT = Rule(
    "R5",
    (
        (1, "营业收入", True), (-1, "营业成本", True), (-1, "税金及附加", False), (-1, "销售费用", False), (-1, "管理费用", False), (-1, "研发费用", False), (-1, "财务费用", False),
        (1, "其他收益", False), (1, "投资收益", False), (1, "公允价值变动收益", False), (1, "净敞口套期收益", False), (1, "资产处置收益", False),
    ),
    "营业利润",
)
LOSSES = ("信用减值损失", "资产减值损失")


def clean_item(name: Column) -> Column:
    """An item's name without blanks, leading numbers, 其中, 加 or 减, and parentheses that hold no digit.

    What leads is taken off once in each of these ways, with or without a mark
    after it; that also takes the first letter of 减值准备 and of 一年内到期, as the
    rules expect.
    """
    bare = F.regexp_replace(name, BLANK + "+", "")
    for lead in ("^[一二三四五六七八九十]+[、.．]*", "^[(（][一二三四五六七八九十]+[)）]", "^[(（]?\\d+[)）]?[、.．]*", "^其中[：:]*", "^[加减][：:]*"):
        bare = F.regexp_replace(bare, lead, "")
    return F.regexp_replace(bare, r"[（(][^()（）\d]*[)）]", "")


def canonical_name(name: Column) -> Column:
    """The name that the rules know an item by; others stay."""
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def canonical(items: DataFrame, aliases: DataFrame, item: str = "item") -> DataFrame:
    """Names replaced by an alias table (alias, name); others stay. Aliases are a reference list, joined by equality."""
    named = items.join(aliases.select(F.col("alias").alias(item), F.col("name").alias("__name")).dropDuplicates([item]), item, "left")
    return named.withColumn(item, F.coalesce("__name", item)).drop("__name")


def last_unless_zero(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """One value for each key: the last in order, but a zero never replaces another value."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(F.col(value) != 0, F.col(order))).alias(value))


def first_filled(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """One value for each key: the first in order that is neither null nor a blank or a dash."""
    return rows.where(F.col(value).isNotNull() & ~F.col(value).isin("", "-", "—")).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def matrix_statement(current: DataFrame, prior: DataFrame, item: str, order: str, value: str) -> DataFrame:
    """(item, current, prior) of two sheets: the first row of an item counts, absent values are empty text."""
    first = lambda rows, name: rows.groupBy(item).agg(F.min_by(F.col(value).cast("string"), order).alias(name))
    both = first(current, "current").join(first(prior, "prior"), item, "full")
    return both.select(item, F.coalesce("current", F.lit("")).alias("current"), F.coalesce("prior", F.lit("")).alias("prior"))


def operating_profit(items: DataFrame, key: str = "stmt", item: str = "item", value: str = "current") -> DataFrame:
    """Operating profit from revenue, cost and optional terms; losses are always taken off.

    A missing required item is a warning, as is a mismatch with any optional
    item missing; another mismatch is an error.
    """
    names = [n for _, n, _ in OPERATING_PROFIT.terms] + [*LOSSES, OPERATING_PROFIT.target]
    wide = items.groupBy(key).agg(*[F.max(F.when(F.col(item) == n, F.col(value).try_cast("decimal(24,4)"))).alias(n) for n in names])
    zero = F.lit(0).cast("decimal(24,4)")
    expected = sum((F.col(n) if required else F.coalesce(n, zero)) * s for s, n, required in OPERATING_PROFIT.terms)
    expected = expected - sum(F.abs(F.coalesce(n, zero)) for n in LOSSES)
    optional = [n for _, n, required in OPERATING_PROFIT.terms if not required] + list(LOSSES)
    n_missing = sum(F.col(n).isNull().cast("int") for n in optional)
    gap = F.abs(expected - F.col(OPERATING_PROFIT.target))
    passed = F.coalesce(gap <= TOLERANCE, F.lit(False))
    return wide.select(
        key, F.lit("R5").alias("rule_id"), expected.cast("double").alias("expected"), F.col(OPERATING_PROFIT.target).cast("double").alias("actual"), gap.cast("double").alias("difference"),
        passed.alias("passed"), severity(passed, gap.isNull() | (n_missing > 0)).alias("severity"), n_missing.alias("n_missing_optional"),
    )


def cash_increase(rows: DataFrame, flows: list[str], exchange: str, target: str) -> DataFrame:
    """Append ``stage`` and ``passed``: flows make the increase; the exchange effect is tried where they do not."""
    plain = sum(F.col(c) for c in flows)
    one = F.abs(plain - F.col(target)) <= TOLERANCE
    two = F.abs(plain + F.col(exchange) - F.col(target)) <= TOLERANCE
    stage = F.when(one, "flows").when(two, "with_exchange").otherwise("none")
    return rows.withColumn("stage", stage).withColumn("passed", F.col("stage") != "none")


def dispatch(statements: DataFrame, name: str, families: list[tuple[str, str]]) -> DataFrame:
    """Append ``family``: that of the first keyword a statement's name contains; null for unknown ones."""
    family = reduce(lambda out, f: out.when(F.col(name).contains(f[0]), F.lit(f[1])), families[1:], F.when(F.col(name).contains(families[0][0]), F.lit(families[0][1])))
    return statements.withColumn("family", family)


def table_class(text: Column, n_rows: Column, has_amount: Column, keywords: list[str]) -> Column:
    """four_statements by keyword, note_detail with amounts in two rows or more, else title."""
    hit = reduce(lambda a, b: a | b, [text.contains(k) for k in keywords])
    return F.when(hit, "four_statements").when(has_amount & (n_rows >= 2), "note_detail").otherwise("title")


def several_currencies(text: Column, currencies: list[str] = CURRENCIES) -> Column:
    """Two currencies or more in a text, which is made once for all of them."""
    return F.get(F.transform(F.array(text), lambda t: _several(t, currencies)), F.lit(0))


def _several(text: Column, currencies: list[str] = CURRENCIES) -> Column:
    return sum(text.contains(c).cast("int") for c in currencies) >= 2


def _stated(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in STATEMENT_WORDS])


def whole_text(headers: Column, rows: Column) -> Column:
    """Headers and cells in one text; empty without any. Tables without missing rows take the short way."""
    flat = lambda cells: F.array_join(cells, " ")
    return F.concat_ws(" ", flat(headers), F.coalesce(flat(F.flatten(rows)), flat(F.transform(rows, flat)), F.lit("")))


def multi_currency(headers: Column, rows: Column, sample: int = 30) -> Column:
    """Tables by currency, whose total is in one: two currencies in the headers and the first ``sample`` rows, and a row 合计."""
    total = F.exists(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.coalesce(F.get(r, F.lit(0)).contains("合计"), F.lit(False)))
    return several_currencies(whole_text(headers, F.slice(rows, 1, sample))) & total


def statement_text(headers: Column, rows: Column) -> Column:
    """True for tables that have a word of a statement in a header or a cell."""
    return F.get(F.transform(F.array(whole_text(headers, rows)), _stated), F.lit(0))


def not_to_foot(text: Column, headers: Column, rows: Column) -> Column:
    """``statement_text`` or ``multi_currency`` of tables whose ``whole_text`` is there already; rows are read again only where it has two currencies."""
    return _stated(text) | (_several(text) & multi_currency(headers, rows))


def numeric_shares(headers: Column, rows: Column) -> Column:
    """For every column, the share of the rows reaching it that have a digit there; null where none reaches it."""

    def share(_: Column, i: Column) -> Column:
        reaching = F.filter(rows, lambda r: F.size(r) > i)
        filled = F.filter(reaching, lambda r: F.coalesce(F.get(r, i).rlike(r"-?\d[\d,.]*"), F.lit(False)))
        return F.try_divide(F.size(filled).cast("double"), F.size(reaching))

    return F.transform(headers, share)


def linear_columns(headers: Column, shares: Column) -> Column:
    """Struct item_col, current_col, prior_col (from 0) of a statement's table.

    The item stands first. Amounts are told by their headers first: the first
    with a word of this period or the latest year of all headers is current, the
    first with a word of the last period or the year before is prior. Without a
    header, the columns with most digits take the places, the left one of equals,
    and then the second and the next one.
    """
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731 - computed once
    year = lambda h: F.regexp_extract(h, r"20\d\d", 0)
    years = F.reverse(F.array_sort(F.array_distinct(F.filter(F.transform(headers, year), lambda y: y != ""))))

    def place(words: list[str], rank: int) -> Column:
        told = lambda h: h.rlike("|".join(words)) | F.coalesce(year(h) == F.get(years, F.lit(rank)), F.lit(False))
        return F.get(F.filter(F.transform(headers, lambda h, i: F.when(told(h), i)), lambda i: i.isNotNull()), F.lit(0))

    def placed(said: Column) -> Column:
        ranked = F.array_sort(F.filter(F.transform(shares, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))), lambda x: x["s"].isNotNull() & (x["i"] > 0)))
        current = F.coalesce(said["current"], F.get(ranked, F.lit(0))["i"], F.when(F.size(headers) > 1, F.lit(1)).otherwise(F.lit(0)))
        prior = F.coalesce(said["prior"], F.get(ranked, F.lit(1))["i"], F.when(current + 1 < F.size(headers), current + 1).otherwise(current))
        return F.struct(F.lit(0).alias("item_col"), current.cast("int").alias("current_col"), prior.cast("int").alias("prior_col"))

    return bind(F.struct(place(CURRENT_WORDS, 0).alias("current"), place(PRIOR_WORDS, 1).alias("prior")), placed)


def column_roles(cells: DataFrame, table: str, column: str, header: str, share: str) -> DataFrame:
    """(table, item_col, current_col, prior_col) as ``linear_columns``, from one row a column; columns count from 0 without gaps."""
    whole = cells.groupBy(table).agg(F.array_sort(F.collect_list(F.struct(column, header, share))).alias("__c"))
    roles = linear_columns(F.transform("__c", lambda c: F.coalesce(c[header], F.lit(""))), F.transform("__c", lambda c: c[share]))
    return whole.select(table, roles.alias("__r")).select(table, "__r.*")


def pair_by_rank(current: DataFrame, prior: DataFrame, group: str, order: str) -> DataFrame:
    """Tables of this year and last paired by their rank inside a group, as (group, rank, current, prior)."""
    ranked = lambda rows, name: rows.select(group, F.row_number().over(Window.partitionBy(group).orderBy(order)).alias("rank"), F.col(order).alias(name))
    return ranked(current, "current").join(ranked(prior, "prior"), [group, "rank"])


def continued(sheets: DataFrame, statement: str, order: str, rows: str) -> DataFrame:
    """Rows of a statement's sheets, continuation sheets after the main one."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, rows))), lambda s: s[rows])
    return sheets.groupBy(statement).agg(F.flatten(parts).alias(rows))


def prior_matrices(mains: DataFrame, candidates: DataFrame, report: str, order: str, year: str, width: str, most: int = 2) -> DataFrame:
    """(report, order, prior) of each main matrix and the first candidate of its report with an earlier year and about its width.

    Both are (report, order, year, width). Widths may differ by ``most``; a
    candidate without a year is none, and a main table without one takes any.
    Candidates are put into the widths they fit, main tables among them, and one
    window over the years keeps the smallest order so far: no pairs are made.
    """
    fits = F.sequence(F.col(width) - most, F.col(width) + most)
    later = candidates.where(F.col(year).isNotNull()).select(report, F.col(order).alias("__prior"), F.col(year).alias("__y"), F.explode(fits).alias("__w"), F.lit(None).cast(mains.schema[order].dataType).alias(order))
    own = mains.select(report, F.lit(None).cast(candidates.schema[order].dataType).alias("__prior"), F.col(year).alias("__y"), F.col(width).alias("__w"), order)
    same = Window.partitionBy(report, "__w")
    before = same.orderBy("__y").rangeBetween(Window.unboundedPreceding, -1)
    found = F.when(F.col("__y").isNull(), F.min("__prior").over(same)).otherwise(F.min("__prior").over(before))
    return later.unionByName(own).withColumn("prior", found).where(F.col(order).isNotNull()).select(report, order, "prior")


#: Statements and the words that tell them where no name does; the first three have to be there.
TELLING_WORDS = {
    "合并资产负债表": ["资产总计", "流动资产合计", "非流动资产合计"], "母公司资产负债表": ["资产总计", "流动资产合计", "非流动资产合计"],
    "合并利润表": ["营业收入", "营业成本", "营业利润"], "母公司利润表": ["营业收入", "营业成本", "营业利润"],
    "合并现金流量表": ["经营活动现金流入小计", "经营活动现金流出小计", "投资活动现金流入小计"], "母公司现金流量表": ["经营活动现金流入小计", "经营活动现金流出小计", "投资活动现金流入小计"],
}


def tables_by_reference(references: DataFrame, tables: DataFrame, report: str, reference: str, table: str, order: str, name: str, rows: str, sample: int = 30) -> DataFrame:
    """(report, reference, table, stage) of the table that each reference means; the table is null where none does.

    References are texts. One that is a whole number is an id (stage ``id``) and
    nothing else. Others mean the first table whose name holds them or is held in
    them (``name``); what is left means the first table whose first ``sample`` rows
    have the first three words of a statement that holds the reference or is held
    in it (``words``). Each stage works on what the one before left. Names and
    references of a report meet by equality of what may be held, words are found by
    an automaton, so no reference meets every table. All of them may be as many as
    the tables, so none is sent to the driver or broadcast.
    """
    from tallystone.operators import terms

    asked = references.select(report, F.col(reference).cast("string").alias("__ref")).where("__ref is not null").distinct()
    known = tables.select(report, F.col(table).alias("__table"), F.col(order).alias("__order"), F.coalesce(F.col(name), F.lit("")).alias("__name"), F.col(rows).alias("__rows"))
    numbers, texts = asked.where(F.col("__ref").rlike(r"^\d+$")), asked.where(~F.col("__ref").rlike(r"^\d+$"))
    first = lambda found: found.groupBy(report, "__ref").agg(F.min_by("__table", "__order").alias("__table"))
    by_id = first(known.withColumn("__ref", F.col("__table").cast("string")).join(numbers.hint("merge"), [report, "__ref"]))

    # A reference in a name, and a name in a reference. Of the tables of one name the first one counts.
    named = known.where("__name <> ''").groupBy(report, "__name").agg(F.min_by("__table", "__order").alias("__table"), F.min("__order").alias("__order"))
    pairs = [terms.contained_within(named, texts, report, "__name", "__ref"), terms.contained_within(texts, named, report, "__ref", "__name")]
    by_name = first(pairs[0].unionByName(pairs[1]).join(named.hint("merge"), [report, "__name"]))

    left = texts.join(by_name.select(report, "__ref").hint("merge"), [report, "__ref"], "left_anti")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.array(*[F.lit(w) for w in words]).alias("words")) for k, words in TELLING_WORDS.items()])
    meant = left.select(report, "__ref", F.explode(kinds).alias("__k")).where(F.contains(F.col("__k.kind"), F.col("__ref")) | F.contains(F.col("__ref"), F.col("__k.kind")))
    text = F.array_join(F.transform(F.slice(F.coalesce("__rows", F.array().cast("array<array<string>>")), 1, sample), lambda r: F.array_join(r, " ")), " ")
    held = terms.contained(known.withColumn("__text", text), [report, "__table", "__order"], "__text", sorted({w for ws in TELLING_WORDS.values() for w in ws}), "__word")
    per_table = held.groupBy(report, "__table", "__order").agg(F.collect_set("__word").alias("__has"))
    of_kind = per_table.select(report, "__table", "__order", F.explode(F.filter(kinds, lambda k: F.size(F.array_intersect(k["words"], F.col("__has"))) == 3)).alias("__k"))
    by_words = first(meant.select(report, "__ref", F.col("__k.kind").alias("__kind")).join(of_kind.groupBy(report, F.col("__k.kind").alias("__kind")).agg(F.min_by("__table", "__order").alias("__table"), F.min("__order").alias("__order")).hint("merge"), [report, "__kind"]))

    found = by_id.withColumn("stage", F.lit("id")).unionByName(by_name.withColumn("stage", F.lit("name"))).unionByName(by_words.withColumn("stage", F.lit("words")))
    return asked.join(found.hint("merge"), [report, "__ref"], "left").select(report, F.col("__ref").alias(reference), F.col("__table").alias(table), "stage")
