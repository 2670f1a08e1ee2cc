"""What a report's tables are: filters, scores and places, one row a table.

A table is a row with its headers (array of text) and its rows (array of
arrays of text). Everything but ``split_scopes``, ``lookup`` and ``statement_pages``
is an expression over that row and shuffles nothing. Missing arrays count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.numbers import table_number
from tallystone.operators.statements import multi_currency, several_currencies

#: Words by which headers, totals and statements are known.
AMOUNT_HEADERS = ["金额", "余额", "价值", "合计", "小计", "元", "万元"]
NOTE_HEADERS = ["金额", "余额", "价值", "元", "万元", "合计", "小计", "总计"]
TOTAL_LABELS = ["合计", "总计", "小计"]
BALANCE_HEADERS = ["期末余额", "年初余额"]
ASSETS_TOTAL = "资产总计"
CLAIMS = ["负债合计", "所有者权益合计", "股东权益合计", "负债和所有者权益总计", "负债及所有者权益总计"]
LIABILITY_WORDS = ["负债合计", "负债和", "负债及"]
EQUITY_WORDS = ["所有者权益合计", "股东权益合计", "所有者权益（或股东权益）合计", "股东权益（或所有者权益）合计"]
INCOME_WORDS = ["营业收入", "营业成本", "营业利润", "利润总额", "净利润"]
CASH_WORDS = ["经营活动产生的现金流量", "投资活动产生的现金流量", "筹资活动产生的现金流量", "现金及现金等价物净增加额"]
EQUITY_ITEMS = ["股本", "资本公积", "盈余公积", "未分配利润", "所有者权益合计", "股东权益合计"]
PERIOD_HEADERS = r"20\d{2}|本期金额|上期金额|本年金额|上年金额"
MINORITY = "少数股东权益"
HEADER_ITEMS = ["项目", "项 目", "项  目"]
SIGNATURES = ["编制单位", "法定代表人", "金额单位", "校验", "主管会计", "会计机构"]
OTHER_ROLES = ["附注", "其他"]
EQUITY_OPENING, EQUITY_CLOSING = "上年年末余额", "本年年末余额"


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def share_of(text: Column, words: list[str]) -> Column:
    """Share of the words that a text contains."""
    return sum(text.contains(w).cast("int") for w in words) / len(words)


def _cells(array: Column) -> Column:
    return F.coalesce(array, F.array().cast("array<string>"))


def _rows(rows: Column) -> Column:
    return F.coalesce(rows, F.array().cast("array<array<string>>"))


def line(cells: Column) -> Column:
    return F.array_join(_cells(cells), " ")


def table_text(rows: Column) -> Column:
    return F.array_join(F.transform(_rows(rows), line), " ")


def _total_rows(rows: Column) -> Column:
    return F.filter(_rows(rows), lambda r: F.coalesce(has_any(F.get(r, F.lit(0)), TOTAL_LABELS), F.lit(False)))


def useful(headers: Column, rows: Column, most: int = 20, sample: int = 30) -> Column:
    """Tables worth a closer look: an amount header, then a total row or digits in 30% of the rows.

    Not those of two currencies or more (headers and the first ``sample`` rows)
    and not those of more than ``most`` rows, which footing by code covers.
    """
    rs, text = _rows(rows), line(headers)
    numeric = F.size(F.filter(rs, lambda r: line(r).rlike(r"\d")))
    currencies = several_currencies(F.concat_ws(" ", text, table_text(F.slice(rs, 1, sample))))
    amount = F.exists(_cells(headers), lambda h: F.coalesce(has_any(h, AMOUNT_HEADERS), F.lit(False)))
    return F.size(rs).between(1, most) & amount & ~currencies & ((F.size(_total_rows(rs)) > 0) | (numeric >= F.size(rs) * 0.3))


def note_table(headers: Column, rows: Column) -> Column:
    """Tables of the notes: an amount word in the headers, and no balances over more than 20 rows."""
    text = line(headers)
    return has_any(text, NOTE_HEADERS) & ~(has_any(text, BALANCE_HEADERS) & (F.size(_rows(rows)) > 20))


def names_subjects(rows: Column, subjects: list[str], sample: int = 10, most: int = 2) -> Column:
    """True for summaries: more than ``most`` of the first ``sample`` rows name an item of a statement.

    ``subjects`` are a statement's items, some hundreds at most, as one pattern.
    """
    if not subjects:
        return F.lit(False)
    pattern = "|".join(f"\\Q{s}\\E" for s in sorted(set(subjects)))
    return F.size(F.filter(F.slice(_rows(rows), 1, sample), lambda r: line(r).rlike(pattern))) > most


def candidate_reason(headers: Column) -> Column:
    """变动表 where some but not all of opening, closing, increase and decrease stand in the headers, else 复杂横加."""
    stands = lambda w: F.exists(_cells(headers), lambda h: F.coalesce(h.contains(w), F.lit(False)))
    n = sum(stands(w).cast("int") for w in ("期初", "期末", "增加", "减少"))
    return F.when(n.between(1, 3), "变动表").otherwise("复杂横加")


def prefiltered(tables: DataFrame, kind: str, headers: str, rows: str) -> DataFrame:
    """Note tables of one currency that a cross-footing may be sought in, with the reason."""
    return tables.where((F.col(kind) == "note_detail") & ~multi_currency(F.col(headers), F.col(rows))).withColumn("reason", candidate_reason(F.col(headers)))


def sheet_valid(rows: Column, item: Column, current: Column, prior: Column) -> Column:
    """Item cells in Chinese and digits in both amount columns, each in 30% of the rows that reach that column."""

    def enough(place: Column, pattern: str) -> Column:
        reaching = F.filter(_rows(rows), lambda r: F.size(r) > place)
        return F.size(F.filter(reaching, lambda r: F.coalesce(F.get(r, place).rlike(pattern), F.lit(False)))) >= F.size(reaching) * 0.3

    known = item.isNotNull() & current.isNotNull() & prior.isNotNull()
    return known & enough(item, "[一-龥]") & enough(current, r"\d") & enough(prior, r"\d")


def accepted_role(role: Column, confidence: Column, valid: Column) -> Column:
    """Roles kept: confidence of 0.6 or more after 0.3 is taken off where the sheet is not valid; no notes or others."""
    sure = F.when(valid, confidence).otherwise(F.greatest(F.lit(0.0), confidence - 0.3))
    return F.coalesce((F.round(sure, 9) >= 0.6) & ~role.isin(OTHER_ROLES), F.lit(False))


def balance_part(rows: Column) -> Column:
    """complete, assets or claims by the totals a table holds; null for no balance sheet."""
    text = table_text(rows)
    assets, claims = text.contains(ASSETS_TOTAL), has_any(text, CLAIMS)
    return F.when(assets & claims, "complete").when(assets, "assets").when(claims, "claims")


def statement_scores(headers: Column, rows: Column) -> Column:
    """Struct of scores (0 to 1): balance, income, cash, equity.

    A balance sheet with all totals has 1, a complete one 0.8, a half 0.5. The
    equity matrix counts from 0.6 on, and with four period headers or more.
    """
    text, part = table_text(rows), balance_part(rows)
    full = text.contains(ASSETS_TOTAL) & has_any(text, LIABILITY_WORDS) & has_any(text, EQUITY_WORDS)
    equity = share_of(text, EQUITY_ITEMS)
    periods = F.regexp_count(line(headers), F.lit(PERIOD_HEADERS))
    return F.struct(
        F.when(full, 1.0).when(part == "complete", 0.8).when(part.isNotNull(), 0.5).otherwise(0.0).alias("balance"), share_of(text, INCOME_WORDS).alias("income"), share_of(text, CASH_WORDS).alias("cash"),
        F.when((periods >= 4) & (equity >= 0.6), equity).otherwise(0.0).alias("equity"),
    )


def _last_place(places: Column) -> Column:
    return F.try_element_at(F.filter(places, lambda i: i.isNotNull()), F.lit(-1))


def matrix_value_column(headers: Column, rows: Column) -> Column:
    """Place (from 0) of a matrix's value: the last header with 合计, else the right-most column but the first with a digit, else the last."""
    heads = _cells(headers)
    total = _last_place(F.transform(heads, lambda h, i: F.when(h.contains("合计"), i)))
    filled = _last_place(F.transform(heads, lambda _, i: F.when((i > 0) & F.exists(_rows(rows), lambda r: F.coalesce(F.get(r, i).rlike(r"\d"), F.lit(False))), i)))
    return F.coalesce(total, filled, F.greatest(F.size(heads) - 1, F.lit(0)))


def header_year(headers: Column) -> Column:
    """The first year 20dd in the headers."""
    return F.regexp_extract(F.array_join(_cells(headers), "\n"), r"20\d{2}", 0).try_cast("int")


def matrix_period(headers: Column) -> Column:
    """A year, current or prior, whichever the first telling header says; empty text if none does."""
    said = F.transform(_cells(headers), lambda h: F.when(h.rlike(r"20\d{2}"), F.regexp_extract(h, r"20\d{2}", 0)).when(has_any(h, ["本期", "本年"]), "current").when(has_any(h, ["上期", "上年"]), "prior"))
    return F.coalesce(F.get(F.array_compact(said), F.lit(0)), F.lit(""))


def skipped_item(name: Column, raw: Column) -> Column:
    """Rows that are no item: headers, signatures and parts listed under 其中."""
    return F.coalesce(name, F.lit("")).isin("", *HEADER_ITEMS) | F.coalesce(has_any(raw, SIGNATURES), F.lit(False)) | name.contains("其中")


def table_total(rows: Column, column: Column | None = None) -> Column:
    """The first total row's amount, else the sum of the column.

    Without a column, the first cell with an amount of that row, else the sum
    of the first column with amounts.
    """
    rs = _rows(rows)
    total = F.get(_total_rows(rs), F.lit(0))
    add = lambda place: F.aggregate(F.array_compact(F.transform(rs, lambda r: table_number(F.get(r, place)))), F.lit(None).cast("double"), lambda s, x: F.coalesce(s, F.lit(0.0)) + x)
    if column is not None:
        return F.when(total.isNotNull(), table_number(F.get(total, column))).otherwise(add(column))
    width = F.coalesce(F.array_max(F.transform(rs, F.size)), F.lit(0))
    sums = F.transform(F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>")), add)
    return F.when(total.isNotNull(), F.get(F.array_compact(F.transform(total, table_number)), F.lit(0))).otherwise(F.get(F.array_compact(sums), F.lit(0)))


def prompt_text(headers: Column, rows: Column) -> Column:
    """A table as lines of text: the headers, then each row with its number."""
    lines = F.transform(_rows(rows), lambda r, i: F.concat(i.cast("string"), F.lit(": "), line(r)))
    head = F.when(F.size(_cells(headers)) > 0, F.array(line(headers))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, lines), "\n")


def split_scopes(tables: DataFrame, keys: list[str], order: str, marked: Column | None = None) -> DataFrame:
    """Append ``scope``: of the first two tables of each statement one is consolidated, the other the parent's.

    The first is consolidated, or where a mark is given and it lacks it, the
    second; one alone is consolidated. Further tables have none.
    """
    over = Window.partitionBy(*keys)
    flag = F.lit(True) if marked is None else F.coalesce(marked, F.lit(False))
    ranked = tables.withColumn("__k", F.row_number().over(over.orderBy(order))).withColumn("__n", F.count(F.lit(1)).over(over))
    ranked = ranked.withColumn("__first", F.max(F.when(F.col("__k") == 1, flag)).over(over))
    scope = F.when(F.col("__k") > 2, None).when((F.col("__n") == 1) | ((F.col("__k") == 1) == F.col("__first")), "consolidated").otherwise("parent")
    return ranked.withColumn("scope", scope).drop("__k", "__n", "__first")


def lookup(items: DataFrame, key: str, item: str, value: str, order: str, names: dict[str, str]) -> DataFrame:
    """One row a statement with the named items' values as columns, the first of equal names, null where absent."""
    return items.where(F.col(item).isin(list(names.values()))).groupBy(key).agg(*[F.min_by(F.when(F.col(item) == n, F.col(value)), F.when(F.col(item) == n, F.col(order))).alias(c) for c, n in names.items()])


def equity_balances(items: DataFrame, key: str, item: str, value: str, order: str) -> DataFrame:
    """A statement of changes in equity has its opening and closing balances; what is between is not recomputed."""
    wide = items.groupBy(key).agg(*[F.min_by(F.when(F.col(item) == n, F.col(value)), F.when(F.col(item) == n, F.col(order))).alias(c) for c, n in (("opening", EQUITY_OPENING), ("closing", EQUITY_CLOSING))])
    passed = F.col("opening").isNotNull() & F.col("closing").isNotNull()
    shown = F.when(passed, F.col("closing"))
    return wide.select(key, F.lit("R10").alias("rule_id"), shown.alias("expected"), shown.alias("actual"), F.when(passed, 0.0).alias("difference"), passed.alias("passed"), F.when(passed, "info").otherwise("error").alias("severity"))


def mapped_tables(note_map: DataFrame, tables: DataFrame, ids: str, table: str) -> DataFrame:
    """A note map's rows with the tables they name: one row a named table that exists."""
    return note_map.withColumn(table, F.explode(ids)).drop(ids).join(tables, table)


def statement_pages(tables: DataFrame, page: str, order: str, text: Column, words: dict[str, list[str]]) -> DataFrame:
    """(statement, page) of the first paged table that holds any word of each statement; one pass, combined before its shuffle."""
    hits = F.array_compact(F.array(*[F.when(has_any(text, w), F.lit(name)) for name, w in words.items()]))
    found = tables.where(F.col(page).isNotNull()).select(F.explode(hits).alias("statement"), page, order)
    return found.groupBy("statement").agg(F.min_by(page, order).alias(page))
