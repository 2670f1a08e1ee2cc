"""Tie-outs, footing, cross-footing, identities and severities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystone.functions.numbers import TOLERANCE, check_equal


def severity(passed: Column, missing: Column | None = None) -> Column:
    """info for what holds, warning where a part is missing, else error."""
    out = F.when(passed, F.lit("info"))
    return (out.when(missing, F.lit("warning")) if missing is not None else out).otherwise(F.lit("error"))


def tie_out(stated: DataFrame, detail: DataFrame, key: str, amount: str, part: str) -> DataFrame:
    """Stated amounts against the sums of their details, in exact decimals.

    Details are summed before the join, so each key meets one row; keys without
    detail are warnings.
    """
    sums = detail.groupBy(key).agg(F.sum(F.col(part).try_cast("decimal(18,2)")).alias("__sum"))
    both = stated.select(key, F.col(amount).try_cast("decimal(18,2)").alias("__stated")).join(sums, key, "left")
    gap = F.col("__stated") - F.col("__sum")
    passed = F.coalesce(F.abs(gap) <= TOLERANCE, F.lit(False))
    return both.select(key, F.col("__stated").cast("double").alias("stated"), F.col("__sum").cast("double").alias("detail"), gap.cast("double").alias("difference"), passed.alias("passed"), severity(passed, F.col("__sum").isNull()).alias("severity"))


def footing(cells: DataFrame, table: str, amount: str, kind: str) -> DataFrame:
    """Sum of a table's detail rows against its total row; ``kind`` is detail, total or other."""
    value = F.col(amount).try_cast("decimal(18,2)")
    sums = cells.groupBy(table).agg(F.sum(F.when(F.col(kind) == "detail", value)).alias("footed"), F.max(F.when(F.col(kind) == "total", value)).alias("total"))
    gap = F.col("total") - F.col("footed")
    return sums.select(table, F.col("footed").cast("double").alias("footed"), F.col("total").cast("double").alias("total"), gap.cast("double").alias("difference"), F.coalesce(F.abs(gap) <= TOLERANCE, F.lit(False)).alias("passed"))


@dataclass(frozen=True)
class Rule:
    """An identity over a statement's items: signed terms that make the target."""

    id: str
    terms: tuple[tuple[int, str, bool], ...]  # sign, item, required
    target: str
    second: tuple[str, ...] = ()  # names of an item that is added only where the terms alone do not make the target


#: Names of the exchange effect.
EXCHANGE = ("汇率变动对现金的影响", "汇率变动对现金及现金等价物的影响", "汇率变动对现金的影响额")
#: Identities of the statements by their items' printed names.
IDENTITIES = (
    Rule("R1", ((1, "流动资产合计", True), (1, "非流动资产合计", True)), "资产总计"),
    Rule("R2", ((1, "流动负债合计", True), (1, "非流动负债合计", True)), "负债合计"),
    Rule("R3", ((1, "负债合计", True), (1, "所有者权益合计", True)), "负债和所有者权益总计"),
    Rule("R4", ((1, "资产总计", True),), "负债和所有者权益总计"),
    Rule("R6", ((1, "营业利润", True), (1, "营业外收入", False), (-1, "营业外支出", False)), "利润总额"),
    Rule("R7", ((1, "利润总额", True), (-1, "所得税费用", False)), "净利润"),
    Rule("R8", ((1, "经营活动产生的现金流量净额", True), (1, "投资活动产生的现金流量净额", True), (1, "筹资活动产生的现金流量净额", True)), "现金及现金等价物净增加额", EXCHANGE),
    Rule("R9", ((1, "期初现金及现金等价物余额", True), (1, "现金及现金等价物净增加额", True)), "期末现金及现金等价物余额"),
)


def identities(items: DataFrame, rules: tuple[Rule, ...] = IDENTITIES, key: str = "stmt", item: str = "item", value: str = "current") -> DataFrame:
    """Every rule on every statement: expected, actual, difference, passed and severity.

    One aggregation brings a statement's items side by side, whatever the number
    of rules. A missing required item or target fails; a mismatch with an
    optional item missing is a warning. A rule's second item is tried where its
    terms alone do not hold.
    """
    names = sorted({n for r in rules for _, n, _ in r.terms} | {r.target for r in rules} | {n for r in rules for n in r.second})
    place = {n: f"i{k}" for k, n in enumerate(names)}
    wide = items.groupBy(key).agg(*[F.max(F.when(F.col(item) == n, F.col(value).try_cast("decimal(24,4)"))).alias(place[n]) for n in names])
    checks = []
    for r in rules:
        needed = [F.col(place[n]).isNull() for _, n, required in r.terms if required] + [F.col(place[r.target]).isNull()]
        optional = [F.col(place[n]).isNull() for _, n, required in r.terms if not required]
        expected = sum((F.col(place[n]) if required else F.coalesce(F.col(place[n]), F.lit(0).cast("decimal(24,4)"))) * s for s, n, required in r.terms)
        if r.second:
            more = F.coalesce(*[F.col(place[n]) for n in r.second])
            expected = F.when((F.abs(expected - F.col(place[r.target])) > TOLERANCE) & more.isNotNull(), expected + more).otherwise(expected)
        gap = F.abs(expected - F.col(place[r.target]))
        passed = F.coalesce(gap <= TOLERANCE, F.lit(False))
        absent = F.lit(False)
        for x in needed:
            absent = absent | x
        partial = F.lit(False)
        for x in optional:
            partial = partial | x
        level = F.when(absent, F.lit("error")).otherwise(severity(passed, partial))
        checks.append(F.struct(F.lit(r.id).alias("rule_id"), expected.cast("double").alias("expected"), F.col(place[r.target]).cast("double").alias("actual"), gap.cast("double").alias("difference"), passed.alias("passed"), level.alias("severity")))
    return wide.select(key, F.explode(F.array(*checks)).alias("c")).select(key, "c.*")


def cross_foot(rows: DataFrame, terms: list[tuple[int, str]], result: str) -> DataFrame:
    """Append ``passed``: signed columns make the result column, in exact decimals."""
    total = sum(F.col(c).try_cast("decimal(24,4)") * s for s, c in terms)
    return rows.withColumn("passed", check_equal(total, F.col(result).try_cast("decimal(24,4)")))


def roll_forward(rows: DataFrame, period: str, movement: str) -> DataFrame:
    """Opening, movement and closing of each period; one row a period is expected, so the window is small."""
    over = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("closing", F.sum(movement).over(over)).withColumn("opening", F.col("closing") - F.col(movement))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """Count and percentage of each value, and a total row."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("__all"))
    named = counts.unionByName(total.select(F.lit("TOTAL").alias(by), F.col("__all").alias("n")))
    return named.join(F.broadcast(total)).select(by, "n", F.round(100.0 * F.col("n") / F.col("__all"), 4).alias("pct"))  # one row


def severity_matrix(results: DataFrame, by: str) -> DataFrame:
    one = lambda level: F.sum((F.col("severity") == level).cast("long")).alias(f"n_{level}")
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("n"), one("error"), one("warning"), one("info"))


def matrix_closure(cells: DataFrame, table: str, row: str, column: str, row_kind: str, column_kind: str, value: str) -> DataFrame:
    """Breaks of a matrix that has to close along both axes, such as a statement of changes in equity.

    Row kinds are opening, movement and closing: in every column opening and
    movements make the closing balance. Column kinds are part and total: in every
    row the parts make the total. One row for each break: axis (row or column), its
    place, expected, actual and difference (actual less expected). Rows and columns
    without their total have no break. Unknown kinds are left out; empty cells are 0.
    """
    amount = F.coalesce(F.col(value).try_cast("decimal(24,4)"), F.lit(0).cast("decimal(24,4)"))
    known = cells.select(table, F.col(row).cast("string").alias("__row"), F.col(column).cast("string").alias("__column"), F.col(row_kind).alias("__rk"), F.col(column_kind).alias("__ck"), amount.alias("__v"))
    known = known.where(F.col("__rk").isin("opening", "movement", "closing") & F.col("__ck").isin("part", "total"))

    def breaks(axis: str, place: str, kind: str, target: str) -> DataFrame:
        one = F.col(kind) == target
        sums = known.groupBy(table, F.col(place).alias("place")).agg(F.sum(F.when(~one, F.col("__v"))).alias("expected"), F.sum(F.when(one, F.col("__v"))).alias("actual"))
        gap = F.col("actual") - F.col("expected")
        return sums.where(F.abs(gap) > TOLERANCE).select(table, F.lit(axis).alias("axis"), "place", F.col("expected").cast("double").alias("expected"), F.col("actual").cast("double").alias("actual"), gap.cast("double").alias("difference"))

    return breaks("row", "__row", "__ck", "total").unionByName(breaks("column", "__column", "__rk", "closing"))


def broken_cells(cells: DataFrame, breaks: DataFrame, table: str, row: str, column: str, row_kind: str, column_kind: str) -> DataFrame:
    """(table, row, column, off): the one cell that explains a matrix's breaks, and by how much it is too large.

    Where just one row and one column break, and by the same amount under the
    signs of their crossing cell, that cell is it. Other matrices have no row.
    Both sides grow with the matrices, and plans take exploded cells for smaller
    than they are, so the join is merged, not broadcast.
    """
    pick = lambda axis, c: F.max(F.when(F.col("axis") == axis, F.col(c)))
    n = lambda axis: F.sum((F.col("axis") == axis).cast("int"))
    one = breaks.groupBy(table).agg(n("row").alias("__n"), n("column").alias("__m"), pick("row", "place").alias("__row"), pick("column", "place").alias("__column"), pick("row", "difference").alias("__dr"), pick("column", "difference").alias("__dc")).where("__n = 1 and __m = 1")
    places = cells.select(table, F.col(row).cast("string").alias("__row"), F.col(column).cast("string").alias("__column"), F.col(row_kind).alias("__rk"), F.col(column_kind).alias("__ck"))
    off_row = F.when(F.col("__ck") == "total", F.col("__dr")).otherwise(-F.col("__dr"))
    off_column = F.when(F.col("__rk") == "closing", F.col("__dc")).otherwise(-F.col("__dc"))
    found = one.hint("merge").join(places, [table, "__row", "__column"]).where(F.abs(off_row - off_column) <= TOLERANCE)
    return found.select(table, F.col("__row").alias(row), F.col("__column").alias(column), F.round(off_row, 4).alias("off"))


def equity_links(cells: DataFrame, statements: DataFrame, table: str, column: str, row_kind: str, value: str, item: str = "item", current: str = "current") -> DataFrame:
    """Closing balances of a matrix's columns against the balance sheet's items of the same names.

    Items without a column, and columns without an item, have no row.
    """
    closing = cells.where(F.col(row_kind) == "closing").groupBy(table, F.col(column).alias(item)).agg(F.sum(F.col(value).try_cast("decimal(24,4)")).alias("__matrix"))
    both = closing.join(statements.select(table, item, F.col(current).try_cast("decimal(24,4)").alias("__sheet")), [table, item])
    passed = F.coalesce(F.abs(F.col("__matrix") - F.col("__sheet")) <= TOLERANCE, F.lit(False))
    return both.select(table, item, F.col("__matrix").cast("double").alias("matrix"), F.col("__sheet").cast("double").alias("sheet"), passed.alias("passed"), severity(passed).alias("severity"))
