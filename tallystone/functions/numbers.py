"""Amounts as written in reports, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone.functions.text import BLANK

FULL_WIDTH = ("０１２３４５６７８９，．（）－＋　", "0123456789,.()-+ ")
#: Cells that stand for zero in an amount column.
ZERO_MARKS = ["", "-", "--", "—", "–", "_", "/"]
#: Cells that the calculator takes for zero.
CALCULATOR_ZEROS = ["", "-", "—", "–", "－", "_"]
#: Blanks at the ends of a text, Unicode ones too.
EDGES = f"^{BLANK}+|{BLANK}+$"
TOLERANCE = 0.01
SIMPLE = r"^-?(\d+|\d{1,3}(,\d{3})+)(\.\d+)?$"


def half_width(text: Column) -> Column:
    return F.translate(text, *FULL_WIDTH)


def parse_number(text: Column) -> Column:
    """A written amount as a double; null if there is no number in it.

    Empty cells and dashes are zero. Parentheses make it negative. Of two kinds
    of separators the last is the decimal one; a lone comma before exactly three
    digits separates thousands, before another number of digits decimals. 万
    and 亿 multiply. Amounts in digits with thousands' commas, the most of all, take
    one match and one cast.
    """
    simple = F.when(text.rlike(SIMPLE), F.translate(text, ",", "").try_cast("double"))
    return F.coalesce(simple, _any_number(text))


def _any_number(text: Column) -> Column:
    t = F.regexp_replace(half_width(F.coalesce(text, F.lit(""))), r"\s+", "")
    wrapped = t.rlike(r"(?s)^\(.*\)$")
    bare = F.regexp_replace(t, r"[()¥￥$€元]", "")
    european = bare.rlike(r"\..*,") | (bare.rlike(r"^[^,.]*,[^,.]*$") & ~bare.rlike(r",\d{3}(?!\d)"))
    plain = F.when(european, F.translate(F.translate(bare, ".", ""), ",", ".")).otherwise(F.translate(bare, ",", ""))
    value = F.regexp_extract(plain, r"[-+]?\d*\.?\d+", 0).try_cast("double")
    scale = F.when(bare.contains("亿"), F.lit(1e8)).when(bare.contains("万"), F.lit(1e4)).otherwise(F.lit(1.0))
    return F.when(t.isin(ZERO_MARKS), F.lit(0.0)).otherwise(F.when(wrapped, -F.abs(value)).otherwise(value) * scale)


def calculator_number(text: Column) -> Column:
    """A written amount as the checks' calculator reads it: as a double, null if there is no number in it.

    Empty texts and dashes are zero. The first number in the text counts, so
    ``12%`` is 12 and ``约3,000`` is 3000. Brackets around the whole make it
    negative. Of commas and points the last parts the decimals; a lone comma does
    so unless exactly three digits follow. 万 multiplies by 10,000 (亿 does not).
    Amounts in plain digits, the most of all, take one match and one cast.
    """
    simple = F.when(text.rlike(SIMPLE), F.translate(text, ",", "").try_cast("double"))
    return F.coalesce(simple, F.get(F.transform(F.array(F.coalesce(text, F.lit(""))), _calculated), F.lit(0)))


def _calculated(text: Column) -> Column:
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731 - computed once
    strip = lambda c: F.regexp_replace(c, EDGES, "")

    def read(half: Column) -> Column:
        wrapped = half.rlike(r"(?s)^\(.*\)$")
        inner = F.translate(F.when(wrapped, F.substring(half, F.lit(2), F.length(half) - 2)).otherwise(half), " ", "")

        def number(t: Column) -> Column:
            comma, point = F.length(t) - F.length(F.substring_index(t, ",", -1)), F.length(t) - F.length(F.substring_index(t, ".", -1))
            whole, rest = F.translate(F.substring(t, F.lit(1), comma), ".,", ""), F.substring(t, comma + 1, F.length(t))
            lone = t.rlike(r"^\d+,\d+$") & ~t.rlike(r"^\d+,\d{3}$")
            plain = F.when((comma > 0) & (point > 0) & (comma > point), F.concat(whole, F.lit("."), rest)).when(lone, F.translate(t, ",", ".")).otherwise(F.translate(t, ",", ""))
            value = F.regexp_extract(plain, r"[-+]?\d*\.?\d+", 0).try_cast("double")
            return F.when(wrapped, -value).otherwise(value)

        return bind(inner, number)

    value = bind(strip(F.translate(text, "，（）", ",()")), read) * F.when(text.contains("万"), F.lit(1e4)).otherwise(F.lit(1.0))
    return F.when(strip(text).isin(CALCULATOR_ZEROS), F.lit(0.0)).otherwise(value)


def table_number(text: Column) -> Column:
    """A cell's amount where a table's total is looked up: the first number, null for empty cells and dashes.

    Brackets around the whole make it negative; full-width ones are no brackets, and no unit multiplies.
    Amounts in plain digits take one match and one cast, and texts without a digit one match more.
    """
    simple = F.when(text.rlike(SIMPLE), F.translate(text, ",", "").try_cast("double"))
    return F.coalesce(simple, F.when(text.rlike(r"\d"), _looked_up(text)))


def _looked_up(text: Column) -> Column:
    bare = F.regexp_replace(text, EDGES, "")
    wrapped = bare.rlike(r"(?s)^\(.*\)$")
    value = F.regexp_extract(F.translate(bare, ", ", ""), r"-?\d+\.?\d*", 0).try_cast("double")
    return F.when(~bare.isin(CALCULATOR_ZEROS), F.when(wrapped, -value).otherwise(value))


def clean_number_cell(text: Column) -> Column:
    """Drop blanks inside a cell that is a number otherwise; null becomes empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t　]+", "")
    return F.when(bare.rlike(r"^[-+(]?[\d,.]*\d[\d,.]*[)%]?$"), bare).otherwise(F.coalesce(text, F.lit("")))


def sum_numbers(text: Column) -> Column:
    """Sum of the numbers in a text, signs kept."""
    found = F.transform(F.regexp_extract_all(F.translate(text, ",", ""), F.lit(r"([-+]?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    return F.aggregate(found, F.lit(0.0), lambda a, x: a + x)


def difference(a: Column, b: Column) -> Column:
    return F.round(F.abs(a - b), 6)


def check_equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """True within the tolerance; unknown amounts never match."""
    return F.coalesce(difference(a, b) <= tolerance, F.lit(False))


def reconcile(opening: Column, increase: Column, decrease: Column, closing: Column) -> Column:
    return check_equal(opening + increase - decrease, closing)


def parse_ratio(text: Column) -> Column:
    """A percentage; whatever is none counts as 0."""
    return F.coalesce(F.trim(F.replace(text, F.lit("%"), F.lit(""))).try_cast("double"), F.lit(0.0))


def parse_capital(text: Column) -> Column:
    value = F.regexp_extract(F.translate(text, ",", ""), r"\d+(?:\.\d+)?", 0).try_cast("double")
    return value * F.when(text.contains("亿"), F.lit(1e8)).when(text.contains("万"), F.lit(1e4)).otherwise(F.lit(1.0))


def found_year(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")
