"""Written formulas as Column expressions."""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallystone.functions.numbers import calculator_number


def compile_formula(formula: str, value: Callable[[str], Column]) -> Column:
    """A formula of names, numbers, ``+ - * / % ** //`` and parentheses as one Column.

    The formula is parsed once, on the driver; rows are computed by Spark. A
    division by zero and an unknown name's null give null. Anything else in the
    formula raises ValueError.
    """

    def build(node: ast.AST) -> Column:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.Name(id=name):
                return value(name)
            case ast.Constant(value=int() | float() as number) if not isinstance(number, bool):
                return F.lit(float(number))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -build(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return build(x)
            case ast.BinOp(left=left, op=op, right=right):
                a, b = build(left), build(right)
                match op:
                    case ast.Add():
                        return a + b
                    case ast.Sub():
                        return a - b
                    case ast.Mult():
                        return a * b
                    case ast.Div():
                        return F.try_divide(a, b)
                    case ast.FloorDiv():
                        return F.floor(F.try_divide(a, b)).cast("double")
                    case ast.Mod():
                        return a - F.floor(F.try_divide(a, b)) * b
                    case ast.Pow():
                        return F.pow(a, b)
        raise ValueError(f"not allowed in a formula: {ast.dump(node)}")

    try:
        return build(ast.parse(formula.replace(",", "").strip(), mode="eval"))
    except SyntaxError as e:
        raise ValueError(f"not a formula: {formula}") from e


#: Numbers, operators and brackets of a written formula.
TOKEN = r"(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?|\*\*|//|[-+*/%()])"
#: Operators as numbers, whose tens tell how tightly they bind; ``u-`` and ``u+`` are signs. Only ``**`` groups from the right.
OPERATORS = {"(": 0, "+": 10, "-": 11, "*": 20, "/": 21, "//": 22, "%": 23, "u-": 30, "u+": 31, "**": 40}
NUMBER, CLOSING = -1, -2
_STACKS = "struct<vals: array<double>, ops: array<int>, operand: boolean, ok: boolean>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _coded(token: Column) -> Column:
    """A token as (code, number): texts are looked at once, the fold compares numbers."""
    code = F.when(token == ")", CLOSING)
    for op, n in OPERATORS.items():
        code = code.when(token == op, n)
    # Only numbers are cast: a cast that fails costs more than all else.
    return F.get(F.transform(F.array(code.otherwise(NUMBER)), lambda c: F.struct(c.alias("code"), F.when(c == NUMBER, token.try_cast("double")).alias("number"))), F.lit(0))


def _applied(op: Column, a: Column, b: Column) -> Column:
    """a op b; null for a division by zero and for what is no real number."""
    quotient = F.try_divide(a, b)
    power = F.when((a == 0) & (b < 0), F.lit(None).cast("double")).otherwise(F.pow(a, b))
    is_ = lambda name: op == OPERATORS[name]
    found = F.when(is_("+"), a + b).when(is_("-"), a - b).when(is_("*"), a * b).when(is_("/"), quotient).when(is_("//"), F.floor(quotient).cast("double"))
    return found.when(is_("%"), a - F.floor(quotient) * b).when(is_("**"), F.when(~F.isnan(power), power))


def _popped(state: Column, least: Column) -> Column:
    """Operators on top that bind at least as tightly as ``least`` are carried out, down to an opening bracket."""
    start = F.struct(state["vals"].alias("vals"), state["ops"].alias("ops"), F.lit(False).alias("stop"))

    def step(acc: Column, op: Column) -> Column:
        vals, n = acc["vals"], F.size(acc["vals"])
        last, other = F.get(vals, n - 1), F.get(vals, n - 2)
        sign = (op == OPERATORS["u-"]) | (op == OPERATORS["u+"])
        value = F.when(op == OPERATORS["u-"], -last).when(op == OPERATORS["u+"], last).otherwise(_applied(op, other, last))
        rest = F.slice(vals, F.lit(1), F.greatest(n - F.when(sign, 1).otherwise(2), F.lit(0)))
        done = F.struct(F.concat(rest, F.array(value)).alias("vals"), F.slice(acc["ops"], F.lit(1), F.size(acc["ops"]) - 1).alias("ops"), F.lit(False).alias("stop"))
        halt = acc["stop"] | (op < least * 10)  # an opening bracket, too
        return F.when(halt, F.struct(acc["vals"].alias("vals"), acc["ops"].alias("ops"), F.lit(True).alias("stop"))).otherwise(done)

    return F.aggregate(F.reverse(state["ops"]), start.cast("struct<vals: array<double>, ops: array<int>, stop: boolean>"), step)


def _read(state: Column, token: Column) -> Column:
    """The stacks after one more token: values, operators, whether an operand is wanted, whether all was in order."""

    def made(vals: Column, ops: Column, operand: bool, ok: Column) -> Column:
        return F.struct(vals.alias("vals"), ops.alias("ops"), F.lit(operand).alias("operand"), ok.alias("ok")).cast(_STACKS)

    vals, ops, wanted, ok, code = state["vals"], state["ops"], state["operand"], state["ok"], token["code"]
    minus, plus, power = OPERATORS["-"], OPERATORS["+"], OPERATORS["**"]
    push = lambda x: F.concat(ops, F.array(x))
    number = made(F.concat(vals, F.array(token["number"])), ops, False, ok & wanted)
    opening = made(vals, push(F.lit(OPERATORS["("])), True, ok & wanted)
    sign = made(vals, push(F.when(code == minus, OPERATORS["u-"]).otherwise(OPERATORS["u+"])), True, ok & ((code == minus) | (code == plus)))
    # An operator that groups from the left carries out those that bind as tightly, a closing bracket all of them.
    least = F.when(code == CLOSING, 1).when(code == power, power // 10 + 1).otherwise(F.floor(code / 10).cast("int"))

    def after(p: Column) -> Column:
        top = F.get(p["ops"], F.size(p["ops"]) - 1)
        closing = made(p["vals"], F.slice(p["ops"], F.lit(1), F.greatest(F.size(p["ops"]) - 1, F.lit(0))), False, ok & ~wanted & F.coalesce(top == OPERATORS["("], F.lit(False)))
        return F.when(code == CLOSING, closing).otherwise(made(p["vals"], F.concat(p["ops"], F.array(code)), True, ok & ~wanted))

    unchanged = made(vals, ops, False, F.lit(False))
    return F.when(~ok, unchanged).when(code == NUMBER, number).when(code == OPERATORS["("], opening).when(wanted & (code != CLOSING), sign).otherwise(_bound(_popped(state, least), after))


def evaluate(formula: Column) -> Column:
    """The value of a formula of numbers that differs from row to row, as a double.

    ``+ - * / % ** //``, signs and brackets, with the usual precedence; commas
    are dropped, blanks part tokens. Null for a division by zero, for what is no
    formula, and for what is no finite real number. A fold over the tokens with
    two arrays as stacks; no Python worker.
    """
    start = F.struct(F.array().cast("array<double>").alias("vals"), F.array().cast("array<int>").alias("ops"), F.lit(True).alias("operand"), F.lit(True).alias("ok")).cast(_STACKS)

    def last(state: Column) -> Column:
        done = _bound(_popped(state, F.lit(1)), lambda p: F.when((F.size(p["ops"]) == 0) & (F.size(p["vals"]) == 1), F.get(p["vals"], F.lit(0))))
        return F.when(state["ok"] & ~state["operand"], done)

    def read(bare: Column) -> Column:
        # Two numbers that only a blank parts are two tokens, so the fold refuses them.
        tokens = F.transform(F.regexp_extract_all(bare, F.lit(TOKEN), 1), _coded)
        value = F.when(F.regexp_replace(bare, TOKEN + r"|\s", "") == "", F.aggregate(tokens, start, _read, last))
        return _bound(value, lambda v: F.when(F.abs(v) < F.lit(float("inf")), v))

    return _bound(F.translate(formula, ",", ""), read)


#: Fields that stand for each other where one has no value, in this order.
FIELD_SYNONYMS = {
    "年末余额": ["期末余额", "账面余额", "账面价值", "金额", "余额"],
    "期末余额": ["年末余额", "账面余额", "账面价值", "金额", "余额"],
    "账面价值": ["账面余额", "年末余额", "期末余额"],
    "账面余额": ["账面价值", "年末余额", "期末余额"],
    "本年发生额": ["发生额", "本年金额", "金额", "本期金额"],
    "本期金额": ["本年发生额", "发生额", "金额"],
}
#: Cells without a value.
BLANK_VALUES = ["", "-", "—"]


def _entries(values: Column) -> Column:
    return F.filter(F.map_entries(values), lambda e: e["value"].isNotNull() & ~e["value"].isin(BLANK_VALUES))


def value_of_field(values: Column, field: Column) -> Column:
    """The value under a name, or under the first name in the map's order that contains it."""
    known = _entries(values)
    exact = F.get(F.filter(known, lambda e: e["key"] == field), F.lit(0))["value"]
    return F.coalesce(exact, F.get(F.filter(known, lambda e: F.contains(e["key"], field)), F.lit(0))["value"])


def with_values(formula: Column, values: Column) -> Column:
    """A formula's names replaced by their amounts in brackets, longest names first; names without an amount stay."""
    amounts = F.transform(_entries(values), lambda e, i: F.struct((-F.length(e["key"])).alias("l"), i.alias("i"), e["key"].alias("key"), calculator_number(e["value"]).alias("value")))
    known = F.array_sort(F.filter(amounts, lambda e: e["value"].isNotNull() & (e["key"] != "")))
    return F.aggregate(known, formula, lambda text, e: F.replace(text, e["key"], F.concat(F.lit("("), e["value"].cast("string"), F.lit(")"))))


def note_value(formula: Column, field: Column, values: Column) -> Column:
    """What a note states, as text: its formula's value to two places, else its field's, else that of a synonym.

    Only what stands before an equals sign counts, and only formulas with + or
    - are computed; a name without an amount leaves the formula out.
    """
    written = F.trim(F.substring_index(F.coalesce(formula, F.lit("")), "=", 1))
    filled = with_values(written, values)
    value = F.when(written.rlike("[-+]") & ~filled.rlike("[\u4e00-\u9fa5]"), evaluate(filled))
    synonyms = F.lit(None).cast("array<string>")
    for name, others in FIELD_SYNONYMS.items():
        synonyms = F.when(field == name, F.array(*[F.lit(o) for o in others])).otherwise(synonyms)
    instead = F.get(F.filter(F.transform(synonyms, lambda s: value_of_field(values, s)), lambda v: v.isNotNull()), F.lit(0))
    named = F.when(F.coalesce(field, F.lit("")) != "", F.coalesce(value_of_field(values, field), instead))
    return F.coalesce(F.translate(F.format_number(value, 2), ",", ""), named)


def signed_sum(formula: Column, values: Column) -> Column:
    """A formula of names joined by + and - that differs from row to row, over a map of values.

    Null if a name has no value.
    """
    terms = F.regexp_extract_all(F.regexp_replace(formula, r"\s+", ""), F.lit(r"([-+]?[^-+]+)"), 1)

    def amount(term: Column) -> Column:
        got = F.try_element_at(values, F.regexp_replace(term, "^[-+]", ""))
        return F.when(term.startswith("-"), -got).otherwise(got)

    return F.aggregate(F.transform(terms, amount), F.lit(0.0), lambda s, x: s + x)


def is_subsequence(short: Column, long: Column) -> Column:
    """True if the characters of ``short`` stand in ``long`` in their order."""
    places = F.aggregate(F.split(short, ""), F.lit(1), lambda at, c: F.when((at > 0) & (F.position(c, long, at) > 0), F.position(c, long, at) + 1).otherwise(0))
    return (F.length(short) == 0) | (places > 0)
