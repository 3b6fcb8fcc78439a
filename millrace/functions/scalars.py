"""Scalar operators as Spark columns, with the dialect's types, nulls, NaN and errors.

All stay JVM-side: comparisons, arithmetic and CASE inside code generation; no Python UDF.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import ValueError_
from millrace.plans.constants import MOST, NUMBERS, VERBS, compute, like_pattern, show, type_of
from millrace.plans.syntax import Call, Field, Hole, Literal, Op

SPARK_TYPES = {"BOOLEAN": "boolean", "INTEGER": "bigint", "FLOAT": "double", "STRING": "string"}


class Typed:
    """A column, its dialect type (None: NULL) and, if it is one, the constant."""

    def __init__(self, column: Column, kind: str | None, constant: bool = False, value=None, instant: tuple[Column, str] | None = None):
        self.column, self.kind, self.constant, self.value = column, kind, constant, value
        #: The timestamp whose text the column is, and its Spark type.
        self.instant = instant

    def __str__(self) -> str:
        return show(self.value) if self.constant else str(self.kind)

    def cast(self, kind: str) -> Column:
        return self.column if self.kind == kind else self.column.cast(SPARK_TYPES[kind])


def literal(v, kind: str | None = None) -> Typed:
    kind = kind or type_of(v)
    return Typed(F.lit(v).cast(SPARK_TYPES[kind or "BOOLEAN"]), kind, True, v)


def float_divide(a: Column, b: Column) -> Column:
    """IEEE division: no error at zero. The branch with the division never sees a zero."""
    same_sign = (a > 0) == (b.cast("string") != "-0.0")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(same_sign, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b != 0, a / b).otherwise(by_zero)


def float_modulo(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b != 0, a % b).otherwise(F.lit(float("nan")))


def whole_power(a: Column, n: int) -> Column:
    """a to a constant whole power, with overflow errors, as a product of columns."""
    if n == 0:
        return F.when(a.isNull(), F.lit(None).cast("bigint")).otherwise(F.lit(1).cast("bigint"))
    if n > 64:  # only -1, 0 and 1 have such powers
        return F.when(a.between(-1, 1), whole_power(a, 2 + n % 2)).when(a.isNotNull(), F.raise_error(F.lit("Integer overflow")).cast("bigint"))
    out = a
    for _ in range(n - 1):
        out = out * a
    return out


def column_power(a: Column, b: Column) -> Column:
    """a to the power of another column, both INTEGER: squares (null beyond the range) where b has bits. A negative power
    of -1 or 1 is whole; others are an error, as a column has one type."""
    wrong = lambda text: F.raise_error(F.lit(text)).cast("bigint")
    odd = F.pmod(b, F.lit(2)) == 1
    unit = F.when(a == 1, F.lit(1)).when(a == -1, F.when(odd, F.lit(-1)).otherwise(F.lit(1))).when(b == 0, F.lit(1)).when(b > 0, F.lit(0)).otherwise(wrong("Integer power with negative exponent"))
    out, square = F.lit(1).cast("bigint"), a
    for k in range(6):
        out = F.when(F.shiftright(b, k).bitwiseAND(1) == 1, F.try_multiply(out, square)).otherwise(out)
        square = F.try_multiply(square, square)
    whole = F.when(b < 0, wrong("Integer power with negative exponent")).when(b > 63, F.lit(None).cast("bigint")).otherwise(out)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("bigint")).when(a.between(-1, 1), unit.cast("bigint")).otherwise(F.coalesce(whole, wrong("Integer overflow")))


def factorial(x: Column) -> Column:
    wrong = F.when(x < 0, F.raise_error(F.lit("Can't take factorial of negative number")).cast("bigint")).when(x > 20, F.raise_error(F.lit("Integer overflow")).cast("bigint"))
    return wrong.otherwise(F.factorial(x.cast("int")))


def like(text: Column, pattern: Typed) -> Column:
    if pattern.constant:
        return text.rlike("(?d)^(?:" + like_pattern(pattern.value) + ")\\z")
    p = F.regexp_replace(pattern.column, r"([\\.^$|?*+()\[\]{}\-&~#])", r"\\$1")
    for old, new in (("%%", "\x01"), ("__", "\x02"), ("%", ".*"), ("_", "."), ("\x01", "%"), ("\x02", "_")):
        p = F.replace(p, F.lit(old), F.lit(new))
    return F.rlike(text, F.concat(F.lit("(?d)^(?:"), p, F.lit(")\\z")))


_INSTANT = re.compile(r"\d{4}-\d\d-\d\d( \d\d:\d\d:\d\d(\.\d{0,5}[1-9])?)?")


def compare_instants(op: str, a: Typed, text: str) -> Column | None:
    """A timestamp's text with a constant, as a comparison of timestamps, which scans can use; None where the constant
    doesn't look like such a text. A date is a text before its midnight's and after all earlier ones."""
    column, kind = a.instant
    if not _INSTANT.fullmatch(text):
        return None
    try:
        datetime.fromisoformat(text)
    except ValueError:
        return None
    value = F.lit(text if kind == "timestamp_ntz" else f"{text if len(text) > 10 else text + ' 00:00:00'}Z").cast(kind)
    if len(text) == 10:
        return {"<": column < value, "<=": column < value, ">": column >= value, ">=": column >= value}.get(op)
    return {"=": column == value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[op]


def compare(op: str, a: Typed, b: Typed) -> Column:
    """Equal for NaN only to what IEEE says. Conjunctions keep scans' and joins' own filters usable."""
    if b.instant and a.constant:
        a, b, op = b, a, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
    if a.instant and b.constant and isinstance(b.value, str):
        found = compare_instants(op, a, b.value)
        if found is not None:
            return found
    if {a.kind, b.kind} <= {"INTEGER"} or "FLOAT" not in (a.kind, b.kind):
        x, y = a.column, b.column
        return {"=": x == y, ">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y, "!=": x != y}[op]
    x, y = a.cast("FLOAT"), b.cast("FLOAT")
    if op in ("<", "<="):
        a, b, x, y, op = b, a, y, x, {"<": ">", "<=": ">="}[op]
    if op == "!=":
        return ~compare("=", a, b)
    plain = {"=": x == y, ">": x > y, ">=": x >= y}[op]
    sure = lambda t: t.kind == "INTEGER" or t.constant and t.value == t.value
    if sure(a) or op == "=" and sure(b):
        return plain  # only a NaN on the left (or, for =, on both sides) compares otherwise in Spark
    return plain & ~F.isnan(x) if b.constant else plain & (~F.isnan(x) | y.isNull())


def operate(op: str, args: list[Typed]) -> Typed:
    """An operator on typed columns; constants fold."""
    if all(a.constant for a in args):
        return literal(compute(op, [a.value for a in args]))
    a, b = [*args, None][:2]
    kinds = {x.kind for x in args}
    null = Typed(F.lit(None).cast("boolean"), None)
    if op in ("and", "or", "not"):
        if not kinds <= {"BOOLEAN", None}:
            raise ValueError_(f"Can't negate {a}" if op == "not" else f"Can't {op} {a} and {b}")
        return Typed(~a.column if op == "not" else a.column & b.column if op == "and" else a.column | b.column, "BOOLEAN")
    if op == "isnull":
        return Typed(a.column.isNull(), "BOOLEAN")
    if op in ("=", "<", ">", "<=", ">=", "!="):
        if None in kinds:
            return Typed(F.lit(None).cast("boolean"), "BOOLEAN")
        if len(kinds) > 1 and not kinds <= set(NUMBERS):
            raise ValueError_(f"Can't compare {a} and {b}")
        return Typed(compare(op, a, b), "BOOLEAN")
    if op == "like":
        if not kinds <= {"STRING", None}:
            raise ValueError_(f"Can't LIKE {a} and {b}")
        return Typed(F.lit(None).cast("boolean") if None in kinds else like(a.column, b), "BOOLEAN")
    if op == "!":
        if not kinds <= {"INTEGER", None}:
            raise ValueError_(f"Can't take factorial of {a}")
        return Typed(factorial(a.column), "INTEGER")
    if not kinds <= {*NUMBERS, None}:
        raise ValueError_(f"Can't take the positive of {a}" if op == "pos" else f"Can't negate {a}" if op == "neg" else f"Can't {VERBS[op]} {a} and {b}")
    if None in kinds:
        return null
    if op == "pos":
        return a
    if op == "neg":
        return Typed(-a.column, a.kind)
    if op == "^":
        if kinds == {"INTEGER"} and b.constant and b.value >= 0:
            return Typed(whole_power(a.column, min(b.value, MOST)), "INTEGER")
        if kinds == {"INTEGER"} and not b.constant:
            return Typed(column_power(a.column, b.column), "INTEGER")
        return Typed(F.pow(a.cast("FLOAT"), b.cast("FLOAT")), "FLOAT")
    if kinds == {"INTEGER"}:
        x, y = a.column, b.column
        return Typed(x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else x % y if op == "%" else F.call_function("div", x, y), "INTEGER")
    x, y = a.cast("FLOAT"), b.cast("FLOAT")
    return Typed(x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else float_modulo(x, y) if op == "%" else float_divide(x, y), "FLOAT")


def build(e, resolve) -> Typed:
    """An expression as a typed column. resolve: from a Field to a Typed."""
    if isinstance(e, Literal):
        return literal(e.value)
    if isinstance(e, Field):
        return resolve(e)
    if isinstance(e, Hole):
        return Typed(F.col(e.column), e.kind)
    if isinstance(e, Call):
        raise ValueError_(f"Unknown function {e.name}")
    assert isinstance(e, Op)
    if e.name == "alias":  # what an alias of the select list stands for
        return build(e.args[0], resolve)
    return operate(e.name, [build(x, resolve) for x in e.args])


def condition(e, resolve, what: str) -> Column:
    """A predicate; NULL is false to whoever filters by it."""
    t = build(e, resolve)
    if t.kind not in ("BOOLEAN", None):
        raise ValueError_(f"{what} returned {t}, expected boolean")
    return t.column
