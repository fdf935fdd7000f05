"""Expressions with the engine's semantics: two-valued logic, typed comparison, ASCII LIKE, guarded arithmetic.

All are Column expressions chosen from the static types of their operands, so that Catalyst sees plain predicates and
pushes them to the Parquet scan.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ARITH = {"+": operator.add, "-": operator.sub, "*": operator.mul}
COMPARE = {"=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def kind_of(t: T.DataType) -> str:
    """num, text, time, bool or null: the classes that compare with each other. Text and binary compare bytewise."""
    if isinstance(t, T.NullType):
        return "null"
    if isinstance(t, (T.StringType, T.BinaryType)):
        return "text"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "bool" if isinstance(t, T.BooleanType) else "num" if isinstance(t, T.NumericType) else "other"


def wrapped(x: Column) -> Column:
    """A whole decimal number modulo 2^64, as a 64-bit integer."""
    every = F.lit(Decimal(1 << 64)).cast("decimal(20,0)")
    rest = F.pmod(x, every)
    return F.when(rest >= F.lit(Decimal(1 << 63)), rest - every).otherwise(rest).cast("bigint")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


class Expressions:
    """Builders over the columns of one DataFrame.

    null_mode "two_valued": a comparison with null is false, so its negation is true. "ansi": SQL's three values. The two
    only differ below a negation and in projected predicates; positive predicates stay bare, and so are pushed down.
    """

    def __init__(self, df: DataFrame, null_mode: str = "two_valued"):
        if null_mode not in ("two_valued", "ansi"):
            raise ValueError(f"null_mode: {null_mode}")
        self.df, self.two_valued = df, null_mode == "two_valued"

    def type_of(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("c")).schema["c"].dataType

    def _col(self, x) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    # predicates

    def compare(self, a, op: str, b) -> Column:
        """Numbers with numbers, text with text; a text literal against a time is read as a time; else false. Integers
        compare as integers."""
        a, b = self._col(a), self._col(b)
        x, y = kind_of(self.type_of(a)), kind_of(self.type_of(b))
        if "null" in (x, y):
            return F.lit(False) if self.two_valued else F.lit(None).cast("boolean")
        if {x, y} == {"time", "text"}:
            a, b = (a, b.try_cast("timestamp")) if x == "time" else (a.try_cast("timestamp"), b)
        elif x != y:
            return F.lit(False)
        elif x == "text" and isinstance(self.type_of(a), T.BinaryType) != isinstance(self.type_of(b), T.BinaryType):
            a, b = a.cast("binary"), b.cast("binary")
        return COMPARE[op](a, b)

    def truthy(self, c: Column) -> Column:
        kind = kind_of(self.type_of(c))
        if kind == "bool":
            return c
        return F.lit(False) if kind == "null" else c != 0 if kind == "num" else F.length(c) > 0 if kind == "text" else c.isNotNull()

    def negate(self, p: Column, over: Column | None = None) -> Column:
        """NOT p. In two-valued mode a null p becomes true; `over`, the one nullable column of p, keeps it pushable."""
        if not self.two_valued:
            return ~p
        return ~F.coalesce(p, F.lit(False)) if over is None else over.isNull() | ~p

    def value(self, p: Column) -> Column:
        """A projected predicate: 0 or 1 (null only in ansi mode)."""
        return (F.coalesce(p, F.lit(False)) if self.two_valued else p).cast("bigint")

    def like(self, c: Column, pattern: str, negated: bool = False) -> Column:
        """% and _; A-Z fold, other letters don't; no escape character. What isn't text isn't like anything."""
        if kind_of(self.type_of(c)) != "text":
            return F.lit(negated)
        pattern = pattern.translate(str.maketrans(UPPER, LOWER))
        escape = next(x for x in map(chr, range(1, 128)) if x not in pattern and not x.isalnum() and x not in "%_'\\\n")
        p = F.like(ascii_lower(c.cast("string")), F.lit(pattern), F.lit(escape))
        return self.negate(p, c) if negated else p

    def within(self, c: Column, items: Iterable, negated: bool = False) -> Column:
        """IN a list: duplicates and nulls in the list don't count, an empty list holds nothing."""
        kind = kind_of(self.type_of(c))
        same = [x for x in dict.fromkeys(items) if x is not None and kind_of(self.type_of(F.lit(x))) == kind]
        p = c.isin(same) if same else F.lit(False)
        return self.negate(p, c) if negated else p

    def between(self, c: Column, low, high, negated: bool = False) -> Column:
        p = self.compare(c, ">=", low) & self.compare(c, "<=", high)
        return self.negate(p, c) if negated else p

    # arithmetic

    def arith(self, a, op: str, b) -> Column:
        """+ - * / %: integers as 64 bits that wrap around, / truncates and % takes the dividend's sign; with a real operand / is real and
        % is floored. Division by zero and operands that aren't numbers give null."""
        a, b = self._col(a), self._col(b)
        x, y = self.type_of(a), self.type_of(b)
        if kind_of(x) != "num" or kind_of(y) != "num":
            return F.lit(None).cast("bigint")
        whole = isinstance(x, T.IntegralType) and isinstance(y, T.IntegralType)
        a, b = (a.cast("bigint"), b.cast("bigint")) if whole else (a.cast("double"), b.cast("double"))
        if op in "+-*" and whole:  # beyond 64 bits once more in decimals
            tried = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
            return F.coalesce(tried, wrapped(ARITH[op](a.cast("decimal(19,0)"), b.cast("decimal(19,0)"))))
        if op in "+-*":
            return ARITH[op](a, b)
        b = F.nullif(b, F.lit(0).cast("bigint" if whole else "double"))
        if whole and op == "/":
            return F.when(b == -1, self._minus(a)).otherwise(F.call_function("div", a, b))
        if whole:
            return a % b
        return a / b if op == "/" else a - b * F.floor(a / b)

    def minus(self, a: Column) -> Column:
        if isinstance(self.type_of(a), T.IntegralType):
            return self._minus(a.cast("bigint"))
        return -a if kind_of(self.type_of(a)) == "num" else F.lit(None).cast("bigint")

    def _minus(self, a: Column) -> Column:
        """The least integer stays itself."""
        return F.coalesce(F.try_subtract(F.lit(0).cast("bigint"), a), a)

    def concat(self, *parts) -> Column:
        return F.concat(*[self._col(x).cast("string") for x in parts])
