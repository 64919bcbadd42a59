"""Dates by arithmetic, thresholds and formulas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = "^\\s*([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})\\s*$"


def julian_day(c: Column) -> Column:
    """Day number of a date text with - or /; any day up to 31 is taken, so 02-31 rolls over. Null if it is no date."""
    y, m, d = (F.regexp_extract(c, _DATE, k).try_cast("int") for k in (1, 2, 3))
    good = m.between(1, 12) & d.between(1, 31)
    a = F.floor((F.lit(14) - m) / 12)
    yy, mm = y + 4800 - a, m + 12 * a - 3
    return F.when(good, d + F.floor((153 * mm + 2) / 5) + 365 * yy + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400) - 32045).cast("long")


def days_between(a: Column, b: Column) -> Column:
    return julian_day(b) - julian_day(a)


def constraint_status(days: Column, least: Column, most: Column) -> Column:
    """pass, fail, or uncertain when a date or both bounds are missing; an open bound holds."""
    return F.when(days.isNull() | (least.isNull() & most.isNull()), "uncertain").when(F.coalesce(days < least, F.lit(False)) | F.coalesce(days > most, F.lit(False)), "fail").otherwise("pass")


def threshold(c: Column) -> Column:
    """struct(lo, hi, lo_open, hi_open) of `<= 3`, `>= 3`, `< 3`, `> 3`, `== 3` and `1 <= x <= 3`; null for other texts."""
    num = "(-?[0-9]+(?:\\.[0-9]+)?)"
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "≤", "<="), "≥", ">="), "\\s+", "")
    both = f"^{num}(<=?)[A-Za-z_]+(<=?){num}$"
    one = f"^(?:[A-Za-z_]+)?(<=|>=|==|=|<|>){num}$"
    op, x = F.regexp_extract(t, one, 1), F.regexp_extract(t, one, 2).try_cast("double")
    none, no, yes = F.lit(None).cast("double"), F.lit(False), F.lit(True)
    make = lambda lo, hi, a, b: F.struct(lo.alias("lo"), hi.alias("hi"), a.alias("lo_open"), b.alias("hi_open"))
    return (
        F.when(t.rlike(both), make(F.regexp_extract(t, both, 1).try_cast("double"), F.regexp_extract(t, both, 4).try_cast("double"), F.regexp_extract(t, both, 2) == "<", F.regexp_extract(t, both, 3) == "<"))
        .when(op == "<=", make(none, x, no, no)).when(op == "<", make(none, x, no, yes)).when(op == ">=", make(x, none, no, no)).when(op == ">", make(x, none, yes, no))
        .when(op.isin("==", "="), make(x, x, no, no))
    )


def within(value: Column, limits: Column) -> Column:
    """Whether a value lies in an interval; strict bounds are strict."""
    lo, hi = limits["lo"], limits["hi"]
    low = lo.isNull() | F.when(limits["lo_open"], value > lo).otherwise(value >= lo)
    high = hi.isNull() | F.when(limits["hi_open"], value < hi).otherwise(value <= hi)
    return F.when(limits.isNull() | value.isNull(), F.lit(None).cast("boolean")).otherwise(low & high)


class Formula:
    """+ - * / ( ) and unary minus over numbers and named values, by recursive descent."""

    def __init__(self, text: str, values: dict[str, float] | None):
        self.text = text.replace("×", "*").replace("÷", "/").replace("（", "(").replace("）", ")")
        self.values, self.at = values or {}, 0

    def _peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at] if self.at < len(self.text) else ""

    def value(self) -> float:
        found = self._sum()
        if self._peek():
            raise ValueError(f"unexpected {self._peek()!r}")
        return round(found, 4)

    def _sum(self) -> float:
        total = self._product()
        while self._peek() in ("+", "-"):
            sign = self.text[self.at]
            self.at += 1
            other = self._product()
            total = total + other if sign == "+" else total - other
        return total

    def _product(self) -> float:
        total = self._unary()
        while self._peek() in ("*", "/"):
            sign = self.text[self.at]
            self.at += 1
            other = self._unary()
            if sign == "/" and other == 0:
                raise ZeroDivisionError("division by zero")
            total = total * other if sign == "*" else total / other
        return total

    def _unary(self) -> float:
        c = self._peek()
        if c == "-":
            self.at += 1
            return -self._unary()
        if c == "(":
            self.at += 1
            total = self._sum()
            if self._peek() != ")":
                raise ValueError("a bracket is open")
            self.at += 1
            return total
        begin = self.at
        while self.at < len(self.text) and (self.text[self.at].isalnum() or self.text[self.at] in "._"):
            self.at += 1
        word = self.text[begin : self.at]
        if word in self.values:
            return float(self.values[word])
        return float(word)


def evaluate(formula: str | None, values: dict[str, float] | None = None) -> float | None:
    """The value to four decimals; null for a formula that can't be computed."""
    try:
        return Formula(formula or "", values).value()
    except (ValueError, ZeroDivisionError, RecursionError):
        return None


def evaluate_udf(formula: Column, values: Column) -> Column:
    """For formulas that differ by row; a constant formula is better written as an expression."""

    def run(formulas: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([evaluate(f, dict(v) if v is not None else None) for f, v in zip(formulas, maps)], dtype="float64")

    return F.pandas_udf(run, "double")(formula, values)
