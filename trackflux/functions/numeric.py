"""Scalar column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def finite(c: Column) -> Column:
    """NaN and +-Infinity become NULL; missing is NULL everywhere downstream."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def finite_number(c: Column) -> Column:
    """Text or number to finite double, anything else NULL."""
    return finite(c.try_cast("double"))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def is_true(c: Column) -> Column:
    """Comparison with a missing value counts as false."""
    return F.coalesce(c, F.lit(False))


def any_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)


def number_list(c: Column) -> Column:
    """Parse ``"a;b;c"`` (brackets allowed, comma fallback) to sorted doubles."""
    plain = F.regexp_replace(c, r"[\[\]()]", "")
    sep = F.when(plain.contains(";"), plain).otherwise(F.regexp_replace(plain, ",", ";"))
    parts = F.transform(F.split(sep, ";"), lambda t: F.trim(t).try_cast("double"))
    return F.array_sort(F.filter(parts, lambda t: t.isNotNull() & ~F.isnan(t)))


def class_bucket(c: Column) -> Column:
    """Class label to ``car`` / ``truck`` / NULL."""
    s = F.lower(F.trim(c.cast("string")))
    code = s.try_cast("double").try_cast("int")
    return (
        F.when(s.contains("car"), F.lit("car"))
        .when(s.contains("truck"), F.lit("truck"))
        .when(code == 1, F.lit("car"))
        .when(code == 2, F.lit("truck"))
    )


def lc_int(c: Column) -> Column:
    """Nullable integer lane-change code, rounded half to even."""
    return F.bround(finite_number(c)).cast("int")


def literal_lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """CASE over a fixed small table."""
    items = list(table.items())
    out = F.when(c == items[0][0], F.lit(items[0][1]))
    for k, v in items[1:]:
        out = out.when(c == k, F.lit(v))
    return out if default is None else out.otherwise(default)
