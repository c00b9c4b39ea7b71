"""Arithmetic with the three meanings of a missing value: null, NaN, and zero where zero means missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x) -> Column:
    """A double without NaN: NaN becomes null."""
    c = F.col(x) if isinstance(x, str) else x
    c = c.cast("double")
    return F.when(F.isnan(c), None).otherwise(c)


def div(a, b) -> Column:
    """a / b, null where either is null or b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def safe_div(a, b, fallback: float | None = None) -> Column:
    """a / b with a fallback for null, NaN and a zero divisor."""
    out = div(number(a), number(b))
    return out if fallback is None else F.coalesce(out, F.lit(float(fallback)))


def nonzero(x) -> Column:
    """x, null where it is 0: for rules that read 0 as missing."""
    return F.nullif(number(x), F.lit(0.0))


def or_else(x, default) -> Column:
    """x, or the default where x is null or 0."""
    return F.coalesce(nonzero(x), F.lit(default).cast("double"))


def gap(a, b) -> Column:
    """(a - b) / b where neither is 0."""
    a, b = nonzero(a), nonzero(b)
    return (a - b) / b


def growth(now, before) -> Column:
    """(now - before) / abs(before)."""
    now, before = number(now), number(before)
    return div(now - before, F.abs(before))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0; unknown is 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def at_least(x: Column, n: Column, least: int) -> Column:
    """x where ``n`` values stand behind it, else null."""
    return F.when(n >= least, x)
