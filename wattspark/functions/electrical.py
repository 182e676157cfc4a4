"""Electrical quantities as column functions: aggregates over rows, and expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Aggregates over long rows.
def active_power(v, i) -> Column:
    """mean(v*i)"""
    return F.avg(col(v) * col(i))


def rms(x) -> Column:
    return F.sqrt(F.avg(col(x) * col(x)))


def apparent_power(v, i) -> Column:
    return rms(v) * rms(i)


def reactive(active: Column, apparent: Column) -> Column:
    return F.sqrt(F.greatest(apparent * apparent - active * active, F.lit(0.0)))


def power_factor(active: Column, apparent: Column) -> Column:
    return active / F.greatest(apparent, F.lit(1e-12))


# Expressions over arrays.
def let(value: Column, body) -> Column:
    """body(value), with value computed once a row: within a lambda, an expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def products(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def array_active_power(v, i) -> Column:
    return mean(products(col(v), col(i)))


def array_rms(x) -> Column:
    return F.sqrt(mean(products(col(x), col(x))))


def array_apparent_power(v, i) -> Column:
    return array_rms(v) * array_rms(i)


def fryze(v, i, eps: float = 1e-12) -> Column:
    """struct(v, active, residual): the current that is proportional to the voltage, and the rest (RP-01)."""
    v, i = col(v), col(i)
    g = array_active_power(v, i) / (mean(products(v, v)) + eps)

    def parts(active):
        return F.struct(v.alias("v"), active.alias("active"), F.zip_with(i, active, lambda x, y: x.cast("double") - y).alias("residual"))

    return let(let(g, lambda k: F.transform(v, lambda x: k * x.cast("double"))), parts)


def is_on(watts, threshold) -> Column:
    """Strictly over the threshold."""
    return col(watts) > threshold
