"""Calculator expressions: NULL stands where the answer is an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def mul(a: Column, b: Column) -> Column:
    return a * b


def div(a: Column, b: Column) -> Column:
    """NULL for a zero divisor."""
    return F.try_divide(a, b)


def root(a: Column) -> Column:
    """NULL for a negative number."""
    return F.when(a >= 0, F.sqrt(a))


def power(base: Column, exponent: Column) -> Column:
    return F.pow(base, exponent)
