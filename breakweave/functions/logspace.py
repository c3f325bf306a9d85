"""Probabilities kept as natural logarithms; zero is minus infinity."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(float("-inf"))


def to_log(p: Column) -> Column:
    return F.when(p == 0, _zero()).otherwise(F.log(p))


def to_p(ls: Column) -> Column:
    """exp, with anything that is not finite giving 0."""
    return F.when(F.isnan(ls) | (F.abs(ls) == float("inf")), F.lit(0.0)).otherwise(F.exp(ls))


def rounded(x: Column, digits: int) -> Column:
    """Like F.round() of doubles, without a decimal for each; zero has no sign."""
    return F.rint(x * 10.0**digits) / 10.0**digits + 0.0


def multiply(a: Column, b: Column) -> Column:
    return F.when((a == _zero()) | (b == _zero()), _zero()).otherwise(a + b)


def divide(a: Column, b: Column) -> Column:
    return F.when(a == _zero(), _zero()).otherwise(a - b)


def add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without leaving log space."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(low == _zero(), high).otherwise(high + F.log1p(F.exp(low - high)))
