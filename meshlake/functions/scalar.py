"""Scalar functions whose meaning differs from Spark's own of like name.

Comparisons hold within EPSILON and give 1.0 or 0.0; logic works on rounded numbers;
division, modulus and functions out of their domain give NULL instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-14


def number(c: Column) -> Column:
    return c.cast("double")


def nearest(x: Column) -> Column:
    """Halves go up, as a double."""
    return number(F.floor(x + 0.5))


def equal(a: Column, b: Column) -> Column:
    return number((F.abs(a - b) <= EPSILON).cast("int"))


def unequal(a: Column, b: Column) -> Column:
    return number((F.abs(a - b) > EPSILON).cast("int"))


def less(a: Column, b: Column) -> Column:
    return number((a < b - EPSILON).cast("int"))


def less_equal(a: Column, b: Column) -> Column:
    return number((a <= b + EPSILON).cast("int"))


def truth(x: Column) -> Column:
    return nearest(x) != 0


def both(a: Column, b: Column) -> Column:
    return number((truth(a) & truth(b)).cast("int"))


def either(a: Column, b: Column) -> Column:
    return number((truth(a) | truth(b)).cast("int"))


def negate(x: Column) -> Column:
    return number((~truth(x)).cast("int"))


def choose(c: Column, a: Column, b: Column) -> Column:
    return F.when(truth(c), a).otherwise(b)


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(number(a), number(b))


def modulus(a: Column, b: Column) -> Column:
    """The remainder has the sign of ``a``."""
    return F.when(b != 0, number(a) % number(b))


def root(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def natural_log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def decimal_log(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def arc_sine(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.asin(x))


def arc_cosine(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, F.acos(x))


def hyperbolic_arc_cosine(x: Column) -> Column:
    return F.when(x >= 1, F.acosh(x))


def hyperbolic_arc_tangent(x: Column) -> Column:
    return F.when(F.abs(x) < 1, F.atanh(x))


def cotangent(x: Column) -> Column:
    return divide(F.lit(1.0), F.tan(x))


def secant(x: Column) -> Column:
    return divide(F.lit(1.0), F.cos(x))


def cosecant(x: Column) -> Column:
    return divide(F.lit(1.0), F.sin(x))
