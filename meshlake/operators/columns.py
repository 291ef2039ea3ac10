"""Operators that add, drop, rename or overwrite columns; none moves rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ROW, data_columns
from .rows import limits_predicate


def distance(columns: Sequence[str], center: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for c, at in zip(columns, center):
        total = total + (F.col(c).cast("double") - at) * (F.col(c).cast("double") - at)
    return F.sqrt(total)


def select_columns(df: DataFrame, fields: Sequence[str], delete: bool = False) -> DataFrame:
    """Keep (or drop) columns, in table order; unknown names are ignored."""
    wanted = set(fields)
    return df.select(*[c for c in df.columns if c == ROW or (c in wanted) != delete])


def rename_columns(df: DataFrame, fields: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Pair old and new names by place; names beyond the fields are ignored."""
    return df.withColumnsRenamed(dict(zip(fields, names)))


def add_id(df: DataFrame, name: str = "Id", start: int = 0) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, F.col(ROW) + F.lit(start).cast("long"))


def math_column(df: DataFrame, expression: Column | str, name: str = "__Mathop_") -> DataFrame:
    """A column from a Column (see ``functions.scalar``) or a Spark SQL expression."""
    return df.withColumn(name, (F.expr(expression) if isinstance(expression, str) else expression).cast("double"))


def module(df: DataFrame, fields: Sequence[str], name: str = "ModuleOp") -> DataFrame:
    if len(fields) != 3:
        raise ValueError("three fields are needed")
    return df.withColumn(name, distance(fields, (0.0, 0.0, 0.0)))


def cartesian_to_polar(df: DataFrame, fields: Sequence[str], names: Sequence[str] = ("rho", "theta", "phi")) -> DataFrame:
    """Radians; phi is atan(y / x), so between -pi/2 and pi/2; NULL where a divisor is 0."""
    x, y, z = (F.col(c).cast("double") for c in fields)
    rho = distance(fields, (0.0, 0.0, 0.0))
    return df.withColumns({names[0]: rho, names[1]: F.acos(F.try_divide(z, rho)), names[2]: F.atan(F.try_divide(y, x))})


def include(df: DataFrame, radius: float, center: Sequence[float], fields: Sequence[str] | None = None, inside: float = 1.0, outside: float = 0.0, name: str = "IncludeOp") -> DataFrame:
    """Mark the rows nearer to the center than ``radius``."""
    at = distance(fields or data_columns(df)[:3], center)
    return df.withColumn(name, F.when(at < radius, F.lit(inside)).otherwise(F.lit(outside)))


def cut(df: DataFrame, limits: Mapping[str, tuple[float | None, float | None]], fields: Sequence[str] | None = None, threshold: float = 0.0, operator: str = "AND") -> DataFrame:
    """Overwrite the fields (all by default) where the limits hold; no row goes."""
    holds = limits_predicate(df, limits, operator)
    return df.withColumns({c: F.when(holds, F.lit(threshold)).otherwise(F.col(c).cast("double")) for c in fields or data_columns(df)})
