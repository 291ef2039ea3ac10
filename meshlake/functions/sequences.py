"""Sequences of camera values and slices, as small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def camera_path(spark: SparkSession, start: Sequence[float], end: Sequence[float], seconds: float, per_second: float, names: Sequence[str] = ("azimuth", "elevation", "zoom")) -> DataFrame:
    """Values on a straight line: seconds * per_second frames, and the end."""
    n = max(1, int(seconds * per_second))
    return spark.range(n + 1).select(F.col("id").alias("frame"), *[(F.lit(float(a)) + F.col("id") * F.lit((b - a) / n)).alias(c) for a, b, c in zip(start, end, names)])


def ortho_slices(spark: SparkSession, start: int, end: int, step: int) -> DataFrame:
    """start, start + step, ..., and always ``end``."""
    values = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(step))).alias("slice"))
    return values.union(spark.range(1).select(F.lit(end).alias("slice"))).distinct()


def plane_slices(spark: SparkSession, point: Sequence[float], normal: Sequence[float], size: float, count: int) -> DataFrame:
    """Points point + i * (normal - point) * size."""
    return spark.range(count).select(F.col("id").alias("slice"), *[(F.lit(float(p)) + F.col("id") * F.lit((q - p) * size)).alias(c) for p, q, c in zip(point, normal, "xyz")])
