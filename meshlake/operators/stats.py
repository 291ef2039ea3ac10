"""Statistics of columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _in_range(c: str, bounds: tuple[float, float] | None) -> Column:
    value = F.col(c).cast("double")
    value = F.when(~F.isnan(value), value)
    return value if bounds is None else F.when(value.between(*bounds), value)


def statistic(df: DataFrame, fields: Sequence[str], bounds: tuple[float, float] | None = None) -> DataFrame:
    """One row per column, in table order: minimum, maximum, average and sum of the values in range; NULL and NaN are none."""
    names = [c for c in df.columns if c in fields]
    aggs = [f(_in_range(c, bounds)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max), ("av", F.avg), ("su", F.sum))]
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(n) for k, n in (("lo", "minimum"), ("hi", "maximum"), ("av", "average"), ("su", "total"))]) for i, c in enumerate(names)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def histogram(df: DataFrame, fields: Sequence[str], bins: int | None = None, bounds: tuple[float, float] | None = None) -> DataFrame:
    """``bin``, ``bin_start`` and a count for each column; all columns share one grid, whose last bin is closed.

    Without ``bins``, one for each hundred rows, between 10 and 10,000.
    """
    names = [c for c in df.columns if c in fields]
    aggs = [f(_in_range(c, bounds)) for c in names for f in (F.min, F.max)]
    found = df.agg(F.count("*"), *aggs).first()
    values = [x for x in found[1:] if x is not None]
    if not values:
        raise ValueError("no value is in range")
    bins = bins or min(10_000, max(10, found[0] // 100))
    low, high = bounds if bounds else (min(values), max(values))
    width = (high - low) / bins
    place = lambda c: F.least(F.floor((_in_range(c, bounds) - low) / width), F.lit(bins - 1)).cast("int") if width else F.when(_in_range(c, bounds).isNotNull(), 0)
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), place(c).alias("bin")) for i, c in enumerate(names)])).alias("p")).select("p.*").where("bin is not null")
    counted = pairs.groupBy("bin").agg(*[F.count_if(F.col("c") == i).alias(c) for i, c in enumerate(names)])
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.lit(low) + F.col("id") * F.lit(width)).alias("bin_start"))
    return grid.join(counted, "bin", "left").fillna(0, names)


def write_histogram(counts: DataFrame, fields: Sequence[str], path: str) -> None:
    """A line for each bin, its start and the counts of the fields in table order, as text in parts that are in order."""
    names = [c for c in counts.columns if c in fields]
    line = F.concat_ws("  ", *[F.col(f"`{c}`").cast("string") for c in ("bin_start", *names)])
    counts.orderBy("bin").select(line.alias("value")).write.text(path)


def normalize(df: DataFrame, fields: Sequence[str], by: str, log: bool = False, asinh: bool = False, low: float | None = None, high: float | None = None) -> DataFrame:
    """The fields scaled to 0 to 1 within each type ``by``, after log10 or asinh if asked; a constant field is 0.

    ``low`` and ``high``, on the scale after these, stand for a type's own bounds; values beyond them are clamped.
    """
    change = (lambda x: F.when(x > 0, F.log10(x))) if log else F.asinh if asinh else (lambda x: x)
    values = {c: change(F.col(c).cast("double")) for c in fields}
    ranges = df.groupBy(by).agg(*[f(v).alias(f"__{k}_{c}") for c, v in values.items() for k, f in (("lo", F.min), ("hi", F.max))])
    scaled = df.withColumns(values).join(ranges, by, "left")
    out = {}
    for c in fields:
        a = F.col(f"__lo_{c}") if low is None else F.lit(float(low))
        b = F.col(f"__hi_{c}") if high is None else F.lit(float(high))
        value = F.greatest(a, F.least(b, F.col(c)))
        out[c] = F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(value - a, b - a), F.lit(0.0)))
    return scaled.withColumns(out).drop(*[x for x in scaled.columns if x.startswith(("__lo_", "__hi_"))])


def mean_speed(df: DataFrame, velocities: Sequence[str]) -> DataFrame:
    return df.agg(F.avg(F.sqrt(reduce(lambda a, b: a + b, [F.col(c).cast("double") * F.col(c) for c in velocities]))).alias("mean_speed"))
