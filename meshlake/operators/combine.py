"""Operators on several tables, and splits of one."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ROW, Geometry, data_columns


def merge(tables: Sequence[tuple[DataFrame, Sequence[str]]], size: str = "SMALLEST", pad: float = 0.0) -> DataFrame:
    """Columns side by side by position, named ``<column>_tab_<n>``; SMALLEST ends with the shortest table, HUGE pads the others."""
    parts = [df.select(ROW, *[F.col(c).alias(f"{c}_tab_{k}") for c in names]) for k, (df, names) in enumerate(tables, 1)]
    how = "full" if size.upper() == "HUGE" else "inner"
    joined = reduce(lambda a, b: a.join(b, ROW, how), parts)
    return joined.fillna(pad, data_columns(joined)) if how == "full" else joined


def append(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables in turn, matched by column place, named as in the first; positions go on."""
    names = data_columns(tables[0])
    if any(len(data_columns(t)) != len(names) for t in tables):
        raise ValueError("the tables differ in columns")
    parts, start = [], 0
    for k, t in enumerate(tables):
        parts.append(t.select((F.col(ROW) + F.lit(start).cast("long")).alias(ROW), *[F.col(a).alias(b) for a, b in zip(data_columns(t), names)]))
        if k + 1 < len(tables):
            start += t.count()
    return reduce(DataFrame.union, parts)


def split_count(n_rows: int, n_columns: int, megabytes: float, huge: bool = False, most: int = 100) -> int:
    """Parts of at most ``megabytes`` each, at four bytes a value; more than ``most`` of them only if ``huge``."""
    if megabytes <= 0:
        raise ValueError("the size must be positive")
    parts = math.ceil(n_rows * n_columns * 4 / (1 << 20) / megabytes)
    if parts > most and not huge:
        raise ValueError(f"{parts} parts need huge")
    return max(1, parts)


def split_rows(df: DataFrame, parts: int, n_rows: int | None = None) -> DataFrame:
    """``part`` from 0 on: runs of positions of like length, longer by one in the first n mod parts."""
    n = n_rows if n_rows is not None else (df.agg(F.count("*")).first()[0])
    short, more = divmod(n, parts)
    row = F.col(ROW)
    late = F.lit(more) + F.floor((row - more * (short + 1)) / F.lit(max(short, 1)))
    return df.withColumn("part", F.when(row < more * (short + 1), F.floor(row / F.lit(short + 1))).otherwise(late).cast("int"))


def split_by_value(df: DataFrame, field: str, parts: int, bins: int = 10_000) -> DataFrame:
    """``part`` from 0 on: ranges of the field with like numbers of rows, by a histogram of ``bins`` with straight lines inside a bin."""
    low, high = df.agg(F.min(field), F.max(field)).first()
    if low is None or low == high:
        return df.withColumn("part", F.lit(0))
    width = (float(high) - float(low)) / bins
    place = F.least(F.floor((F.col(field).cast("double") - float(low)) / width), F.lit(bins - 1)).cast("int")
    counts = dict(df.where(F.col(field).isNotNull()).groupBy(place.alias("b")).count().collect())
    total, seen, bounds = sum(counts.values()), 0, []
    for b in sorted(counts):
        while len(bounds) < parts - 1 and seen + counts[b] >= total * (len(bounds) + 1) / parts:
            bounds.append(float(low) + width * (b + (total * (len(bounds) + 1) / parts - seen) / counts[b]))
        seen += counts[b]
    part = reduce(lambda a, b: a + b, [(F.col(field) > x).cast("int") for x in bounds], F.lit(0))
    return df.withColumn("part", part)


def split_volume(df: DataFrame, geometry: Geometry, axis: int, parts: int) -> DataFrame:
    """``part`` from 0 on: slabs along axis 1, 2 or 3; the last one takes the rest."""
    width = max(1, geometry.n[axis - 1] // parts)
    return df.withColumn("part", F.least(F.floor(geometry.index()[axis - 1] / F.lit(width)), F.lit(parts - 1)).cast("int"))


def snapshots(first: DataFrame, second: DataFrame, fields: Sequence[str], steps: int = 10, periodic: bool = False, interval: tuple[float, float] = (0.0, 1.0), on: str = ROW) -> DataFrame:
    """Rows of the tables between two snapshots (``step`` 1 to ``steps - 1``), joined by position or by an id column.

    With ``periodic``, a difference of more than half the joint range goes the short way and wraps.
    """
    joined = first.select(on, *[F.col(c).cast("double").alias(f"{c}__1") for c in fields]).join(second.select(on, *[F.col(c).cast("double").alias(f"{c}__2") for c in fields]), on)
    ranges = {}
    if periodic:
        aggs = [f(df[c]) for df in (first, second) for c in fields for f in (F.min, F.max)]
        a, b = first.agg(*aggs[: 2 * len(fields)]).first(), second.agg(*aggs[2 * len(fields) :]).first()
        ranges = {c: (float(min(a[2 * i], b[2 * i])), float(max(a[2 * i + 1], b[2 * i + 1]))) for i, c in enumerate(fields)}
    start, stop = interval
    at = F.lit(start) + F.lit(stop - start) * F.col("step") / F.lit(steps)

    def between(c: str) -> Column:
        v1, v2 = F.col(f"{c}__1"), F.col(f"{c}__2")
        if not periodic:
            return v1 + at * (v2 - v1)
        low, high = ranges[c]
        span = high - low
        d = F.when(F.abs(v2 - v1) > span / 2, (v2 - v1) - F.signum(v2 - v1) * span).otherwise(v2 - v1)
        moved = v1 + at * d
        return F.when(moved < low, moved + span).when(moved > high, moved - span).otherwise(moved)

    return joined.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps - 1)))).select("step", on, *[between(c).alias(c) for c in fields])


#: The cosmology, the length (cm) and speed (cm/s) of a unit that snapshots have by default, and a megaparsec in cm.
HUBBLE, MATTER, DARK_ENERGY = 0.7, 0.3, 0.7
UNIT_LENGTH, UNIT_SPEED, MEGAPARSEC = 3.085678e21, 1e5, 3.085678e24


def cosmic_time(scale: float, hubble: float = HUBBLE, matter: float = MATTER, dark: float = DARK_ENERGY) -> float:
    """Seconds from the beginning of a flat universe until it has the scale factor.

    Friedmann's equation a' = H sqrt(matter / a + dark a^2), integrated from 0, has the
    closed form t = 2 / (3 H sqrt(dark)) asinh(sqrt(dark / matter) a^(3/2)).
    """
    per_second = 100.0 * hubble * 1e5 / MEGAPARSEC  # from km/s in each megaparsec
    return 2.0 / (3.0 * per_second * math.sqrt(dark)) * math.asinh(math.sqrt(dark / matter) * scale**1.5)


def drift(start: float, end: float, hubble: float = HUBBLE, matter: float = MATTER, dark: float = DARK_ENERGY, length: float = UNIT_LENGTH, speed: float = UNIT_SPEED) -> float:
    """The way, in lengths, that a velocity of 1 in a snapshot at scale factor ``start`` leads to until ``end``.

    Lengths are in units of 1 / hubble, and velocities are kept divided by the root of the scale factor.
    """
    seconds = cosmic_time(end, hubble, matter, dark) - cosmic_time(start, hubble, matter, dark)
    return seconds * hubble * speed / (length * math.sqrt(start))


def snapshots_by_velocity(
    first: DataFrame, second: DataFrame, positions: Sequence[str], velocities: Sequence[str], steps: int = 10, unit: float = 1.0, box: float | None = None, on: str = ROW,
) -> DataFrame:
    """Positions between two snapshots (``step`` 1 to ``steps - 1``), by constant acceleration.

    A parabola is given by three things: where the row is in the first snapshot, where it is
    in the second, and the velocity with which it leaves the first.  So the second snapshot
    needs no velocities.  ``unit`` is what a velocity of 1 leads to in the whole time; see
    ``drift``.  In a periodic ``box`` the row goes the short way.  Rows without a partner
    are left out; a null or missing velocity makes the position null.
    """
    velocity = dict(zip(positions, velocities))
    begin = first.select(on, *[F.col(x).cast("double").alias(f"{x}__at") for x in positions], *[(F.col(v).cast("double") * unit).alias(f"{x}__speed") for x, v in velocity.items()])
    goal = second.select(on, *[F.col(x).cast("double").alias(f"{x}__goal") for x in positions])
    time = F.col("step") / F.lit(float(steps))

    def place(x: str) -> Column:
        at, speed, way = F.col(f"{x}__at"), F.col(f"{x}__speed"), F.col(f"{x}__goal") - F.col(f"{x}__at")
        if box is not None:
            way = way - F.when(F.abs(way) > box / 2, F.signum(way) * box).otherwise(0.0)
        # what the first velocity does not cover of the way is left to the acceleration
        return at + time * (speed + time * (way - speed))

    moved = begin.join(goal, on).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))))
    return moved.select("step", on, *[place(x).alias(x) for x in positions])
