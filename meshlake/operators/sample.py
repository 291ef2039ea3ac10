"""Samples, all reproducible: chance comes from hashes of seed and position."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ROW, Geometry, data_columns


#: Fixed value: rows that the background of a thinned table has by default.
BACKGROUND_ROWS = 100_000


def draw(seed: int) -> Column:
    """A hash of the seed and the position, as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(ROW).cast("string")))


def randomize(df: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    """Exactly floor(rows * percent / 100) rows (percent within 0 and 95): those of least hash.

    The hashes' first four digits are counted; only the rows of the one group in which
    the sample ends have to be put in order.
    """
    percent = min(95.0, max(0.0, percent))
    marked = df.withColumn("__h", draw(seed))
    counts = sorted((r["g"], r["count"]) for r in marked.groupBy(F.substring("__h", 1, 4).alias("g")).count().collect())
    left = math.floor(sum(n for _, n in counts) * percent / 100)
    for last, n in counts:
        if left <= n:
            break
        left -= n
    else:
        return df.limit(0)
    whole = marked.where(F.substring("__h", 1, 4) < last)
    rest = marked.where(F.substring("__h", 1, 4) == last).orderBy("__h", ROW).limit(left)
    return whole.union(rest).drop("__h")


def decimate(df: DataFrame, skip: int = 1) -> DataFrame:
    """Every (skip + 1)-th row."""
    return df.where(F.col(ROW) % (max(1, skip) + 1) == 0)


def visual_sample(tables: Sequence[tuple[DataFrame, Sequence[str]]], size: int = 8_000_000, seed: int = 0) -> DataFrame:
    """Columns of equally long tables, one random row from each of ``size`` strata of like width; padded to three columns."""
    picked = [df.select(ROW, *[F.col(c).alias(f"{c}_visual_{k}") for c in names]) for k, (df, names) in enumerate(tables, 1)]
    joined = reduce(lambda a, b: a.join(b, ROW), picked)
    n = (tables[0][0].agg(F.max(ROW)).first()[0] or 0) + 1
    if n > size:
        stratum = F.floor(F.col(ROW) * F.lit(size) / F.lit(n)).cast("long")
        best = joined.withColumn("__s", stratum).groupBy("__s").agg(F.min_by(F.struct(*joined.columns), draw(seed)).alias("r"))
        joined = best.select("r.*")
    for k in range(3 - len(data_columns(joined))):
        joined = joined.withColumn(f"NONE_{k + 1}" if k else "NONE", F.lit(0.0))
    return joined


def multi_resolution(df: DataFrame, fields: Sequence[str], position: Sequence[float] | None = None, layers: Sequence[tuple[float, float]] | None = None, background: float | None = None, seed: int = 0) -> DataFrame:
    """Thin out with the distance: in the first layer (distance, fraction) that holds a row, 1 of 1 / fraction stays.

    The position is the middle of the fields' ranges by default, and the layers are 1, 10
    and 100 hundredths of the widest range with the fractions 1, 0.1 and 0.01.
    Rows beyond all layers are thinned to ``background``, by default what leaves about
    BACKGROUND_ROWS of the whole table, and all of a smaller one.  The rows of a layer go by
    runs of positions; one of each run stays, the one of least hash.
    """
    if background is None:
        background = min(1.0, BACKGROUND_ROWS / max(1, df.count()))
    if position is None or layers is None:
        ends = df.agg(*[f(F.col(c).cast("double")) for c in fields for f in (F.min, F.max)]).first()
        ranges = [(ends[2 * k] or 0.0, ends[2 * k + 1] or 0.0) for k in range(len(fields))]
        position = [(a + b) / 2 for a, b in ranges] if position is None else position
        widest = max(b - a for a, b in ranges)
        layers = [(widest * 0.01 * 10**k, 1 / 10**k) for k in range(3)] if layers is None else layers
    total = reduce(lambda a, b: a + b, [(F.col(c).cast("double") - at) * (F.col(c).cast("double") - at) for c, at in zip(fields, position)])
    at = F.sqrt(total)
    layer = F.coalesce(*[F.when(at <= d, F.lit(k)) for k, (d, _) in enumerate(layers)], F.lit(len(layers)))
    steps = [max(1, int(1 / f + 0.5)) if f > 0 else 0 for f in (*(f for _, f in layers), background)]
    step = F.element_at(F.array(*[F.lit(s) for s in steps]), layer + 1)
    # a run is as long as its layer is thin, so the least is taken before rows move
    run = F.floor(F.col(ROW) / step)
    kept = df.withColumn("__layer", layer).withColumn("__step", step).where("__step > 0").withColumn("__run", run)
    thin = kept.where("__step > 1").groupBy("__layer", "__run").agg(F.min_by(F.struct(*df.columns), draw(seed)).alias("__r"))
    return kept.where("__step = 1").select(*df.columns).unionByName(thin.select("__r.*"))


def coarse_resolution(n: Sequence[int], percent: float) -> tuple[int, int, int]:
    """The cells along each axis that are about ``percent`` of all, in the same proportions."""
    nx, ny, nz = n
    goal = nx * ny * nz * percent / 100 / ((ny / nx) * (nz / nx))
    x = 0
    while (x + 1) ** 3 < goal:
        x += 1
    return x, int(x * ny / nx), int(x * nz / nx)


def coarsen(df: DataFrame, geometry: Geometry, resolution: Sequence[int]) -> tuple[DataFrame, Geometry]:
    """The volume without evenly spaced planes, down to ``resolution`` cells along each axis.

    Place and number of a kept plane follow from arithmetic, so nothing is joined.
    """
    if any(r >= n - 1 for r, n in zip(resolution, geometry.n)):
        return df, geometry
    keep, index = F.lit(True), []
    for i, n, r in zip(geometry.index(), geometry.n, resolution):
        gone = n - r
        step = n / (gone + 1)
        # dropped planes stand at int(step * 1), int(step * 2), ...; step >= 1, so no two are one
        k = F.floor((i + 1) / F.lit(step)).cast("int")
        k = F.when(F.floor(F.lit(step) * (k + 1)) <= i, k + 1).when(F.floor(F.lit(step) * k) > i, k - 1).otherwise(k)
        k = F.least(k, F.lit(gone))  # dropped planes up to and including i
        keep = keep & ((k == 0) | (F.floor(F.lit(step) * k) != i))
        index.append(i - k)
    out = Geometry(tuple(resolution), tuple(d * n / r for d, n, r in zip(geometry.size, geometry.n, resolution)), geometry.origin)
    return df.where(keep).withColumn(ROW, out.row(*index)), out


