"""Spheres around given centres, such as the cores of dense groups: how far they reach, and which points they hold.

A point meets the centres of its own cell and the ones beside it.  What a sphere needs to
know of its points are sums for each of a fixed number of shells, so a centre that holds
most of all points is as many rows as any other once the shells are summed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import kept

#: Rows of a few numbers that may be broadcast; more go by a shuffle, in which Spark's skew join splits large spheres.
BROADCAST = 500_000


def _small(df: DataFrame) -> DataFrame:
    df = kept(df)
    return F.broadcast(df) if df.count() <= BROADCAST else df


def shells(df: DataFrame, points: Sequence[str], centres: DataFrame, reach: float, bins: int, mass: str | None = None, velocities: Sequence[str] = ()) -> DataFrame:
    """``halo``, ``bin``, ``m`` and ``v0 v1 v2`` of each point and each centre nearer than ``reach``; a point may be in several spheres.

    ``centres`` has ``halo`` and ``X Y Z``.  Without a column ``mass`` all weigh 1, and
    missing masses weigh 0.  Points without a place are in no sphere.
    """
    place = [F.col(f"`{c}`").cast("double") for c in points]
    weight = F.lit(1.0) if mass is None else F.coalesce(F.col(f"`{mass}`").cast("double"), F.lit(0.0))
    rows = df.select(
        *[p.alias(f"p{k}") for k, p in enumerate(place)], *[F.floor(p / reach).alias(f"c{k}") for k, p in enumerate(place)],
        weight.alias("m"), *[F.col(f"`{c}`").cast("double").alias(f"v{k}") for k, c in enumerate(velocities)],
    )
    near = centres.select("halo", *[F.col(c).cast("double").alias(f"h{k}") for k, c in enumerate("XYZ")])
    for k in range(3):
        own = F.floor(F.col(f"h{k}") / reach)
        near = near.withColumn(f"c{k}", F.explode(F.sequence(own - 1, own + 1)))
    met = rows.join(_small(near), ["c0", "c1", "c2"])
    d = [F.col(f"p{k}") - F.col(f"h{k}") for k in range(3)]
    met = met.withColumn("r", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where(F.col("r") < reach)
    shell = F.least(F.floor(F.col("r") * bins / F.lit(reach)), F.lit(bins - 1)).cast("int")
    return met.select("halo", shell.alias("bin"), "m", *[f"v{k}" for k in range(len(velocities))])


def profile(rows: DataFrame, halos: DataFrame, reach: float, bins: int) -> DataFrame:
    """``halo``, ``bin``, ``edge`` and the number and mass inside of it, ``n_in`` and ``m_in``, for all bins of all ``halos``."""
    sums = rows.groupBy("halo", "bin").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    every = halos.select("halo", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = Window.partitionBy("halo").orderBy("bin")
    inside = [F.sum(F.coalesce(c, F.lit(0))).over(w).alias(f"{c}_in") for c in ("n", "m")]
    return every.join(sums, ["halo", "bin"], "left").select("halo", "bin", ((F.col("bin") + 1) * F.lit(reach) / bins).alias("edge"), *inside)


def spheres(rows: DataFrame, halos: DataFrame, least_density: float, reach: float, bins: int) -> DataFrame:
    """``halo``, ``cut``, ``radius``, ``n`` and ``mass``: from the first shell whose edge holds ``least_density`` on average to the last one before it holds less.

    Shells further in may be too thin, as few points are there.  A centre without a shell that holds enough has no row.
    """
    found = profile(rows, halos, reach, bins)
    ball = F.col("edge") * F.col("edge") * F.col("edge") * F.lit(4 / 3 * math.pi)
    w = Window.partitionBy("halo")
    found = found.withColumn("thin", F.col("m_in") < ball * F.lit(float(least_density)))
    found = found.withColumn("first", F.min(F.when(~F.col("thin"), F.col("bin"))).over(w))
    found = found.withColumn("cut", F.coalesce(F.min(F.when(F.col("thin") & (F.col("bin") > F.col("first")), F.col("bin"))).over(w), F.lit(bins)))
    found = found.where("first is not null and bin = cut - 1")
    return found.select("halo", "cut", F.col("edge").alias("radius"), F.col("n_in").alias("n"), F.col("m_in").alias("mass"))


def escape(bound: DataFrame, found: DataFrame, reach: float, bins: int, gravity: float) -> DataFrame:
    """``halo``, ``bin``, ``free`` (the square of the speed that leaves the sphere from the shell's edge) and the mean velocity ``b0 b1 b2``.

    The pull of spherical shells: outside a shell of all its mass, inside of none.  From
    the sphere's edge on it is that of all mass in one point; between two edges that of
    what the outer one holds.
    """
    inner = F.col("bin") * F.lit(reach) / bins
    own = profile(bound, found, reach, bins).join(found.select("halo", "cut", "radius"), "halo").where("bin < cut")
    whole = F.max("m_in").over(Window.partitionBy("halo"))
    step = F.when(F.col("bin") > 0, F.col("m_in") * (F.lit(1.0) / inner - F.lit(1.0) / F.col("edge"))).otherwise(0.0)
    ahead = F.sum("step").over(Window.partitionBy("halo").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1))
    free = F.lit(2.0 * gravity) * (F.col("whole") / F.col("radius") + F.coalesce(ahead, F.lit(0.0)))
    own = own.select("halo", "bin", "radius", whole.alias("whole"), step.alias("step")).select("halo", "bin", free.alias("free"))
    mean = bound.groupBy("halo").agg(*[F.try_divide(F.sum(F.col("m") * F.col(f"v{k}")), F.sum("m")).alias(f"b{k}") for k in range(3)])
    return own.join(mean, "halo")


def halos(df: DataFrame, points: Sequence[str], centres: DataFrame, least_density: float, reach: float, velocities: Sequence[str] | None = None, mass: str | None = None, bins: int = 64, gravity: float = 1.0, rounds: int = 20) -> DataFrame:
    """Each centre's sphere: ``halo``, ``radius``, ``n``, ``mass``, and with ``velocities`` ``n_bound``, ``mass_bound`` and the mean velocity ``VX VY VZ`` of the bound.

    Points faster, against the mean of those still bound, than what leaves the sphere go;
    what is left pulls less, so this goes on until none goes, ``rounds`` times at most.
    Points without a velocity are not bound.  A sphere of which none is left has counts of
    0 and no mean.  ``halo`` is to be a number that no two centres have.
    """
    rows = shells(df, points, centres, reach, bins, mass, velocities or ())
    names = centres.select("halo").where("halo is not null")
    if not velocities:
        return spheres(rows, names, least_density, reach, bins).drop("cut")
    rows = kept(rows)
    found = kept(spheres(rows, names, least_density, reach, bins))
    known = " and ".join(f"v{k} is not null" for k in range(3))
    bound = kept(rows.join(_small(found.select("halo", "cut")), "halo").where(f"bin < cut and {known}").drop("cut"))
    n = bound.count()
    for _ in range(rounds):
        d = [F.col(f"v{k}") - F.col(f"b{k}") for k in range(3)]
        slow = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= F.col("free")
        bound = kept(bound.join(_small(escape(bound, found, reach, bins, gravity)), ["halo", "bin"]).where(slow).select(*bound.columns))
        before, n = n, bound.count()
        if n == before:
            break
    means = [F.try_divide(F.sum(F.col("m") * F.col(f"v{k}")), F.sum("m")).alias(f"V{c}") for k, c in enumerate("XYZ")]
    left = bound.groupBy("halo").agg(F.count("*").alias("n_bound"), F.sum("m").alias("mass_bound"), *means)
    out = found.drop("cut").join(left, "halo", "left")
    return out.withColumns({"n_bound": F.coalesce("n_bound", F.lit(0).cast("long")), "mass_bound": F.coalesce("mass_bound", F.lit(0.0))})


def cores(tree: DataFrame) -> DataFrame:
    """``halo`` and ``X Y Z`` of the groups in which no finer one lies; ``tree`` is what ``groups.dense_groups`` gave."""
    up = tree.where("parent is not null").select(F.col("parent").alias("group")).distinct()
    return tree.join(up, "group", "left_anti").where("X is not null").select(F.col("group").alias("halo"), "X", "Y", "Z")
