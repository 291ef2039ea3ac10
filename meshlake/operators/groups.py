"""Groups of points that lie close together, level by level of a mesh that gets finer where it is dense.

The points are counted once, in cells of the finest level; the counts of a coarser cell are
those of its eight parts.  A cell is dense if it holds ``least`` points, so the cells around
a dense one are dense too, and each level has the dense cells of the level before, cut
finer.  Dense cells with a common side are one group, and the groups of a level lie in
those of the level before: a tree, with the large groups at its root and their cores as
leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Geometry, kept
from .grid import bounds_geometry

CELL = ("x", "y", "z")


def cells(df: DataFrame, points: Sequence[str], geometry: Geometry, level: int) -> DataFrame:
    """The rows with ``__x __y __z``, their cell of the mesh cut ``level`` times in two; the far sides belong to the last cells, rows outside or without a place to none."""
    out = df
    for c, name, n, o, d in zip(points, CELL, geometry.n, geometry.origin, geometry.size):
        value, fine = F.col(f"`{c}`").cast("double"), n << level
        place = F.least(F.floor((value - F.lit(o)) / F.lit(d / (1 << level))), F.lit(fine - 1))
        out = out.withColumn(f"__{name}", F.when(value.between(o, o + d * n), place).cast("long"))
    return out.where(" and ".join(f"__{name} is not null" for name in CELL))


def dense_cells(df: DataFrame, points: Sequence[str], geometry: Geometry, least: int, levels: int, mass: str | None = None) -> DataFrame:
    """``level`` (0 to ``levels - 1``), ``x y z``, ``n``, ``mass`` and the mass-weighted sums ``sx sy sz`` of the cells with ``least`` points or more.

    ``mass`` is 1 for each point without a column of it; missing masses count 0.
    """
    weight = F.lit(1.0) if mass is None else F.coalesce(F.col(f"`{mass}`").cast("double"), F.lit(0.0))
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"p{k}") for k, c in enumerate(points)], weight.alias("m"))
    last = levels - 1
    found = cells(rows, ["p0", "p1", "p2"], geometry, last).groupBy(*[F.col(f"__{c}").alias(c) for c in CELL]).agg(F.count("*").alias("n"), F.sum("m").alias("mass"), *[F.sum(F.col("m") * F.col(f"p{k}")).alias(f"s{c}") for k, c in enumerate(CELL)])
    finest = kept(found)
    sums = ["n", "mass", *[f"s{c}" for c in CELL]]
    out = None
    for level in range(levels):
        up = last - level
        coarse = finest.select(*[F.shiftright(c, up).alias(c) for c in CELL], *sums).groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in sums])
        part = coarse.where(F.col("n") >= least).select(F.lit(level).alias("level"), *CELL, *sums)
        out = part if out is None else out.unionByName(part)
    return out


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node`` and ``least``: the least node that each one reaches, over ``edges`` (``a``, ``b``, each of them once).

    By contraction: each node with edges joins its least neighbour if that is less than
    itself, then the one which that one joined; nodes that joined are one node of the next
    round, and edges inside it are gone.  Of two neighbours one joins, so at most half of the
    nodes that have edges are left after a round, and the least of all never joins another.
    What a round leaves is kept as tables; only whether edges are left comes to the driver.
    """
    left = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = nodes.select("node", F.col("node").alias("least"))
    while not left.isEmpty():
        joined = kept(left.groupBy("a").agg(F.least("a", F.min("b")).alias("to")))
        jump = joined.select(F.col("a").alias("to"), F.col("to").alias("far"))
        joined = kept(joined.join(jump, "to").select("a", F.col("far").alias("to")))
        of = joined.withColumnRenamed("a", "least")
        labels = kept(labels.join(of, "least", "left").select("node", F.coalesce("to", "least").alias("least")))
        ends = left.join(joined, "a").select(F.col("to").alias("x"), F.col("b").alias("a")).join(joined, "a").select(F.col("x").alias("a"), F.col("to").alias("b"))
        left = kept(ends.where("a <> b").distinct())
    return labels


def group_cells(dense: DataFrame, geometry: Geometry, levels: int, periodic: bool = False) -> DataFrame:
    """The dense cells with ``cell``, a number that no other cell of any level has, ascending by level, and ``group``, the least one of its group."""
    # cells of a level are numbered x fastest, behind those of all levels before
    before, number = 0, F.lit(None).cast("long")
    for level in range(levels):
        nx, ny, nz = (n << level for n in geometry.n)
        own = F.lit(before).cast("long") + F.col("x") + nx * (F.col("y") + ny * F.col("z"))
        number = F.when(F.col("level") == level, own).otherwise(number)
        before += nx * ny * nz
    named = kept(dense.withColumn("cell", number))
    sides = []
    for k, c in enumerate(CELL):
        fine = F.lit(geometry.n[k]) * F.pow(F.lit(2), F.col("level")).cast("long")
        ahead = F.col(c) + 1
        ahead = F.when(ahead < fine, ahead).when(F.lit(periodic) & (fine > 1), 0) if periodic else ahead
        sides.append(F.struct(*[(ahead if x == c else F.col(x)).cast("long").alias(x) for x in CELL]))
    ways = named.select("level", F.col("cell").alias("a"), F.explode(F.array(*sides)).alias("to")).select("level", "a", *[F.col(f"to.{x}").alias(x) for x in CELL])
    edges = ways.join(named.select("level", *CELL, F.col("cell").alias("b")), ["level", *CELL]).select("a", "b").where("a <> b")
    labels = components(named.select(F.col("cell").alias("node")), edges)
    return named.join(labels.select(F.col("node").alias("cell"), F.col("least").alias("group")), "cell")


def dense_groups(df: DataFrame, points: Sequence[str], resolution: Sequence[int] = (8, 8, 8), least: int = 100, levels: int = 4, mass: str | None = None, geometry: Geometry | None = None, periodic: bool = False) -> DataFrame:
    """The tree of groups: ``level``, ``group``, ``parent`` (null at level 0), ``n_cells``, ``n`` (points), ``mass`` and the centre of mass ``X Y Z``.

    The mesh is that of ``resolution`` over the points' ranges, or ``geometry``.  Without
    points, or without a dense cell, there is no row.  The centre is null where the mass is
    0, and in a periodic mesh it is that of the places as they are.
    """
    geometry = geometry or bounds_geometry(df, points, resolution)
    found = kept(group_cells(dense_cells(df, points, geometry, least, levels, mass), geometry, levels, periodic))
    up = found.select((F.col("level") + 1).alias("level"), *[F.col(c).alias(f"u{c}") for c in CELL], F.col("group").alias("parent"))
    child = found.select("*", *[F.shiftright(c, 1).alias(f"u{c}") for c in CELL]).join(up, ["level", *[f"u{c}" for c in CELL]], "left")
    sums = child.groupBy("level", "group").agg(F.min("parent").alias("parent"), F.count("*").alias("n_cells"), *[F.sum(c).alias(c) for c in ("n", "mass", "sx", "sy", "sz")])
    centre = [F.try_divide(f"s{c}", "mass").alias(c.upper()) for c in CELL]
    return sums.select("level", "group", "parent", "n_cells", "n", "mass", *centre)


def members(df: DataFrame, points: Sequence[str], grouped: DataFrame, geometry: Geometry, level: int) -> DataFrame:
    """The rows of ``df`` in a dense cell of ``level``, with ``group``; ``grouped`` is what ``group_cells`` gave.

    The join is by cell, and a cell may hold very many points: Spark's skew join splits it.
    """
    own = grouped.where(F.col("level") == level).select(*[F.col(c).alias(f"__{c}") for c in CELL], "group")
    out = cells(df.drop("group"), points, geometry, level)
    return out.join(own, [f"__{c}" for c in CELL]).drop(*[f"__{c}" for c in CELL])
