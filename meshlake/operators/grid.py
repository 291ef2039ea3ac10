"""Points to meshes and back.

A point's place along an axis is p = (x - origin) / size of a cell; cell i stands at p = i.
A scheme gives the cells that a point touches, with weights, axis by axis: the nearest one
(NGP), the two around it (CIC), or three by a quadratic spline (TSC).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ROW, Geometry, dense

#: Cells of a mesh up to which it is broadcast for a gather; larger ones go by a shuffle.
BROADCAST_CELLS = 1 << 21
#: Cells from the origin within which a place has one; beyond, neighbouring doubles are a cell apart.
FARTHEST = float(1 << 52)


def bounds_geometry(df: DataFrame, points: Sequence[str], resolution: Sequence[int]) -> Geometry:
    """The mesh from the least to the greatest point."""
    found = df.agg(*[f(F.col(c).cast("double")) for c in points for f in (F.min, F.max)]).first()
    low = [found[2 * i] or 0.0 for i in range(3)]
    high = [found[2 * i + 1] or 0.0 for i in range(3)]
    size = [(b - a) / n if b > a else 1.0 for a, b, n in zip(low, high, resolution)]
    return Geometry(tuple(resolution), tuple(size), tuple(low))


def axis_cells(p: Column, n: int, scheme: str, periodic: bool) -> Column:
    """The (cell, weight) of one axis as an array; cells outside are left out, or wrapped."""
    base = F.floor(p)
    pair = lambda i, w: F.struct(i.cast("long").alias("i"), w.cast("double").alias("w"))
    if scheme == "NGP":
        cells = [pair(F.ceil(p - 0.5), F.lit(1.0))]  # halves go down
    elif scheme == "CIC":
        d = p - base
        cells = [pair(base, 1 - d), pair(base + 1, d)]
    elif scheme == "TSC":
        cells = []
        for k in (-1, 0, 1, 2):
            d = F.abs(p - (base + k))
            cells.append(pair(base + k, F.when(d <= 0.5, 0.75 - d * d).when(d <= 1.5, 0.5 * (1.5 - d) * (1.5 - d)).otherwise(0.0)))
    else:
        raise ValueError(f"no scheme {scheme}")
    cells = F.array(*cells)
    if periodic:
        cells = F.transform(cells, lambda c: F.struct(F.pmod(c["i"], F.lit(n)).alias("i"), c["w"].alias("w")))
    return F.filter(cells, lambda c: (c["w"] != 0) & c["i"].between(0, n - 1))


def touched(df: DataFrame, points: Sequence[str], geometry: Geometry, scheme: str, periodic: bool) -> DataFrame:
    """A row for each point and cell that it touches: ``__cell`` and ``__weight``; axes are expanded one after the other."""
    out = df
    for k, (c, n, o, d) in enumerate(zip(points, geometry.n, geometry.origin, geometry.size)):
        p = (F.col(c).cast("double") - F.lit(o)) / F.lit(d)
        out = out.withColumn(f"__a{k}", F.explode(axis_cells(F.when(F.abs(p) < FARTHEST, p), n, scheme, periodic)))
    cell = geometry.row(*[F.col(f"__a{k}.i") for k in range(3)])
    weight = F.col("__a0.w") * F.col("__a1.w") * F.col("__a2.w")
    return out.withColumn("__cell", cell).withColumn("__weight", weight).drop("__a0", "__a1", "__a2")


def scatter(
    df: DataFrame, points: Sequence[str], fields: Sequence[str] = (), resolution: Sequence[int] = (32, 32, 32), scheme: str = "CIC",
    geometry: Geometry | None = None, periodic: bool = False, density: bool = True, average: bool = False, constant: float = 1.0, sparse: bool = False,
) -> tuple[DataFrame, Geometry]:
    """Spread the fields over a mesh: sums of weight times value, over the cell's volume if ``density``.

    Without fields, each point counts ``constant`` in a column ``Constant``.  ``average``
    uses NGP and gives NumberOfElements, and for each field its sum and average.  Cells
    that nothing touches have 0; ``sparse`` leaves them out.
    """
    geometry = geometry or bounds_geometry(df, points, resolution)
    df = df if fields else df.withColumn("Constant", F.lit(float(constant)))
    fields = list(fields) or ["Constant"]
    pairs = touched(df.select(*dict.fromkeys([*points, *fields])), points, geometry, "NGP" if average else scheme, periodic).groupBy(F.col("__cell").alias(ROW))
    if average:
        sums = [F.sum(F.col(c).cast("double")).alias(f"{c}Sum") for c in fields]
        mesh = pairs.agg(F.count("*").cast("double").alias("NumberOfElements"), *sums)
        mesh = mesh.withColumns({f"{c}Avg": F.try_divide(F.col(f"{c}Sum"), F.col("NumberOfElements")) for c in fields})
        mesh = mesh.select(ROW, "NumberOfElements", *[f"{c}{k}" for c in fields for k in ("Sum", "Avg")])
    else:
        by = geometry.volume if density else 1.0
        mesh = pairs.agg(*[(F.sum(F.col("__weight") * F.col(c)) / F.lit(by)).alias(c) for c in fields])
    if not sparse:
        mesh = dense(df.sparkSession, geometry).join(mesh, ROW, "left")
        mesh = mesh.fillna(0.0, [c for c in mesh.columns if c != ROW])
    return mesh, geometry


def gather(df: DataFrame, points: Sequence[str], mesh: DataFrame, field: str, geometry: Geometry, scheme: str = "CIC", density: bool = False, periodic: bool = False, floor: float = 1e-7, name: str = "__Grid2Point_") -> DataFrame:
    """A column with the mesh's values at the points (times the cell's volume, unless ``density``), from ``floor`` on.

    ``floor`` keeps values off 0 for logarithms.  The values of a mesh of up to
    BROADCAST_CELLS cells travel to the tasks as one array, and the sum of a point's cells
    is taken in its row: no row moves.  A larger mesh meets the cells of all points in a
    shuffle, and the sums come back to the points by position in another.

    Both ways: rows of one cell add up; missing cells, null values and rows of no cell of
    the mesh count nothing; a cell that is NaN counts only where its weight is not 0; points
    without a place, or outside, get ``floor``; a column of the result's name is replaced.
    """
    by = 1.0 if density else geometry.volume
    values = mesh.select(F.col(ROW).cast("long").alias("__cell"), F.col(field).cast("double").alias("__value"))
    values = values.where(F.col("__cell").between(0, geometry.cells - 1) & F.col("__value").isNotNull()).groupBy("__cell").agg(F.sum("__value").alias("__value"))
    if geometry.cells <= BROADCAST_CELLS:
        found = _gathered(df, points, values, geometry, scheme, periodic)
    else:
        cells = touched(df.select(ROW, *points), points, geometry, scheme, periodic)
        sums = cells.join(values, "__cell").groupBy(ROW).agg(F.sum(F.col("__weight") * F.col("__value")).alias("__sum"))
        found = df.join(sums, ROW, "left")
    return found.withColumn(name, F.lit(floor) + F.coalesce(F.col("__sum"), F.lit(0.0)) * F.lit(by)).drop("__sum")


def _gathered(df: DataFrame, points: Sequence[str], values: DataFrame, geometry: Geometry, scheme: str, periodic: bool) -> DataFrame:
    found = values.toArrow()
    whole = np.zeros(geometry.cells)
    whole[found["__cell"].to_numpy()] = found["__value"].to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(whole)
    columns = df.columns

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mesh = shared.value
        for b in batches:
            axes = []
            for c, n, o, d in zip(points, geometry.n, geometry.origin, geometry.size):
                x = b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
                axes.append(weights((x - o) / d, n, scheme, periodic))
            total = np.zeros(b.num_rows)
            for ix, wx in axes[0]:
                for iy, wy in axes[1]:
                    for iz, wz in axes[2]:
                        weight = wx * wy * wz
                        total += np.where(weight != 0, weight * mesh[ix + geometry.n[0] * (iy + geometry.n[1] * iz)], 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total)], names=[*columns, "__sum"])

    return df.mapInArrow(summed, df.withColumn("__sum", F.lit(0.0)).schema)


def weights(p: np.ndarray, n: int, scheme: str, periodic: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """``axis_cells`` for an array of places: (cell, weight) in turn; the weight is 0 where there is no such cell or no place."""
    known = np.abs(p) < FARTHEST
    p = np.where(known, p, 0.0)
    base = np.floor(p).astype(np.int64)
    if scheme == "NGP":
        cells = [(np.ceil(p - 0.5).astype(np.int64), np.ones(len(p)))]
    elif scheme == "CIC":
        d = p - base
        cells = [(base, 1 - d), (base + 1, d)]
    elif scheme == "TSC":
        cells = []
        for k in (-1, 0, 1, 2):
            d = np.abs(p - (base + k))
            cells.append((base + k, np.where(d <= 0.5, 0.75 - d * d, np.where(d <= 1.5, 0.5 * (1.5 - d) ** 2, 0.0))))
    else:
        raise ValueError(f"no scheme {scheme}")
    if periodic:
        return [(i % n, w * known) for i, w in cells]
    return [(np.clip(i, 0, n - 1), w * known * ((i >= 0) & (i < n))) for i, w in cells]


def axis_slice(mesh: DataFrame, geometry: Geometry, axis: int, index: int) -> DataFrame:
    """The cells of one plane across axis 1, 2 or 3."""
    return mesh.where(geometry.index()[axis - 1] == index)


def plane_cut(mesh: DataFrame, field: str, geometry: Geometry, corner: Sequence[float], u: Sequence[float], v: Sequence[float], n: tuple[int, int], periodic: bool = False) -> DataFrame:
    """``iu``, ``iv``, the place ``X Y Z`` and the field at ``n`` points of a plane, from the corner along ``u`` and ``v``, by the cells around each."""
    rows = mesh.sparkSession.range(n[0] * n[1])
    iu, iv = (F.col("id") % n[0]).cast("int"), F.expr(f"int(id div {n[0]})")
    place = [(F.lit(float(c)) + F.lit(float(a)) * iu + F.lit(float(b)) * iv).alias(x) for x, c, a, b in zip("XYZ", corner, u, v)]
    return gather(rows.select(F.col("id").alias(ROW), iu.alias("iu"), iv.alias("iv"), *place), "XYZ", mesh, field, geometry, density=True, periodic=periodic, floor=0.0, name=field)


def point_property(df: DataFrame, points: Sequence[str], field: str | None = None, resolution: Sequence[int] = (32, 32, 32), periodic: bool = False, name: str = "__PointProperty_") -> DataFrame:
    """The local density at each point: CIC to a mesh and back."""
    mesh, geometry = scatter(df, points, [field] if field else [], resolution, periodic=periodic, sparse=True)
    return gather(df, points, mesh, field or "Constant", geometry, density=True, periodic=periodic, name=name)


def closest_approach(events: DataFrame, first: Sequence[str], second: Sequence[str]) -> DataFrame:
    """Midpoint of closest approach (``px py pz``) and angle ``theta`` of two tracks.

    Each track is a point and a direction, six columns; parallel tracks have no midpoint.
    """
    p, u, q, v = ([F.col(c).cast("double") for c in x] for x in (first[:3], first[3:], second[:3], second[3:]))
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    w = [a - b for a, b in zip(p, q)]
    a, b, c, d, e = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    det = a * c - b * b
    s, t = F.try_divide(b * e - c * d, det), F.try_divide(a * e - b * d, det)
    mid = [(x + s * dx + y + t * dy) / 2 for x, dx, y, dy in zip(p, u, q, v)]
    cosine = F.try_divide(b, F.sqrt(a * c))
    theta = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return events.withColumns({"px": mid[0], "py": mid[1], "pz": mid[2], "theta": theta})


def voxel_statistics(events: DataFrame, geometry: Geometry, points: Sequence[str] = ("px", "py", "pz"), angle: str = "theta") -> DataFrame:
    """Per voxel: count, sum and mean of the angle and of its square, deviation, and the error 1 / sqrt(2 (n - 1))."""
    inside, index = F.lit(True), []
    for c, n, o, d in zip(points, geometry.n, geometry.origin, geometry.size):
        i = F.floor((F.col(c) - F.lit(o)) / F.lit(d)).cast("int")
        inside = inside & i.between(0, n - 1)
        index.append(i)
    theta = F.col(angle)
    return events.where(inside).groupBy(geometry.row(*index).alias(ROW)).agg(
        F.count("*").alias("n"), F.sum(theta).alias("sum_theta"), F.avg(theta).alias("mean_theta"), F.sum(theta * theta).alias("sum_theta2"),
        F.avg(theta * theta).alias("mean_theta2"), F.stddev_pop(theta).alias("sigma_theta"), F.try_divide(F.lit(1.0), F.sqrt(2.0 * (F.count("*") - 1))).alias("error"),
    )
