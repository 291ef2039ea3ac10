"""Isosurfaces of volumes, with Gaussian smoothing, by blocks of cells.

A volume is cut into blocks of BLOCK cells along each axis.  What a block needs of others is
a border as wide as the smoothing reaches, and one plane of cells more towards the far
sides, so a cell near a side is also sent to the blocks there and to no others.  One
shuffle then brings each block all it needs, and smoothing and triangles follow from
arrays.  A value of a volume stands at its cell's place; a cube has eight of them as its
corners and belongs to the block of its lowest one.
"""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ROW, Geometry

#: Cells of a block along each axis.
BLOCK = 32
#: Cells that a smoothing reaches along each axis, and its standard deviation in cells.
SMOOTHING = {"none": (0, 0.0), "medium": (1, 1.6), "high": (2, 2.0)}

#: The six tetrahedra of a cube, by the corners (numbers x + 2 y + 4 z) on the ways along its sides
#: from the lowest to the highest one.  Neighbouring cubes cut their common side alike.
TETRAHEDRA = [[0, 1 << a, (1 << a) | (1 << b), 7] for a, b, _ in permutations(range(3))]


def bordered(mesh: DataFrame, field: str, geometry: Geometry, low: int, high: int, block: int) -> DataFrame:
    """``__block``, ``__cell`` and ``__value``: each cell for its own block and for those that have it within ``low`` or ``high`` cells of their near or far sides."""
    rows = mesh.select(F.col(ROW).cast("long").alias("__cell"), F.col(field).cast("double").alias("__value")).where(F.col("__cell").between(0, geometry.cells - 1))
    index = Geometry(geometry.n).index()
    rows = rows.withColumnsRenamed({"__cell": ROW})
    for k, (i, n) in enumerate(zip(index, geometry.n)):
        # blocks whose range of cells, widened by the borders, holds i
        first = F.greatest(F.lit(0), F.floor((i - F.lit(block - 1 + high)) / F.lit(block)) + F.when((i - F.lit(block - 1 + high)) % block != 0, 1).otherwise(0))
        last = F.least(F.lit((n - 1) // block), F.floor((i + F.lit(low)) / F.lit(block)))
        rows = rows.withColumn(f"__b{k}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    blocks = [-(-n // block) for n in geometry.n]
    number = F.col("__b0").cast("long") + blocks[0] * (F.col("__b1").cast("long") + blocks[1] * F.col("__b2").cast("long"))
    return rows.select(number.alias("__block"), F.col(ROW).alias("__cell"), "__value")


class Block:
    """The values of a block and its borders as an array, NaN where there is none; ``at`` is the cell of its first element."""

    def __init__(self, group: pa.Table, geometry: Geometry, low: int, high: int, block: int, fill: float | None):
        n = geometry.n
        number, blocks = group["__block"][0].as_py(), [-(-x // block) for x in n]
        place = (number % blocks[0], number // blocks[0] % blocks[1], number // (blocks[0] * blocks[1]))
        self.begin = [block * p for p in place]
        self.end = [min(b + block, x) for b, x in zip(self.begin, n)]
        self.at = [max(0, b - low) for b in self.begin]
        stop = [min(e + high, x) for e, x in zip(self.end, n)]
        self.values = np.full([s - a for a, s in zip(self.at, stop)], np.nan if fill is None else fill)
        cell, value = group["__cell"].to_numpy(), group["__value"].to_numpy()
        self.values[cell % n[0] - self.at[0], cell // n[0] % n[1] - self.at[1], cell // (n[0] * n[1]) - self.at[2]] = value
        self.n = n

    def inner(self, values: np.ndarray, more: int = 0) -> np.ndarray:
        """The part of the block's own cells, with ``more`` planes towards the far sides."""
        return values[tuple(slice(b - a, e - a + more) for a, b, e in zip(self.at, self.begin, self.end))]

    def cells(self, index: tuple[np.ndarray, ...]) -> np.ndarray:
        """Rows of the volume from places in the block's own part."""
        x, y, z = (np.asarray(i) + b for i, b in zip(index, self.begin))
        return x + self.n[0] * (y + self.n[1] * z)


def smoothed(values: np.ndarray, reach: int, deviation: float) -> np.ndarray:
    """Gaussian weights along each axis in turn; cells without a value, and beyond the volume, weigh nothing and stay without one."""
    if not reach:
        return values
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / deviation) ** 2)
    known = np.isfinite(values)
    total, weight = np.where(known, values, 0.0), known.astype(np.float64)
    for axis in range(3):
        total, weight = (_along(x, weights, axis) for x in (total, weight))
    return np.where(known, total / np.where(known, weight, 1.0), np.nan)


def _along(x: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    reach, n = len(weights) // 2, x.shape[axis]
    out = np.zeros_like(x)
    for step, w in zip(range(-reach, reach + 1), weights):
        a, b = max(0, -step), min(n, n - step)
        to, of = [slice(None)] * 3, [slice(None)] * 3
        to[axis], of[axis] = slice(a, b), slice(a + step, b + step)
        out[tuple(to)] += w * x[tuple(of)]
    return out


def smooth(mesh: DataFrame, field: str, geometry: Geometry, amount: str = "medium", fill: float | None = None, block: int = BLOCK) -> DataFrame:
    """``__row`` and the smoothed field (``amount``: a name in SMOOTHING) of all cells that have a value.

    Weights are those of cells inside that have a value, and add up to 1.  NULL, NaN and
    infinite values are none; absent rows are ``fill``, none by default.  A cell has one row.
    """
    reach, deviation = SMOOTHING[amount]

    def run(group: pa.Table) -> pa.Table:
        part = Block(group, geometry, reach, reach, block, fill)
        values = part.inner(smoothed(part.values, reach, deviation))
        known = np.nonzero(np.isfinite(values))
        return pa.table({ROW: pa.array(part.cells(known), pa.int64()), field: values[known]})

    return bordered(mesh, field, geometry, reach, reach, block).groupBy("__block").applyInArrow(run, f"{ROW} long, `{field}` double")


def relative_level(mesh: DataFrame, field: str, value: float) -> float:
    """The level that a number from 0 to 255 stands for: that share of the field's range."""
    low, high = mesh.agg(F.min(F.col(field).cast("double")), F.max(F.col(field).cast("double"))).first()
    return value / 255.0 * ((high or 0.0) - (low or 0.0))


TRIANGLES = f"{ROW} long, tetrahedron int, part int, " + ", ".join(f"{c}{k} double" for k in (1, 2, 3) for c in "xyz")


def isosurface(mesh: DataFrame, field: str, geometry: Geometry, level: float, amount: str = "none", fill: float | None = None, block: int = BLOCK) -> DataFrame:
    """Triangles where the field, smoothed or not, passes ``level``.

    Each cube is cut into six tetrahedra, in which the field is linear; one with corners on
    both sides (at ``level`` or above, and below) has one triangle, or two with two corners
    on each.  Returns the row of the cube's lowest corner, the tetrahedron (0 to 5), the part
    (0 or 1), and three points.  Seen from below the level the points go round against the
    clock.  Together the triangles have no gaps: points on a common edge are the same.
    A tetrahedron with a corner without a value has none.  Values as in ``smooth``.
    """
    reach, deviation = SMOOTHING[amount]

    def run(group: pa.Table) -> pa.Table:
        part = Block(group, geometry, reach, reach + 1, block, fill)
        values = part.inner(smoothed(part.values, reach, deviation), 1)
        found = [triangles(values, level, k) for k in range(6)]
        index, points, tetrahedron, number = (np.concatenate([x[j] for x in found]) for j in range(4))
        own = part.cells(tuple(index.T)) if len(index) else np.zeros(0, np.int64)
        places = (points + part.begin) * geometry.size + geometry.origin
        columns = {ROW: pa.array(own, pa.int64()), "tetrahedron": pa.array(tetrahedron, pa.int32()), "part": pa.array(number, pa.int32())}
        return pa.table(columns | {f"{c}{k + 1}": places[:, k, j] for k in range(3) for j, c in enumerate("xyz")})

    return bordered(mesh, field, geometry, reach, reach + 1, block).groupBy("__block").applyInArrow(run, TRIANGLES)


def triangles(values: np.ndarray, level: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of tetrahedron ``k`` of all cubes: the cubes' lowest corners, the triangles' points in cells from the first one, ``k``, and which of two a triangle is."""
    corners = np.array([[c & 1, c >> 1 & 1, c >> 2] for c in TETRAHEDRA[k]])
    shape = [max(0, s - 1) for s in values.shape]
    at = np.stack([values[tuple(slice(o, o + s) for o, s in zip(c, shape))] for c in corners], -1)  # cubes x 4
    inside = at >= level
    n_inside = np.where(np.isfinite(at).all(-1), inside.sum(-1), 0)
    cubes, points, number = [], [], []
    for case in product((False, True), repeat=4):
        a, b = [j for j in range(4) if case[j]], [j for j in range(4) if not case[j]]
        if not a or not b:
            continue
        has = np.argwhere((inside == case).all(-1) & (n_inside > 0))
        if not len(has):
            continue
        value = at[tuple(has.T)]

        def between(i: int, j: int) -> np.ndarray:
            """Where the edge from corner i, inside, to j passes the level; from its lesser end, so that all who share it agree."""
            one, two = sorted((i, j))
            t = (level - value[:, one]) / (value[:, two] - value[:, one])
            return has + corners[one] + t[:, None] * (corners[two] - corners[one])

        if len(a) == 2:
            ring = [between(a[0], b[0]), between(a[0], b[1]), between(a[1], b[1]), between(a[1], b[0])]
            parts = [(ring[0], ring[1], ring[2]), (ring[0], ring[2], ring[3])]
        else:
            parts = [tuple(between(i, j) for i in a for j in b)]
        outwards = corners[b].mean(0) - corners[a].mean(0)
        for m, (p, q, r) in enumerate(parts):
            back = (np.cross(q - p, r - p) @ outwards) < 0
            points.append(np.stack([p, np.where(back[:, None], r, q), np.where(back[:, None], q, r)], 1))
            cubes.append(has)
            number.append(np.full(len(has), m))
    if not cubes:
        return np.zeros((0, 3), np.int64), np.zeros((0, 3, 3)), np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(cubes), np.concatenate(points), np.full(sum(map(len, cubes)), k), np.concatenate(number)
