"""Points as round blobs seen by a camera: where they are in a picture, how bright, and the picture.

The picture is one aggregate.  What a blob does to a pixel's light is an affine map,
light -> light * exp(-a) + s, and maps one after the other are again one, so it does not
matter how the order of depths is cut: a task folds its blobs into one (a, s) for each pixel
that they touch, and the tasks' pairs are folded pixel by pixel.  Where all blobs absorb as
they shine the order has no say and the optical depths just add up; then no blob moves at
all.  A picture's tiles are kept as arrays in tasks and handed on beyond a bound, so a tile
under most of the blobs costs the shuffle one row for each pixel and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels along a tile's sides, tiles that a task holds, and pixels under blobs that are worked on at once.
TILE, TILES, AREA = 128, 256, 1 << 20
#: Fixed value: the width of the Gaussian that stands for the smoothing kernel, in radii.
WIDTH = 0.5 * math.pi ** (-1 / 6)


@dataclass(frozen=True)
class Camera:
    """A camera at ``position`` that looks at ``target``, with ``up`` upwards; ``angle`` is the view's width in degrees.

    Without ``perspective``, sizes are as at the target's distance.  Only depths between
    ``near`` and ``far`` are seen; ``least`` is added to radii in pixels, as a right angle.
    """

    position: tuple[float, float, float]
    target: tuple[float, float, float]
    up: tuple[float, float, float] = (0.0, 0.0, 1.0)
    angle: float = 45.0
    pixels: tuple[int, int] = (800, 800)
    near: float = 0.0
    far: float = 1e23
    perspective: bool = True
    least: float = 1.0

    @property
    def distance(self) -> float:
        return math.dist(self.position, self.target)

    def axes(self) -> np.ndarray:
        """To the right, upwards and into the picture, as rows."""
        into = np.subtract(self.target, self.position)
        right = np.cross(self.up, into)
        if not np.linalg.norm(into) or not np.linalg.norm(right):
            raise ValueError("the camera looks nowhere, or upwards")
        into, right = into / np.linalg.norm(into), right / np.linalg.norm(right)
        return np.stack([right, np.cross(into, right), into])

    def scale(self, depth: Column) -> Column:
        """Pixels for each length at a depth."""
        return F.lit(self.pixels[0] / (2 * math.tan(math.radians(self.angle) / 2))) / (depth if self.perspective else F.lit(self.distance))


def project(df: DataFrame, points: Sequence[str], radius: str, values: Sequence[str], camera: Camera) -> DataFrame:
    """The rows that reach the picture, with their pixels: ``px``, ``py``, ``depth``, ``pr`` (radius) and the ``values`` as brightness of the middle.

    A blob is a kernel of its radius and of mass 1: its middle has the kernel's column
    through a Gaussian of WIDTH radii, and where it is widened by ``least`` keeps its light.
    Rows with a missing number, or a radius that is not above 0, are left out.  Columns of
    those names are replaced; all others stay.
    """
    place = [F.col(f"`{c}`").cast("double") - at for c, at in zip(points, camera.position)]
    x, y, z = (sum((F.lit(float(w)) * p for w, p in zip(axis, place)), F.lit(0.0)) for axis in camera.axes())
    seen = df.withColumn("__r", F.col(f"`{radius}`").cast("double")).withColumns({"depth": z, "__x": x, "__y": y})
    seen = seen.where((F.col("depth") > max(0.0, camera.near)) & (F.col("depth") < camera.far) & (F.col("__r") > 0))
    scale = camera.scale(F.col("depth"))
    plain = F.col("__r") * scale
    wide = F.sqrt(plain * plain + camera.least**2)
    column = F.lit(8 * WIDTH / math.sqrt(math.pi)) / (F.col("__r") * F.col("__r"))
    share = plain * plain / (wide * wide)
    seen = seen.withColumns({"px": F.lit(camera.pixels[0] / 2) + F.col("__x") * scale, "py": F.lit(camera.pixels[1] / 2) + F.col("__y") * scale, "pr": wide, "__k": column * share})
    seen = seen.withColumns({v: F.col(f"`{v}`").cast("double") * F.col("__k") for v in values})
    reach = lambda p, n: (F.floor(F.col(p) + F.col("pr")) >= 0) & (F.floor(F.col(p) - F.col("pr")) + 1 < n)
    known = [F.abs(F.col(f"`{v}`")) < float("inf") for v in (*values, "pr", "px", "py")]
    for test in (reach("px", camera.pixels[0]), reach("py", camera.pixels[1]), *known):
        seen = seen.where(test)
    return seen.drop("__x", "__y", "__r", "__k")


class Picture:
    """Optical depth and light of the pixels that a task has touched, by tiles."""

    def __init__(self, pixels: tuple[int, int], n: int):
        self.pixels, self.n = pixels, n
        self.tiles: dict[tuple[int, int], np.ndarray] = {}

    def fold(self, x: np.ndarray, y: np.ndarray, r: np.ndarray, values: np.ndarray, absorb: float | None) -> None:
        """Blobs from far to near, in parts of about AREA pixels; a larger blob by its rows of pixels."""
        nx, ny = self.pixels
        x0, y0 = (np.maximum(np.floor(c - r).astype(np.int64) + 1, 0) for c in (x, y))
        x1, y1 = (np.minimum(np.floor(c + r).astype(np.int64), m - 1) for c, m in ((x, nx), (y, ny)))
        wide, high = np.maximum(x1 - x0 + 1, 0), np.maximum(y1 - y0 + 1, 0)
        size = wide * high
        at = 0
        while at < len(x):
            stop = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), AREA, side="right")))
            rows = AREA // max(1, int(wide[at])) if stop == at + 1 and size[at] > AREA else None
            for low in range(int(y0[at]), int(y1[at]) + 1, max(1, rows)) if rows is not None else [None]:
                b = slice(at, stop)
                begin, tall = (y0[b], high[b]) if low is None else (np.array([low]), np.array([min(max(1, rows), int(y1[at]) - low + 1)]))
                self._fold(x[b], y[b], r[b], values[:, b], x0[b], wide[b], begin, tall, absorb)
            at = stop

    def _fold(self, x, y, r, values, x0, wide, y0, tall, absorb) -> None:  # noqa: ANN001
        size = wide * tall
        of = np.repeat(np.arange(len(x)), size)
        step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        ix, iy = x0[of] + step % np.maximum(wide, 1)[of], y0[of] + step // np.maximum(wide, 1)[of]
        dx, dy = ix - x[of], iy - y[of]
        half = np.sqrt(np.maximum(r[of] ** 2 - dx * dx, 0))
        inside = (dy > -half) & (dy <= half)
        of, ix, iy, dx, dy = (c[inside] for c in (of, ix, iy, dx, dy))
        shade = np.exp(-(dx * dx + dy * dy) / (WIDTH * r[of]) ** 2)
        pixel = ix + self.pixels[0] * iy
        order = np.argsort(pixel, kind="stable")  # in a pixel still from far to near
        found, first = np.unique(pixel[order], return_index=True)
        if not len(found):
            return
        depth, light = np.zeros((self.n, len(found))), np.zeros((self.n, len(found)))
        last = np.append(first[1:], len(order)) - 1
        for k in range(self.n):
            e = values[k][of][order]
            a = e * shade[order]
            sums = np.add.reduceat(a, first)
            depth[k] = sums
            if absorb is not None:
                # what is nearer than each blob in its pixel
                total = np.cumsum(a)
                nearer = np.repeat(total[last], np.diff(np.append(first, len(order)))) - total
                share = np.divide(e, e + absorb, out=np.zeros_like(e), where=e + absorb != 0)
                light[k] = np.add.reduceat(-np.expm1(-a) * share * np.exp(-nearer), first)
        fx, fy = found % self.pixels[0], found // self.pixels[0]
        tile = fx // TILE + (1 << 20) * (fy // TILE)
        for t in np.unique(tile).tolist():
            has = tile == t
            mine = self.tiles.setdefault((t % (1 << 20), t >> 20), np.zeros((2, self.n, TILE, TILE)))
            u, v = fx[has] % TILE, fy[has] % TILE
            mine[1][:, u, v] = light[:, has] + np.exp(-depth[:, has]) * mine[1][:, u, v]
            mine[0][:, u, v] += depth[:, has]

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for (tx, ty), mine in sorted(self.tiles.items()):
            u, v = np.nonzero((mine != 0).any((0, 1)))
            yield u + tx * TILE, v + ty * TILE, mine[0][:, u, v], mine[1][:, u, v]
        self.tiles.clear()


def picture(seen: DataFrame, values: Sequence[str], camera: Camera, absorb: float | None = None, order: Sequence[str] = ()) -> DataFrame:
    """``ix``, ``iy`` and the values of all pixels that a blob of ``project`` touches.

    A blob's optical depth at a pixel is its brightness times a Gaussian of WIDTH of its
    radius, up to the radius.  By default blobs absorb as much as they shine, and a pixel has
    1 - exp(-depth).  With ``absorb``, a blob shines e / (e + absorb) of what it covers, and
    the nearest one is in front; of equal depths the lesser one by the columns ``order`` is.
    """
    values, n = list(values), len(values)
    columns = ["px", "py", "pr", *[f"__v{k}" for k in range(n)]]
    pixels = camera.pixels
    named = [F.col("px"), F.col("py"), F.col("pr"), *[F.col(f"`{v}`").alias(f"__v{k}") for k, v in enumerate(values)]]
    if absorb is None:
        blobs = seen.select(*named)
    else:
        far = [F.desc("depth"), *[F.desc(f"`{c}`") for c in order]]
        blobs = seen.select(*named, "depth", *[F.col(f"`{c}`") for c in order if c not in ("depth", *columns)]).repartitionByRange(*far).sortWithinPartitions(*far).select(*columns)
    schema = "slab int, piece int, ix int, iy int, " + ", ".join(f"a{k} double, s{k} double" for k in range(n))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slab, piece, shot = TaskContext.get().partitionId(), 0, Picture(pixels, n)

        def out() -> Iterator[pa.RecordBatch]:
            for ix, iy, a, s in shot.rows():
                head = [pa.array(np.full(len(ix), x), pa.int32()) for x in (slab, piece)] + [pa.array(c, pa.int32()) for c in (ix, iy)]
                yield pa.RecordBatch.from_arrays([*head, *[pa.array(c) for k in range(n) for c in (a[k], s[k])]], schema=wanted)

        wanted = pa.schema([(x, pa.int32()) for x in ("slab", "piece", "ix", "iy")] + [(f"{c}{k}", pa.float64()) for k in range(n) for c in "as"])
        for b in batches:
            x, y, r, *v = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            shot.fold(x, y, r, np.stack(v), absorb)
            if len(shot.tiles) > TILES:
                yield from out()
                piece += 1
        yield from out()

    parts = blobs.mapInArrow(folded, schema)
    if absorb is None:
        return parts.groupBy("ix", "iy").agg(*[(-F.expm1(-F.sum(f"a{k}"))).alias(v) for k, v in enumerate(values)])
    # far slabs first; what stands in the far ones is seen through the nearer ones
    every = parts.groupBy("ix", "iy").agg(F.array_sort(F.collect_list(F.struct("slab", "piece", *[f"{c}{k}" for k in range(n) for c in "as"]))).alias("f"))
    light = lambda k: F.aggregate("f", F.lit(0.0), lambda s, p: s * F.exp(-p[f"a{k}"]) + p[f"s{k}"])
    return every.select("ix", "iy", *[light(k).alias(v) for k, v in enumerate(values)])
