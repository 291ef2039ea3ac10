"""Smoothing and isosurfaces by blocks against brute force over whole arrays."""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.model import ROW, Geometry
from meshlake.operators import surface


def volume(spark, n, seed=0, missing=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    x[rng.random(n) < missing] = np.nan
    flat = x.transpose(2, 1, 0).ravel()
    rows = [(k, None if np.isnan(v) else float(v)) for k, v in enumerate(flat)]
    return x, spark.createDataFrame(rows, f"{ROW} long, v double").repartition(5)


def brute_smooth(x, reach, deviation):
    out = np.full(x.shape, np.nan)
    for at in np.ndindex(*x.shape):
        total = weight = 0.0
        for step in np.ndindex(*(2 * reach + 1,) * 3):
            to = [a + s - reach for a, s in zip(at, step)]
            if all(0 <= t < m for t, m in zip(to, x.shape)) and np.isfinite(x[tuple(to)]):
                w = np.exp(-0.5 * sum((s - reach) ** 2 for s in step) / deviation**2)
                total, weight = total + w * x[tuple(to)], weight + w
        if np.isfinite(x[at]):
            out[at] = total / weight
    return out


def array_of(df, geometry, field="v"):
    out = np.full(geometry.n, np.nan)
    for r in df.collect():
        k = r[ROW]
        out[k % geometry.n[0], k // geometry.n[0] % geometry.n[1], k // (geometry.n[0] * geometry.n[1])] = r[field]
    return out


@pytest.mark.parametrize("amount", ["none", "medium", "high"])
@pytest.mark.parametrize("missing,block", [(0.0, 3), (0.2, 4), (0.1, 32)])
def test_smoothing_by_brute_force(spark, amount, missing, block):
    geometry = Geometry((9, 4, 7))
    x, df = volume(spark, geometry.n, 1, missing)
    got = array_of(surface.smooth(df, "v", geometry, amount, block=block), geometry)
    reach, deviation = surface.SMOOTHING[amount]
    assert np.allclose(got, brute_smooth(x, reach, deviation) if reach else x, equal_nan=True)


def test_cells_go_to_neighbours_only(spark):
    geometry = Geometry((12, 12, 12))
    _, df = volume(spark, geometry.n)
    rows = surface.bordered(df, "v", geometry, 1, 2, 4).collect()
    for r in rows:
        k, b = r["__cell"], r["__block"]
        cell, block = (k % 12, k // 12 % 12, k // 144), (b % 3, b // 3 % 3, b // 9)
        assert all(4 * j - 1 <= i < 4 * j + 4 + 2 for i, j in zip(cell, block))
    axis = [sum(4 * j - 1 <= i < 4 * j + 6 for j in range(3)) for i in range(12)]
    assert len(rows) == sum(axis) ** 3 and len({(r["__cell"], r["__block"]) for r in rows}) == len(rows)


def brute_triangles(x, level):
    out = set()
    for at in np.ndindex(*(s - 1 for s in x.shape)):
        for k, order in enumerate(permutations(range(3))):
            corner, corners = list(at), [tuple(at)]
            for axis in order:
                corner[axis] += 1
                corners.append(tuple(corner))
            values = [x[c] for c in corners]
            if not np.isfinite(values).all():
                continue
            up = [j for j in range(4) if values[j] >= level]
            down = [j for j in range(4) if values[j] < level]
            if up and down:
                points = {(i, j): tuple(np.round(np.array(corners[min(i, j)]) + (level - values[min(i, j)]) / (values[max(i, j)] - values[min(i, j)]) * (np.array(corners[max(i, j)]) - np.array(corners[min(i, j)])), 9)) for i in up for j in down}
                out.add((at, k, frozenset(points.values()), 2 if len(up) == 2 else 1))
    return out


@pytest.mark.parametrize("missing,block", [(0.0, 3), (0.1, 4), (0.0, 32)])
def test_triangles_by_brute_force(spark, missing, block):
    geometry = Geometry((8, 5, 6))
    x, df = volume(spark, geometry.n, 2, missing)
    rows = surface.isosurface(df, "v", geometry, 0.3, block=block).collect()
    found = {}
    for r in rows:
        k = r[ROW]
        key = ((k % 8, k // 8 % 5, k // 40), r["tetrahedron"])
        found.setdefault(key, []).append([tuple(np.round([r[f"{c}{m}"] for c in "xyz"], 9)) for m in (1, 2, 3)])
    assert {(*k, frozenset(p for t in v for p in t), len(v)) for k, v in found.items()} == brute_triangles(x, 0.3)
    assert len(rows) == len({(r[ROW], r["tetrahedron"], r["part"]) for r in rows})


def test_surface_of_a_ball_is_closed_and_round(spark):
    n = 24
    geometry = Geometry((n, n, n), (0.5, 0.5, 0.5), (-6.0, -6.0, -6.0))
    place = [geometry.origin[k] + i * geometry.size[k] for k, i in enumerate(geometry.index())]
    ball = spark.range(n**3).withColumnRenamed("id", ROW).withColumn("v", 16.0 - sum(p * p for p in place))
    df = surface.isosurface(ball, "v", geometry, 0.0, block=7)
    rows = df.collect()
    points = [[tuple(np.round([r[f"{c}{m}"] for c in "xyz"], 9)) for m in (1, 2, 3)] for r in rows]
    points = [p for p in points if len(set(p)) == 3]
    edges = Counter((p[i], p[(i + 1) % 3]) for p in points for i in range(3))
    assert all(edges[b, a] == m for (a, b), m in edges.items())  # each edge once in each direction
    p = np.array(points)
    cross = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    assert (np.einsum("ij,ij->i", cross, p.mean(1)) >= -1e-12).all()  # outwards: the field falls from the middle
    assert np.linalg.norm(cross, axis=1).sum() / 2 == pytest.approx(4 * np.pi * 16, rel=0.02)


def test_smoothed_surface_is_that_of_the_smoothed_volume(spark):
    geometry = Geometry((10, 9, 8))
    x, df = volume(spark, geometry.n, 4)
    one = surface.isosurface(df, "v", geometry, 0.1, "high", block=4)
    two = surface.isosurface(surface.smooth(df, "v", geometry, "high"), "v", geometry, 0.1)
    rounded = lambda d: sorted(tuple(round(x, 6) for x in r) for r in d.collect())
    assert rounded(one) == rounded(two) and len(rounded(one)) > 10


def test_absent_cells_levels_and_empty_volumes(spark):
    geometry = Geometry((9, 9, 9))
    one = spark.createDataFrame([(4 + 9 * (4 + 9 * 4), 1.0), (9**3 + 5, 7.0)], f"{ROW} long, v double")  # the second is no cell
    assert surface.isosurface(one, "v", geometry, 0.5, block=4).count() == 0
    filled = surface.isosurface(one, "v", geometry, 0.5, fill=0.0, block=4)
    assert filled.count() == brute_count(geometry, (4, 4, 4))
    assert surface.relative_level(one, "v", 51) == pytest.approx(1.2)
    assert surface.isosurface(one.limit(0), "v", geometry, 0.5, fill=0.0).count() == 0
    flat = spark.range(9**3).select(F.col("id").alias(ROW), F.lit(2.0).alias("v"))
    assert surface.isosurface(flat, "v", geometry, 2.0).count() == 0


def brute_count(geometry, at):
    x = np.zeros(geometry.n)
    x[at] = 1.0
    return sum(t[3] for t in brute_triangles(x, 0.5))
