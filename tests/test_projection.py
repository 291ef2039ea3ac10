"""Blobs in a picture, by brute force over all pixels."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.operators import projection
from meshlake.operators.projection import Camera

CAMERA = Camera((0.0, -6.0, 1.0), (0.5, 0.0, 0.0), angle=50.0, pixels=(40, 30), near=0.5, far=20.0)
SCHEMA = "id long, x double, y double, z double, r double, e double, g double, depth string"


def blobs(n=120, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, *map(float, rng.normal(0, 2, 3)), float(rng.uniform(0.05, 0.8)), float(rng.uniform(0.1, 3)), float(k % 3), "kept") for k in range(n)]
    rows += [(1000, 0.0, 0.0, 0.0, None, 1.0, 1.0, ""), (1001, None, 0.0, 0.0, 0.2, 1.0, 1.0, ""), (1002, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, ""), (1003, 0.0, 0.0, 0.0, 0.3, None, 1.0, ""), (1004, 0.0, -9.0, 0.0, 0.3, 1.0, 1.0, ""), (1005, 0.0, 0.0, float("nan"), 0.3, 1.0, 1.0, "")]
    return rows + [rows[3], rows[3]]


def brute_place(row, c):
    into = np.subtract(c.target, c.position) / np.linalg.norm(np.subtract(c.target, c.position))
    right = np.cross(c.up, into) / np.linalg.norm(np.cross(c.up, into))
    up = np.cross(into, right)
    d = np.subtract(row[1:4], c.position)
    z = d @ into
    scale = c.pixels[0] / 2 / math.tan(math.radians(c.angle / 2)) / (z if c.perspective else c.distance)
    pr, r = math.hypot(row[4] * scale, c.least), row[4]
    # the kernel 8 / (pi r^3) exp(-(d / w r)^2) along the line through its middle
    k = 8 / (math.pi * r**3) * math.sqrt(math.pi) * projection.WIDTH * r * (r * scale / pr) ** 2
    return c.pixels[0] / 2 + (d @ right) * scale, c.pixels[1] / 2 + (d @ up) * scale, z, pr, k


def brute_picture(rows, c, absorb):
    light = np.zeros((2, *c.pixels))
    depth = np.zeros((2, *c.pixels))
    seen = []
    for row in rows:
        if any(v is None or v != v for v in row[1:7]) or row[4] <= 0:
            continue
        px, py, z, pr, k = brute_place(row, c)
        if c.near < z < c.far:
            seen.append((-z, -row[0], px, py, pr, row[5] * k, row[6] * k))
    touched = np.zeros(c.pixels, bool)
    for _, _, px, py, pr, *values in sorted(seen):
        for ix in range(c.pixels[0]):
            for iy in range(c.pixels[1]):
                dx, dy = ix - px, iy - py
                if dx * dx < pr * pr and -math.sqrt(pr * pr - dx * dx) < dy <= math.sqrt(pr * pr - dx * dx):
                    touched[ix, iy] = True
                    for j, e in enumerate(values):
                        a = e * math.exp(-(dx * dx + dy * dy) / (projection.WIDTH * pr) ** 2)
                        depth[j, ix, iy] += a
                        if absorb is not None and e + absorb:
                            light[j, ix, iy] = light[j, ix, iy] * math.exp(-a) + e / (e + absorb) * (1 - math.exp(-a))
    return touched, 1 - np.exp(-depth) if absorb is None else light


@pytest.mark.parametrize("absorb", [None, 0.2, 5.0])
@pytest.mark.parametrize("perspective", [True, False])
@pytest.mark.parametrize("bounds", [(128, 256, 1 << 20), (8, 2, 50)])
def test_pictures_by_brute_force(spark, monkeypatch, absorb, perspective, bounds):
    for name, x in zip(("TILE", "TILES", "AREA"), bounds):
        monkeypatch.setattr(projection, name, x)
    camera = Camera(**{**CAMERA.__dict__, "perspective": perspective})
    rows = blobs()
    seen = projection.project(spark.createDataFrame(rows, SCHEMA).repartition(7), "xyz", "r", ["e", "g"], camera)
    got = projection.picture(seen, ["e", "g"], camera, absorb, ["id"])
    touched, want = brute_picture(rows, camera, absorb)
    found = np.zeros((2, *camera.pixels))
    marks = np.zeros(camera.pixels, bool)
    for r in got.collect():
        found[:, r["ix"], r["iy"]], marks[r["ix"], r["iy"]] = (r["e"], r["g"]), True
    assert (marks == touched).all() and touched.sum() > 300
    assert np.allclose(found, want, atol=1e-9)


def test_places_and_rows_that_reach(spark):
    rows = blobs(300, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    got = projection.project(df, "xyz", "r", ["e"], CAMERA).collect()
    by_id = {r["id"]: r for r in got}
    assert {k for k in by_id if k >= 1000} == set() and len(got) > 50
    for row in rows[:300]:
        px, py, z, pr, k = brute_place(row, CAMERA)
        reach = CAMERA.near < z < CAMERA.far and any(-pr < x - px <= pr for x in range(40)) and any(-pr < y - py <= pr for y in range(30))
        assert (row[0] in by_id) == reach
        if reach:
            r = by_id[row[0]]
            assert (r["px"], r["py"], r["depth"], r["pr"], r["e"]) == pytest.approx((px, py, z, pr, row[5] * k))
    with pytest.raises(ValueError):
        Camera((0.0, 0.0, 0.0), (0.0, 0.0, 3.0)).axes()


def test_no_blob_moves_where_the_order_has_no_say(spark):
    seen = projection.project(spark.createDataFrame(blobs(), SCHEMA), "xyz", "r", ["e"], CAMERA)
    plan = projection.picture(seen, ["e"], CAMERA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(ix" in plan
    assert projection.picture(seen.limit(0), ["e"], CAMERA).count() == 0
    assert projection.picture(seen.limit(0), ["e"], CAMERA, 0.1).count() == 0


def test_a_blob_over_the_whole_picture(spark):
    df = spark.createDataFrame([(k, 0.0, 0.0, 0.0, 50.0, 1000.0, 1.0, "") for k in range(3)], SCHEMA)
    got = projection.picture(projection.project(df, "xyz", "r", ["e"], CAMERA), ["e"], CAMERA)
    assert got.count() == 1200 and got.agg(F.min("e")).first()[0] > 0
