"""Both ways of a gather on odd meshes, the background of thinned tables, and positions between snapshots."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake import registry
from meshlake.model import ROW, Geometry, prefix_sums, with_row
from meshlake.operators import combine, grid, sample


@pytest.mark.parametrize("scheme", ["NGP", "CIC", "TSC"])
@pytest.mark.parametrize("periodic", [False, True])
def test_both_ways_of_a_gather_mean_the_same(spark, monkeypatch, scheme, periodic):
    """Duplicates of a cell, null, NaN and infinite cells, cells of no mesh, points on edges, outside and nowhere, a column of the result's name."""
    rng = np.random.default_rng(4)
    places = [*map(tuple, rng.uniform(-2, 7, (60, 3))), (0.0, 0.0, 0.0), (4.0, 4.0, 4.0), (0.5, 1.5, 2.5), (1.0, 1.0, 1.0), (-0.5, 4.5, 0.0), (math.inf, 0.0, 0.0), (0.0, math.nan, 0.0), (1e300, 0.0, 0.0), (0.0, -1e17, 0.0)]
    rows = [(k, *map(float, p), 99.0, "old") for k, p in enumerate(places)] + [(1000, None, 1.0, 1.0, 99.0, "old")]
    points = spark.createDataFrame(rows, f"{ROW} long, X double, Y double, Z double, Constant double, v string").repartition(3)
    mesh = [(k, float(k % 11)) for k in range(125) if k % 7] + [(3, 2.5), (3, 4.0), (31, None), (62, math.nan), (93, math.inf), (-1, 50.0), (125, 50.0), (10**12, 50.0), (None, 50.0)]
    cells = spark.createDataFrame(mesh, f"{ROW} long, f double")
    geometry = Geometry((5, 5, 5))
    for density in (True, False):
        near = grid.gather(points, "XYZ", cells, "f", geometry, scheme, density, periodic, name="v")
        with monkeypatch.context() as m:
            m.setattr(grid, "BROADCAST_CELLS", 0)
            far = grid.gather(points, "XYZ", cells, "f", geometry, scheme, density, periodic, name="v")
            far_rows = {r[ROW]: r.asDict() for r in far.collect()}
        near_rows = {r[ROW]: r.asDict() for r in near.collect()}
        assert near.columns == far.columns == points.columns and near_rows.keys() == far_rows.keys() == {r[0] for r in rows}
        assert np.allclose([near_rows[k]["v"] for k in near_rows], [far_rows[k]["v"] for k in near_rows], equal_nan=True)
        if scheme == "NGP" and not periodic:
            total = {}
            for k, v in mesh:
                if k is not None and 0 <= k < 125 and v is not None:
                    total[k] = total.get(k, 0.0) + v
            for k, *p in [r[:4] for r in rows]:
                i = [math.ceil(x - 0.5) if x is not None and abs(x) < 1e9 else -1 for x in p]
                cell = i[0] + 5 * (i[1] + 5 * i[2]) if all(0 <= x < 5 for x in i) else None
                assert near_rows[k]["v"] == pytest.approx(1e-7 + total.get(cell, 0.0), nan_ok=True)


def test_a_point_column_may_be_the_result(spark):
    points = spark.createDataFrame([(0, 1.0, 1.0, 1.0)], f"{ROW} long, X double, Y double, Z double")
    cells = spark.range(27).select(F.col("id").alias(ROW), F.lit(2.0).alias("f"))
    assert grid.gather(points, "XYZ", cells, "f", Geometry((3, 3, 3)), name="X").collect() == [(0, 2.0 + 1e-7, 1.0, 1.0)]


@pytest.mark.parametrize("n,step", [(90_000, 1), (100_000, 1), (300_000, 3), (250_000, 3)])
def test_background_of_thinned_tables(spark, n, step):
    df = spark.range(n).select(F.col("id").alias(ROW), *[(F.col("id") % 97 + 1000).cast("double").alias(c) for c in "XYZ"])
    got = sample.multi_resolution(df, "XYZ", (0.0, 0.0, 0.0), [(1.0, 1.0)])
    assert got.count() == -(-n // step)
    assert got.select(F.floor(F.col(ROW) / step)).distinct().count() == -(-n // step)
    assert sample.multi_resolution(df, "XYZ", (0.0, 0.0, 0.0), [(1.0, 1.0)], background=0.0).count() == 0


def test_times_and_ways_of_a_flat_universe():
    # in a universe of matter alone, nearly, t = 2 / 3 / H * a^1.5
    per_second = 100 * 0.7 * 1e5 / 3.085678e24
    assert combine.cosmic_time(0.5, 0.7, 1.0, 1e-9) == pytest.approx(2 / 3 / per_second * 0.5**1.5, rel=1e-6)
    # by steps of the expansion: dt = da / (a H(a))
    a = np.linspace(1e-6, 1.0, 2_000_001)
    rate = per_second * np.sqrt(0.3 / a**3 + 0.7)
    assert combine.cosmic_time(1.0) == pytest.approx(np.trapezoid(1 / (a * rate), a), rel=1e-4)
    assert combine.drift(0.5, 0.5) == 0.0
    assert combine.drift(0.4, 0.5) == pytest.approx((combine.cosmic_time(0.5) - combine.cosmic_time(0.4)) * 0.7 * 1e5 / 3.085678e21 / math.sqrt(0.4))


def test_positions_between_snapshots(spark):
    first = spark.createDataFrame([(0, 1.0, 2.0), (1, 9.5, 1.0), (2, 0.0, None), (3, 5.0, 1.0)], f"{ROW} long, x double, v double")
    second = spark.createDataFrame([(0, 4.0), (1, 0.5), (2, 1.0)], f"{ROW} long, x double")
    got = {(r["step"], r[ROW]): r["x"] for r in combine.snapshots_by_velocity(first, second, ["x"], ["v"], 4, 0.5, 10.0).collect()}
    assert {k[1] for k in got} == {0, 1, 2}  # the last has no partner
    for s in (1, 2, 3):
        t = s / 4
        # at 0 with the velocity's half, and at 1 where the second snapshot is
        assert got[s, 0] == pytest.approx(1 + 1.0 * t + 2.0 * t * t)
        assert got[s, 1] == pytest.approx(9.5 + 0.5 * t + 0.5 * t * t)  # 9.5 to 10.5 through the side of the box
        assert got[s, 2] is None


def test_running_sums_and_rows(spark):
    sizes = {k: k % 5 for k in range(1, 10_000) if k % 3}
    df = spark.createDataFrame(list(sizes.items()), "k long, n long")
    got = {r["k"]: r["before"] for r in prefix_sums(df, "k", "n").collect()}
    total = 0
    for k in sorted(sizes):
        assert got[k] == total
        total += sizes[k]
    rows = with_row(df.repartition(7), "n", "k").collect()
    assert [(r["n"], r["k"]) for r in sorted(rows, key=lambda r: r[ROW])] == sorted((n, k) for k, n in sizes.items())
    assert sorted(r[ROW] for r in rows) == list(range(len(sizes)))


def test_more_operators_by_name(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(8)], f"{ROW} long, v double")
    assert {r["part"] for r in registry.run("splittable_value", df, field="v", parts=2).collect()} == {0, 1}
    assert registry.run("splittable_volume", df, geometry=Geometry((2, 2, 2)), axis=3, parts=2).where("part = 1").count() == 4
    assert registry.run("smooth", df, field="v", geometry=Geometry((2, 2, 2)), amount="high").count() == 8
