from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.functions import scalar
from meshlake.model import ROW, Geometry
from meshlake.operators import columns, combine, grid, rows, sample, stats


def pts(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, *map(float, rng.uniform(1, 6, 3)), float(i % 5 + 1)) for i in range(n)], f"{ROW} long, X double, Y double, Z double, m double")


@pytest.mark.parametrize("scheme", ["NGP", "CIC", "TSC"])
@pytest.mark.parametrize("periodic", [False, True])
def test_scatter_keeps_the_sum_and_gather_a_constant(spark, scheme, periodic):
    df, geometry = pts(spark), Geometry((8, 8, 8))
    mesh, _ = grid.scatter(df, "XYZ", ["m"], scheme=scheme, geometry=geometry, periodic=periodic)
    assert mesh.count() == 512
    assert mesh.agg(F.sum("m")).first()[0] == pytest.approx(df.agg(F.sum("m")).first()[0])
    flat = spark.range(512).select(F.col("id").alias(ROW), F.lit(3.0).alias("f"))
    values = [r["v"] for r in grid.gather(df, "XYZ", flat, "f", geometry, scheme, density=True, periodic=periodic, name="v").collect()]
    assert values == pytest.approx([3.0 + 1e-7] * 200)


def test_points_at_edges(spark):
    df = spark.createDataFrame([(0, 0.5, 0.0, 0.0), (1, 0.5000001, 0.0, 0.0), (2, 3.6, 0.0, 0.0), (3, None, 0.0, 0.0)], f"{ROW} long, X double, Y double, Z double")
    cells = grid.touched(df, "XYZ", Geometry((4, 4, 4)), "NGP", False).select(ROW, "__cell").collect()
    assert sorted(map(tuple, cells)) == [(0, 0), (1, 1)]  # halves go down; outside and null are nowhere
    wrapped = grid.touched(df, "XYZ", Geometry((4, 4, 4)), "NGP", True).where(f"{ROW} = 2").select("__cell").collect()
    assert [r[0] for r in wrapped] == [0]


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(1000).select(F.col("id").alias(ROW), F.col("id").alias("v"))
    for percent, n in ((0, 0), (12.34, 123), (100, 950)):
        one, two = (sorted(r["v"] for r in sample.randomize(df, percent, 3).collect()) for _ in range(2))
        assert len(one) == n and one == two
    assert sample.randomize(df.limit(0), 50).count() == 0
    assert sample.visual_sample([(df, ["v"])], 10).columns == [ROW, "v_visual_1", "NONE", "NONE_2"]


def test_coarse_planes(spark):
    assert sample.coarse_resolution((100, 100, 100), 12.5) == (49, 49, 49)
    for n, r in ((8, 4), (10, 3), (9, 7), (7, 1), (12, 5)):
        gone = {int(n / (n - r + 1) * j) for j in range(1, n - r + 1)}
        df = spark.range(n**3).select(F.col("id").alias(ROW), F.col("id").alias("v"))
        out, geometry = sample.coarsen(df, Geometry((n, n, n)), (r, r, r))
        kept = [i for i in range(n) if i not in gone]
        expected = {(k + r * (j + r * i)): kept[k] + n * (kept[j] + n * kept[i]) for i in range(r) for j in range(r) for k in range(r)}
        assert geometry.n == (r, r, r) and {x[ROW]: x["v"] for x in out.collect()} == expected


def test_bad_parameters(spark):
    df = pts(spark, 10)
    with pytest.raises(ValueError):
        rows.select_rows(df, {"none": (0.0, 1.0)})
    with pytest.raises(ValueError):
        columns.add_id(df, "X")
    with pytest.raises(ValueError):
        combine.append([df, df.select(ROW, "X")])
    with pytest.raises(ValueError):
        rows.extract_subvolume(df, Geometry((2, 2, 2)), (1, 0, 0), (2, 1, 1))
    with pytest.raises(Exception, match="no row 99"):
        rows.extract_list(df, spark.createDataFrame([(1, 0, 99)], "list_id long, pos long, row_id long")).collect()


def test_nulls_nan_and_constants(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, float("nan")), (3, 3.0)], f"{ROW} long, v double")
    found = stats.statistic(df, ["v"]).first()
    assert (found["minimum"], found["maximum"], found["average"]) == (1.0, 3.0, 2.0)
    flat = spark.createDataFrame([(0, 2.0), (1, 2.0)], f"{ROW} long, v double")
    assert [r["v"] for r in stats.histogram(flat, ["v"], 3).orderBy("bin").collect()] == [2, 0, 0]
    assert combine.split_by_value(flat, "v", 3).select("part").distinct().collect()[0][0] == 0
    out = df.select(scalar.divide(F.col("v"), F.lit(0)), scalar.root(-F.col("v")), scalar.natural_log(F.lit(0.0)), scalar.arc_sine(F.lit(2.0))).first()
    assert list(out) == [None] * 4


def test_splits_are_whole(spark):
    df = pts(spark, 103)
    sizes = {r["part"]: r["count"] for r in combine.split_rows(df, 10).groupBy("part").count().collect()}
    assert sizes == {k: 11 if k < 3 else 10 for k in range(10)}


def test_parallel_tracks_have_no_midpoint(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 1.0, 0.0)], [f"c{k}" for k in range(12)])
    names = [f"c{k}" for k in range(12)]
    got = grid.closest_approach(df, names[:6], names[6:]).select("px", "py", "pz", "theta").collect()
    assert got[0]["px"] is None and got[0]["theta"] == 0.0
    assert tuple(got[1])[:3] == (0.0, 0.0, 1.0) and got[1]["theta"] == pytest.approx(np.pi / 2)
