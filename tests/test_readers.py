from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake import registry
from meshlake.functions import scalar
from meshlake.model import ROW, Geometry, declared
from meshlake.operators import combine, grid, rows, stats
from meshlake.plans import tables
from meshlake.sources import binary, fields, fits, raw, snapshots, text

SMALL = "/root/testdata/sf0.001"


def uri(path) -> str:
    return f"file://{path}"


def test_text_is_no_number(spark, tmp_path):
    lines = ["a b", "1 2", "a b", "NaN inf", "1d 0x1", "+.5 -2.e3", "1..2 --1", "3"]
    (tmp_path / "t.txt").write_text("\n".join(lines) + "\n")
    got = [tuple(r) for r in text.read_ascii(spark, uri(tmp_path / "t.txt")).collect()]
    assert got == [(1, 2), (None, None), (None, None), (None, None), (0.5, -2000), (None, None), (3, None)]
    (tmp_path / "t.csv").write_text("x,y\nNaN,1\n1e2,Infinity\n")
    assert [tuple(r) for r in text.read_csv(spark, uri(tmp_path / "t.csv")).collect()] == [(None, 1), (100, None)]


def test_row_lists_of_all_kinds(spark, tmp_path):
    chosen = spark.range(0, 5000, 7).withColumnRenamed("id", ROW).repartition(3)
    for kind in ("u8", "i4", "ascii"):
        made = sorted(map(tuple, binary.write_rows(chosen, uri(tmp_path / kind), kind).collect()))
        got = [r["row_id"] for f, _ in made for r in binary.read_rows(spark, f, kind).orderBy("pos").collect()]
        assert got == list(range(0, 5000, 7))


def test_parts_of_volumes_and_types(spark, tmp_path):
    df = spark.range(3 * 4 * 5).select(F.col("id").alias(ROW), F.when(F.col("id") != 7, F.col("id") * 1.5).alias("v"))
    for kind in ("float", "double", "ld", "int", "lli"):
        made = binary.write_parts(df, uri(tmp_path / kind), "big", geometry=Geometry((3, 4, 5)), rows_per_file=25, kind=kind).collect()
        assert sorted(r["n_rows"] for r in made) == [12, 24, 24]
        for r in made:
            frame, head = binary.read_table(spark, r["uri"])
            assert head.geometry.n == (3, 4, r["n_rows"] // 12)
            for x in frame.collect():
                at = x[ROW] + r["first_row"]
                assert x["v"] == (None if at == 7 and kind in ("float", "double", "ld") else x["v"] if at == 7 else at * 1.5 if kind in ("float", "double", "ld") else int(at * 1.5))


def test_declared_volumes():
    assert declared(27).n == (3, 3, 3) and declared(1000).n == (10, 10, 10) and declared(28) is None
    assert declared(24, (2, 3, 4), (1.0, 2.0, 3.0)).size == (1.0, 2.0, 3.0) and declared(25, (2, 3, 4)) is None and declared(0) is None


def test_fields_in_records(spark, tmp_path):
    data = np.zeros(1000, np.dtype([("a", ">i2"), ("b", "<f4"), ("flag", "S1")]))
    data["a"], data["b"], data["flag"] = np.arange(1000), np.arange(1000) / 4, np.where(np.arange(1000) % 3, b"T", b"x")
    data["b"][5] = np.nan
    (tmp_path / "d").write_bytes(b"head" + data.tobytes())
    size = data.dtype.itemsize
    own = [fields.Field("a", 4, size, ">i2", 9, 2.0, 1.0), fields.Field("b", 6, size, "<f4"), fields.Field("flag", 10, size, "bool"), fields.Field("none", 0, 0, None)]
    for n_bytes in (100, 1 << 24):
        fields.READ_BYTES = n_bytes
        got = fields.read_fields(spark, uri(tmp_path / "d"), 1000, own, 10).orderBy(ROW).collect()
        assert [r[ROW] for r in got] == list(range(10, 1010)) and got[9]["a"] is None and got[8]["a"] == 17 and got[5]["b"] is None and got[6]["b"] == 1.5
        assert got[0]["flag"] is None and got[1]["flag"] == 1 and got[0]["none"] is None
    with pytest.raises(Exception, match="shorter"):
        fields.read_fields(spark, uri(tmp_path / "d"), 1001, own).collect()
    assert fields.read_fields(spark, uri(tmp_path / "d"), 0, own).count() == 0


def test_files_of_other_kinds_are_errors(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"nothing of the kind " * 400)
    for read in (snapshots.read_snapshot, raw.read_points, raw.read_grids, snapshots.read_triples, fits.read_fits_table):
        with pytest.raises(ValueError):
            read(spark, uri(tmp_path / "x"))
    with pytest.raises(ValueError):
        snapshots.read_mesh_particles(spark, uri(tmp_path))


def test_fits_integer_image_and_complex_columns(spark, tmp_path):
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(80)
    head = lambda cards: ("".join(cards) + "END".ljust(80)).ljust(2880).encode()
    image = np.arange(24, dtype=">i2").reshape(2, 3, 4)
    body = image.tobytes().ljust(2880, b"\0")
    first = head([card("SIMPLE", "T"), card("BITPIX", 16), card("NAXIS", 3), card("NAXIS1", 4), card("NAXIS2", 3), card("NAXIS3", 2), card("BLANK", 5), card("BZERO", "1.0D1")])
    table = np.zeros(3, np.dtype([("c", ">c8"), ("v", ">i4", 2)]))
    table["c"], table["v"] = [1 + 2j, 3 + 4j, 5j], [[1, 2], [3, 4], [5, 6]]
    second = head([card("XTENSION", "'BINTABLE'"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 16), card("NAXIS2", 3), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", 2), card("TFORM1", "'1C      '"), card("TTYPE1", "'c       '"), card("TFORM2", "'2J      '")])
    (tmp_path / "f.fits").write_bytes(first + body + second + table.tobytes().ljust(2880, b"\0"))
    planes, geometry = fits.read_fits_image(spark, uri(tmp_path / "f.fits"))
    assert geometry.n == (4, 3, 1) and planes.columns == [ROW, "f_0", "f_1"]
    assert [(r["f_0"], r["f_1"]) for r in planes.orderBy(ROW).collect()] == [(None if k == 5 else k + 10, k + 22) for k in range(12)]
    cube, geometry = fits.read_fits_image(spark, uri(tmp_path / "f.fits"), volume=True)
    assert geometry.n == (4, 3, 2) and cube.count() == 24
    got = fits.read_fits_table(spark, uri(tmp_path / "f.fits")).orderBy(ROW).collect()
    assert [tuple(r) for r in got] == [(0, 1, 2, 1, 2), (1, 3, 4, 3, 4), (2, 0, 5, 5, 6)]


def test_gather_moves_no_row(spark):
    p = tables.points(spark, SMALL)
    mesh, geometry = grid.scatter(p, "XYZ", resolution=(8, 8, 8), sparse=True)
    for scheme in ("NGP", "CIC", "TSC"):
        for periodic in (False, True):
            near = grid.gather(p, "XYZ", mesh, "Constant", geometry, scheme, periodic=periodic)
            assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
            grid.BROADCAST_CELLS, kept = 0, grid.BROADCAST_CELLS
            far = grid.gather(p, "XYZ", mesh, "Constant", geometry, scheme, periodic=periodic)
            a, b = ({r[ROW]: r["__Grid2Point_"] for r in x.collect()} for x in (near, far))
            grid.BROADCAST_CELLS = kept
            assert a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a])
    odd = spark.createDataFrame([(0, None, 0.0, 0.0), (1, float("nan"), 0.0, 0.0), (2, 1e9, 0.0, 0.0)], f"{ROW} long, X double, Y double, Z double")
    assert [r["v"] for r in grid.gather(odd, "XYZ", mesh, "Constant", geometry, name="v").collect()] == [1e-7] * 3


def test_operators_by_name(spark):
    p = tables.points(spark, SMALL)
    assert registry.run("decimator", p, skip=1).count() == p.count() // 2
    with pytest.raises(ValueError):
        registry.run("none", p)
    with pytest.raises(ValueError):
        registry.run("decimator", p, other=1)
    assert registry.parameters("# a\n\n op = cut \nlimits=a=b\n") == {"op": "cut", "limits": "a=b"}
    assert registry.converted("X Y 3 0.5") == ["X", "Y", 3, 0.5] and registry.converted("true") is True and registry.converted("a.b") == "a.b"
    with pytest.raises(ValueError):
        registry.parameters("nothing")


def test_sizes_of_splits():
    assert combine.split_count(1 << 20, 4, 8.0) == 2 and combine.split_count(10, 1, 8.0) == 1
    with pytest.raises(ValueError):
        combine.split_count(1 << 30, 4, 8.0)
    assert combine.split_count(1 << 30, 4, 8.0, huge=True) == 2048
    with pytest.raises(ValueError):
        combine.split_count(1, 1, 0.0)


def test_hyperbolic_domains_and_clamps(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 2.0), (2, None)], f"{ROW} long, x double").withColumn("t", F.lit(1))
    got = df.select(scalar.hyperbolic_arc_cosine(F.col("x")), scalar.hyperbolic_arc_tangent(F.col("x"))).collect()
    assert got[0][0] is None and got[1][1] is None and got[2][0] is None and got[1][0] == pytest.approx(1.3169578969)
    assert [r["x"] for r in stats.normalize(df, ["x"], "t", low=1.0, high=1.5).orderBy(ROW).collect()] == [0.0, 1.0, None]
    assert rows.row_ids(df, {"x": (None, 1.0)}).count() == 1
