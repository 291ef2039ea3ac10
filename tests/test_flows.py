"""Parameter files: every operator by the names that its section of a file has, against the operator itself."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake import flows
from meshlake.model import ROW, Geometry
from meshlake.operators import columns, combine, grid, rows, sample, stats
from meshlake.sources import binary, multilist, tables

N = 300


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("flows")
    rng = np.random.default_rng(0)
    data = [(k, *map(float, rng.uniform(0, 8, 3)), float(k % 5), float(k % 3) / 2) for k in range(N)]
    df = spark.createDataFrame(data, f"{ROW} long, X double, Y double, Z double, Mass double, Id double")
    tables.write_table(df, f"file://{top}/points.bin", "double")
    tables.write_table(df.where(F.col(ROW) < 200).withColumn("X", F.col("X") + 1), f"file://{top}/later.bin", "double")
    cells = spark.range(6 * 5 * 4).select(F.col("id").alias(ROW), (F.col("id") * 7 % 13).cast("double").alias("v"))
    tables.write_table(cells, f"file://{top}/box.bin", "double", geometry=Geometry((6, 5, 4)))
    files = {
        "limits.txt": "X 2.0 6.0\nY unlimited 5\nother 1 2\nZ\n", "box-limits.txt": "v 3 unlimited\n", "geometry.txt": "X 4\nY 4.0\nZ 4\nRADIUS 2.5\n", "box.txt": "X 1\nBOX 2.0\nY 2\nZ 3\n",
        "bad.txt": "X 1\nY 2\nRADIUS 1\n", "merge.txt": "points.bin X\npoints Y\nlater.bin *\n", "append.txt": "points.bin\nlater\n", "layers.txt": "2.0 1.0\n4.0 0.5\n", "math.txt": "X * Y + 1\n",
        "lists.txt": "3\n2\n5 5\n0\n3\n299 0 7\n", "particles.txt": "2\n3\n10\n11\n12\n1\n20\n", "ahf.txt": "box 8.0\nscale 0.5\n",
    }
    for name, content in files.items():
        (top / name).write_text(content)
    return top


@pytest.fixture()
def run(spark, folder):
    def go(content):
        (folder / "run.par").write_text("# a section\n\n" + content)
        return flows.run_flow(spark, f"file://{folder}/run.par")

    return go


@pytest.fixture(scope="module")
def points(spark, folder):
    return tables.read_tables(spark, f"file://{folder}/points.bin").cache()


@pytest.fixture(scope="module")
def later(spark, folder):
    return tables.read_tables(spark, f"file://{folder}/later.bin").cache()


@pytest.fixture(scope="module")
def box(spark, folder):
    return tables.read_tables(spark, f"file://{folder}/box.bin").cache()


def listed(df, kept=True):
    """Rows in order; results are written as floats."""
    rows_ = sorted([tuple(r) for r in df.collect()])
    return [tuple(None if x is None else float(np.float32(x)) for x in (r if kept else r[1:])) for r in rows_]


XYZ = ["X", "Y", "Z"]
CUBE = Geometry((6, 5, 4))
SECTIONS = {
    "addId": ("op=addId\noutcol=Number\nstart=5\nfile=points.bin", lambda p, t, b: columns.add_id(p, "Number", 5)),
    "append": ("op=append\nout=o.bin\nfile=append.txt", lambda p, t, b: combine.append([p, t])),
    "cartesian2polar": ("op=cartesian2polar\nfield=X Y Z\nappend=true\noutcol=a b c\nout=o.bin\nfile=points.bin", lambda p, t, b: columns.cartesian_to_polar(p, XYZ, ("a", "b", "c"))),
    "changecolname": ("op=changecolname\nfield=X Y\nnewnames=A B\nout=o.bin\nfile=points.bin", lambda p, t, b: columns.rename_columns(p, ["X", "Y"], ["A", "B"])),
    "coarsevolume": ("op=coarsevolume\nnewres=3 3 2\nfield=v\nout=o.bin\nfile=box.bin", lambda p, t, b: sample.coarsen(b, CUBE, (3, 3, 2))[0]),
    "cut": ("op=cut\nfield=X Z\nlimits=limits.txt\nthreshold=-1\noperator=OR\nout=o.bin\nfile=points.bin", lambda p, t, b: columns.cut(p, {"X": (2.0, 6.0), "Y": (None, 5.0)}, ["X", "Z"], -1.0, "OR")),
    "extractsubvolume": ("op=extractsubvolume\nstartingcell=1 1 1\nresolution=2 3 2\nout=o.bin\nfile=box.bin", lambda p, t, b: rows.extract_subvolume(b, CUBE, (1, 1, 1), (2, 3, 2))[0]),
    "grid2point": ("op=grid2point\npoints=X Y Z\nfield=v\nappend=true\noutcol=g\nvolume=box.bin\ngridOrigin=0 0 0\ngridSpacing=1.5 1.5 2\nout=o.bin\nfile=points.bin", lambda p, t, b: grid.gather(p, XYZ, b, "v", Geometry((6, 5, 4), (1.5, 1.5, 2.0)), name="g")),
    "include": ("op=include\nradius=3\ncenter=4 4 4\nfield=X Y Z\noutcol=near\nout=o.bin\nfile=points.bin", lambda p, t, b: columns.include(p, 3.0, (4.0, 4.0, 4.0), XYZ, name="near").select(ROW, "near")),
    "mathop": ("op=mathop\nexpression=math.txt\noutcol=m\nappend=true\nout=o.bin\nfile=points.bin", lambda p, t, b: columns.math_column(p, "X * Y + 1", "m")),
    "mathop_compute": ("op=mathop\ncompute=(X*Y)/Z\noutcol=m\nfile=points.bin", lambda p, t, b: columns.math_column(p, "(X*Y)/Z", "m").select(ROW, "m")),
    "merge": ("op=merge\nsize=HUGE\npad=-7\nout=o.bin\nfile=merge.txt", lambda p, t, b: combine.merge([(p, ["X", "Y"]), (t, ["X", "Y", "Z", "Mass", "Id"])], "HUGE", -7.0)),
    "module": ("op=module\nfield=X Y Z\nout=o.bin\nfile=points.bin", lambda p, t, b: columns.module(p, XYZ).select(ROW, "ModuleOp")),
    "pointdistribute": ("op=pointdistribute\nresolution=4 4 4\npoints=X Y Z\nfield=Mass\ntsc=true\nnodensity=true\nbox=8\ngridOrigin=0 0 0\nperiodic=true\nout=o.bin\nfile=points.bin", lambda p, t, b: grid.scatter(p, XYZ, ["Mass"], (4, 4, 4), "TSC", Geometry((4, 4, 4), (2.0, 2.0, 2.0)), True, False)[0]),
    "pointproperty": ("op=pointproperty\nresolution=4 4 4\npoints=X Y Z\nappend=true\noutcol=d\nout=o.bin\nfile=points.bin", lambda p, t, b: grid.point_property(p, XYZ, None, (4, 4, 4), name="d")),
    "selcolumns": ("op=selcolumns\nlist=X Z\nextract=true\nout=o.bin\nfile=points.bin", lambda p, t, b: p.select(ROW, "X", "Z")),
    "selcolumns_delete": ("op=selcolumns\nfield=X Z\ndelete=true\nout=o.bin\nfile=points.bin", lambda p, t, b: p.select(ROW, "Y", "Mass", "Id")),
    "selvol": ("op=selvol\nlimits=box-limits.txt\noperator=AND\nout=o.bin\nfile=box.bin", lambda p, t, b: rows.select_volume(b, {"v": (3.0, None)})),
    "swap": ("op=swap\nout=swapped.bin\nfile=points.bin", lambda p, t, b: p),
}


@pytest.mark.parametrize("name", SECTIONS)
def test_sections_as_they_are(run, points, later, box, name):
    content, want = SECTIONS[name]
    got = run(content)
    assert listed(got) == listed(want(points, later, box).select(*got.columns))


NEW_ROWS = {
    "selfield": ("op=selfield\nlimits=limits.txt\noperator=AND\nout=o.bin\nfile=points.bin", lambda p: rows.select_rows(p, {"X": (2.0, 6.0), "Y": (None, 5.0)})),
    "extraction": ("op=extraction\ngeometry=geometry.txt\nout=o.bin\nfile=points.bin", lambda p: rows.extract(p, {"X": 4.0, "Y": 4.0, "Z": 4.0}, radius=2.5)),
    "extraction_box": ("op=extraction\ngeometry=box.txt\nfile=points.bin", lambda p: rows.extract(p, {"X": 1.0, "Y": 2.0, "Z": 3.0}, box=2.0)),
    "decimator": ("op=decimator\nskip=9\nout=o.bin\nfile=points.bin", lambda p: sample.decimate(p, 9)),
    "randomizer": ("op=randomizer\nperc=10\nlist=X Y Z\niseed=3\nout=o.bin\nfile=points.bin", lambda p: sample.randomize(p.select(ROW, *XYZ), 10.0, 3)),
    "sigmacontours": ("op=sigmacontours\nnsigma=1.2\nfield=X Y\nallcolumns=true\nout=o.bin\nfile=points.bin", lambda p: rows.sigma_contours(p, ["X", "Y"], 1.2, all_columns=True)),
    "mres": ("op=mres\npoints=X Y Z\npos=4 4 4\ngeometry=layers.txt\nbackground=0.1\nout=o.bin\nfile=points.bin", lambda p: sample.multi_resolution(p, XYZ, (4.0, 4.0, 4.0), [(2.0, 1.0), (4.0, 0.5)], 0.1)),
}


@pytest.mark.parametrize("name", NEW_ROWS)
def test_rows_are_counted_anew(run, points, folder, name):
    content, want = NEW_ROWS[name]
    got = run(content)
    kept = listed(got)
    assert [r[0] for r in kept] == list(map(float, range(len(kept)))) and 0 < len(kept) < N
    assert listed(got, False) == listed(want(points).select(*got.columns), False)


def test_one_file_and_header(run, folder):
    run("op=pointdistribute\nresolution=4 3 2\npoints=X Y Z\nout=mesh.bin\nfile=points.bin\nhelp=false")
    assert {"mesh.bin", "mesh.bin.head"} <= set(os.listdir(folder)) and binary.read_header(f"file://{folder}/mesh.bin.head").geometry.n == (4, 3, 2)
    assert os.path.getsize(folder / "mesh.bin") == 4 * 24


def test_lists(spark, run, points, folder):
    got = listed(run("op=extractlist\nmultilist=lists.txt\nasciilist=true\nout=o.bin\nfile=points.bin"))
    by_row = {r[0]: r[1:] for r in listed(points)}
    assert [r[1:] for r in got] == [by_row[k] for k in (5, 5, 299, 0, 7)]
    np.array([4, 9, 2], "<i4").tofile(folder / "one.lst")
    assert [r[1:] for r in listed(run("op=extractlist\nmultilist=one.lst\nbinaryint=true\nonelist=true\nfile=points.bin"))] == [by_row[k] for k in (4, 9, 2)]
    assert [r[1:] for r in listed(run("op=extractlist\nmultilist=one.lst\nbinaryint=true\nnumberlists=1\nlistelements=3\nfile=points.bin"))] == [by_row[k] for k in (4, 9, 2)]
    spark.createDataFrame([(0, 2.0), (1, 9.0), (2, -1.0)], f"{ROW} long, Id double").createOrReplaceTempView("ids")
    tables.write_table(spark.table("ids"), f"file://{folder}/ids.bin", overwrite=True)
    run("op=ahfhalolist\nmultilist=particles.txt\nout=halos.lst\nfile=ids.bin")
    assert sorted(map(tuple, multilist.read_multilist(spark, f"file://{folder}/halos.lst", "ascii").collect())) == [(1, 0, 20)]
    routes = spark.createDataFrame([(0, 0.0, 3.0), (1, 2.0, 0.0)], f"{ROW} long, a double, b double")
    tables.write_table(routes, f"file://{folder}/routes.bin", overwrite=True)
    run("op=ahfhalogalaxyext\nfield= a b\nmultilist=particles.txt\nthreshold=1.0\nout=routed\nfile=routes.bin")
    for name, want in (("a", [(1, 0, 20)]), ("b", [(1, 0, 10), (1, 1, 11), (1, 2, 12)])):
        assert sorted(map(tuple, multilist.read_multilist(spark, f"file://{folder}/routed_{name}_particles", "ascii").collect())) == want


def test_several_tables(run, points, later):
    made = run("op=interpolate\nlist=X Y\nnumbin=4\ninterval=0.0 1.0\nout=step.bin\ninfiles=points.bin later.bin")
    want = combine.snapshots(points, later, ["X", "Y"], 4)
    assert [listed(m) for m in made] == [listed(want.where(F.col("step") == k).drop("step")) for k in (1, 2, 3)]
    parts = run("op=splittable\nnumoftables=3\nout=part.bin\nfile=points.bin")
    assert [m.count() for m in parts] == [100, 100, 100]
    slabs = run("op=splittable\nvolumesplit=1\nnumoftables=2\nfile=box.bin")
    assert [m.count() for m in slabs] == [60, 60]
    assert sum(m.count() for m in run("op=splittable\nfield=X\nnumoftables=4\nfile=points.bin")) == N


def test_reports(spark, run, points, box, folder):
    found, counts = run("op=statistic\nlist=X Mass\nhistogram=7\nrange=0 6\nout=result.txt\nfile=points.bin")
    assert listed(found.drop("column")) == listed(stats.statistic(points, ["X", "Mass"], (0.0, 6.0)).drop("column"))
    lines = [r["value"].split() for r in spark.read.text(f"file://{folder}/result.txt").collect()]
    assert len(lines) == 7 and sum(int(x[2]) for x in lines) == N
    shown = run("op=showtable\nfield=X Y\nrangerows=10 14\nwidth=9\nprecision=2\nout=shown.txt\nfile=points.bin")
    assert [r[ROW] for r in shown.collect()] == [10, 11, 12, 13, 14] and spark.read.text(f"file://{folder}/shown.txt").count() == 5
    cells = run("op=showvol\nfield=v\nlimits=box-limits.txt\noperator=AND\nnumcells=5\nfile=box.bin").collect()
    assert len(cells) == 5 and all(r["v"] >= 3 and r["X"] >= 1 for r in cells)
    run("op=wrvotable\nfield=X Y\nforce=true\nout=t.xml\nfile=points.bin")
    assert spark.read.text(f"file://{folder}/t.xml").count() == N + 2
    run("op=vbt2ahf\nfield=X Y Z X Y Z\npar=ahf.txt\nout=ahf\nfile=points.bin")
    assert sum(os.path.getsize(folder / "ahf" / x) for x in os.listdir(folder / "ahf") if not x.startswith(".")) == N * 24
    seen = run("op=visualop\nsize=50\nfile=merge.txt")
    assert seen.count() <= 50 and len(seen.columns) == 8


@pytest.mark.parametrize("content", [
    "op=nothing", "file=points.bin", "op=selfield\nfile=points.bin", "op=selfield\nlimits=limits.txt\nfile=points.bin\nsomething=1", "op=extraction\ngeometry=bad.txt\nfile=points.bin",
    "op=coarsevolume\nfile=points.bin", "op=merge\nfile=limits.txt", "op=selfield\nlimits=none.txt\nfile=points.bin", "op=ahfhalogalaxyext\nfield=a b c\nmultilist=none\nfile=points.bin",
])
def test_files_that_say_too_little(run, content):
    with pytest.raises(Exception):
        run(content)
