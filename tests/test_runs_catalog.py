"""Runs in the background, and tables that are described."""

from __future__ import annotations

import os
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake import runs
from meshlake.model import ROW
from meshlake.operators import rows, stats
from meshlake.sources import binary, catalog, tables


@pytest.fixture()
def folder(spark, tmp_path):
    """Three files whose values rise, with missing ones, a column without any and one of NaN."""
    rng = np.random.default_rng(1)
    row = 0
    for k, n in enumerate((700, 30, 1270)):
        at = np.arange(row, row + n)
        a = at + rng.uniform(0, 5, n)
        a[::9] = binary.MISSING
        data = np.stack([a, np.sin(at / 50) * 10, np.full(n, binary.MISSING), np.full(n, np.nan)])
        data.astype("<f8").tofile(f"{tmp_path}/t/{k}.bin") if (tmp_path / "t").exists() or not (tmp_path / "t").mkdir() else None
        (tmp_path / "t" / f"{k}.bin.head").write_text(binary.Header("double", n, "little", ("a", "b", "none", "nan")).dumps())
        row += n
    return f"file://{tmp_path}/t"


def same(one, two):
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_statistics_without_a_scan(spark, folder):
    catalog.describe(spark, folder, 100)
    want = {r["column"]: r for r in stats.statistic(tables.read_tables(spark, folder), ["a", "b", "none", "nan"]).collect()}
    found = catalog.statistic(spark, folder)
    assert "meshtable" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        w = want[r["column"]]
        assert (r["minimum"], r["maximum"]) == (w["minimum"], w["maximum"]) and r["average"] == (w["average"] and pytest.approx(w["average"])) and r["total"] == (w["total"] and pytest.approx(w["total"]))
    assert catalog.statistic(spark, folder, ["b"]).count() == 1


@pytest.mark.parametrize("limits,operator", [({"a": (250.0, 330.0)}, "AND"), ({"a": (None, 120.0), "b": (0.0, None)}, "AND"), ({"a": (1900.0, None), "b": (9.9, 20.0)}, "OR"), ({"none": (0.0, 1.0)}, "AND"), ({"a": (5000.0, None)}, "AND"), ({"a": (None, None)}, "AND"), ({"nan": (None, 5.0), "x": (1, 2)}, "AND")])
def test_selections_equal_those_of_all_rows(spark, folder, limits, operator):
    catalog.describe(spark, folder, 64)
    got = catalog.select(spark, folder, limits, operator)
    same(got, rows.select_rows(tables.read_tables(spark, folder), limits, operator))
    same(catalog.select(spark, folder, limits, operator, ["b"]), got.select(ROW, "b"))


def test_other_ranges_are_not_read(spark, folder):
    catalog.describe(spark, folder, 100)
    df = tables.read_tables(spark, folder)
    want = rows.select_rows(df, {"a": (250.0, 330.0)}).select(ROW).collect()
    assert catalog._ranges(catalog._ends(spark, folder, ["a"]), (F.col("high_0") >= 250) & (F.col("low_0") <= 330)) == [(200, 399)]
    path, kept = folder.removeprefix("file://"), {}
    for k in (1, 2):
        # the other files lose their bytes but keep their sizes and times
        info = os.stat(f"{path}/{k}.bin")
        kept[k] = info
        with open(f"{path}/{k}.bin", "wb") as f:
            f.truncate(info.st_size)
        os.utime(f"{path}/{k}.bin", ns=(info.st_atime_ns, info.st_mtime_ns))
    assert catalog.select(spark, folder, {"a": (250.0, 330.0)}).select(ROW).collect() == want and len(want) > 50
    plan = catalog.select(spark, folder, {"a": (250.0, 330.0)})
    assert plan.rdd.getNumPartitions() == 1


@pytest.mark.parametrize("size", [{"radius": 30.0}, {"box": 12.0}, {"corner": 40.0}])
def test_extractions_equal_those_of_all_rows(spark, folder, size):
    catalog.describe(spark, folder, 50)
    center = {"a": 600.0, "b": 2.0}
    same(catalog.extract(spark, folder, center, **size), rows.extract(tables.read_tables(spark, folder), center, **size))


def test_a_table_that_has_changed(spark, folder):
    catalog.describe(spark, folder, 100)
    os.utime(folder.removeprefix("file://") + "/0.bin", (1, 1))
    for use in (lambda: catalog.statistic(spark, folder), lambda: catalog.select(spark, folder, {"a": (0.0, 1.0)})):
        with pytest.raises(ValueError, match="changed"):
            use()
    catalog.describe(spark, folder, 100)
    assert catalog.statistic(spark, folder).count() == 4
    with pytest.raises(ValueError):
        catalog.select(spark, folder, {"x": (0.0, 1.0)})


def slow(spark, seconds):
    """A job of one task for each core that takes so long."""

    def wait(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return lambda: spark.range(2, numPartitions=2).mapInArrow(wait, "id long").count()


def until(test, seconds=60):
    end = time.time() + seconds
    while not test() and time.time() < end:
        time.sleep(0.05)
    assert test()


def test_runs_end_well_or_badly(spark):
    with runs.Runs(spark) as all_runs:
        good = all_runs.start(lambda: spark.range(10).count(), "good")
        bad = all_runs.start(lambda: spark.range(10).selectExpr("raise_error('no')").collect(), "bad")
        assert good.result(60) == 10 and good.state == "done" and good.error is None
        with pytest.raises(Exception, match="no"):
            bad.result(60)
        assert bad.state == "failed" and "no" in str(bad.error)
        assert all_runs.states() == {"done": ["good"], "failed": ["bad"]}
        good.interrupt()
        assert good.state == "done"


def test_one_run_is_interrupted_and_no_other(spark):
    with runs.Runs(spark) as all_runs:
        stopped = all_runs.start(slow(spark, 120), "stopped")
        other = all_runs.start(slow(spark, 4), "other")
        until(lambda: spark.sparkContext.statusTracker().getActiveStageIds())
        with pytest.raises(TimeoutError):
            stopped.result(0.1)
        time.sleep(1)
        stopped.interrupt()
        with pytest.raises(runs.Interrupted):
            stopped.result(60)
        assert stopped.state == "interrupted" and isinstance(stopped.error, runs.Interrupted)
        assert other.result(90) == 2 and other.state == "done"


def test_runs_wait_for_their_turn(spark):
    gate, begun = threading.Event(), threading.Event()

    def held():
        begun.set()
        gate.wait(60)
        return spark.range(3).count()

    with runs.Runs(spark, 1) as all_runs:
        first = all_runs.start(held, "first")
        begun.wait(60)
        second, third = all_runs.start(lambda: 2, "second"), all_runs.start(lambda: 3, "third")
        assert (first.state, second.state) == ("running", "waiting")
        second.interrupt()
        gate.set()
        assert first.result(60) == 3 and third.result(60) == 3
        assert second.state == "interrupted"
        with pytest.raises(runs.Interrupted):
            second.result(1)
        all_runs.interrupt()
        assert third.state == "done"


def test_a_parameter_file_in_the_background(spark, tmp_path):
    tables.write_table(spark.range(50).select(F.col("id").alias(ROW), F.col("id").alias("v")), f"file://{tmp_path}/t.bin")
    (tmp_path / "run.par").write_text("op=decimator\nskip=4\nout=d.bin\nfile=t.bin\n")
    (tmp_path / "bad.par").write_text("op=decimator\nskip=4\nfile=none.bin\n")
    with runs.Runs(spark) as all_runs:
        good, bad = (all_runs.start_flow(f"file://{tmp_path}/{x}.par") for x in ("run", "bad"))
        assert good.result(60).count() == 10 and (tmp_path / "d.bin").exists()
        with pytest.raises(Exception, match="no tables"):
            bad.result(60)
