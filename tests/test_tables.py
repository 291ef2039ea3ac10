"""Binary tables as a data source: one scan of many files, ranges of rows, one file from many tasks."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual
from pyspark.sql.types import LongType, StructType

from meshlake.model import ROW, Geometry
from meshlake.sources import binary, tables


def made(folder, sizes, kinds=("float", "double", "int"), orders=("little", "big")):
    """Files of these sizes, of several types, whose values follow from the row in the whole."""
    row = 0
    for k, n in enumerate(sizes):
        head = binary.Header(kinds[k % len(kinds)], n, orders[k % len(orders)], ("a", "b", "c"))
        data = np.stack([np.arange(row, row + n) * (j + 1) for j in range(3)]).astype(head.dtype)
        data.tofile(f"{folder}/t{k:05d}.bin")
        with open(f"{folder}/t{k:05d}.bin.head", "w") as f:
            f.write(head.dumps())
        row += n
    return f"file://{folder}"


def test_many_files_are_one_scan(spark, tmp_path):
    folder = made(tmp_path, [3, 0, 50, 1, 7] * 40)
    df = tables.read_tables(spark, folder, rows_per_task=100)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan
    assert df.rdd.getNumPartitions() == 25  # 2440 rows
    got = [tuple(r) for r in df.orderBy(ROW).collect()]
    assert got == [(k, float(k), 2.0 * k, 3.0 * k) for k in range(2440)]
    assert df.columns == [ROW, "a", "b", "c"]
    assert tables.read_tables(spark, folder + "/t0000[0-2].bin").count() == 53
    assert tables.read_tables(spark, folder + "/t00002.bin").agg(F.min("a")).first()[0] == 3.0


def test_a_large_file_is_many_shares(tmp_path):
    files = tables.parts_of(tables.table_files(made(tmp_path, [1000, 30])))
    found = tables.shares(files, [(0, 1 << 62)], 300)
    assert [[(p.first, p.n, p.row) for p in x] for x in found] == [[(0, 300, 0)], [(300, 300, 300)], [(600, 300, 600)], [(900, 100, 900), (0, 30, 1000)]]
    assert [[(p.first, p.n, p.row) for p in x] for x in tables.shares(files, [(998, 1001)], 300)] == [[(998, 2, 998), (0, 2, 1000)]]
    assert tables.shares(files, [(5000, 6000)], 300) == [] and tables.shares(files, [(5, 4)], 300) == []
    assert [[(p.row, p.n) for p in x] for x in tables.shares(files, [(0, 9), (100, 100), (995, 1010)], 20)] == [[(0, 10), (100, 1), (995, 5), (1000, 4)], [(1004, 7)]]
    assert tables.ranges_of(":5,7:7,9:") == [(0, 5), (7, 7), (9, 1 << 62)] and tables.ranges_of("") == []
    with pytest.raises(ValueError):
        tables.ranges_of("5:9,9:10")


def test_only_wanted_columns_and_rows_are_read(spark, tmp_path):
    """All else is missing from the disk."""
    head = binary.Header("double", 1000, "little", ("a", "b", "c"))
    np.arange(1000.0).tofile(f"{tmp_path}/t.bin")  # the first column alone
    (tmp_path / "t.bin.head").write_text(head.dumps())
    path = f"file://{tmp_path}/t.bin"
    assert tables.read_tables(spark, path, ["a"]).count() == 1000
    with pytest.raises(Exception, match="shorter"):
        tables.read_tables(spark, path, ["b"]).collect()
    np.arange(300.0).tofile(f"{tmp_path}/t.bin")
    assert [r["a"] for r in tables.read_tables(spark, path, ["a"], (100, 299)).orderBy(ROW).collect()] == [float(k) for k in range(100, 300)]
    with pytest.raises(Exception, match="shorter"):
        tables.read_tables(spark, path, ["a"], (100, 300)).collect()
    with pytest.raises(Exception, match="no column"):
        tables.read_tables(spark, path, ["x"]).collect()


def test_bounds_of_rows_are_pushed_down(spark, tmp_path):
    folder = made(tmp_path, [100] * 10)
    reader = tables.PushingReader(folder, StructType().add(ROW, LongType()), [(0, 1 << 62)], 50)
    other = [IsNotNull((ROW,)), EqualTo(("a",), 5), In((ROW,), [130, 700, 240])]
    assert list(reader.pushFilters([GreaterThan((ROW,), 120), LessThanOrEqual((ROW,), 333), *other])) == other
    assert [(p.row, p.n) for x in reader.partitions() for p in x.parts] == [(130, 50), (180, 20), (200, 30), (230, 50), (280, 20), (300, 30), (330, 4)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        os.truncate(tmp_path / "t00009.bin", 0)  # read by no query below
        df = tables.read_tables(spark, folder)
        assert df.where(f"{ROW} >= 250 and {ROW} < 252").select("a").orderBy("a").collect() == [(250.0,), (251.0,)]
        assert df.where(f"{ROW} = 899 and a = 899").count() == 1 and df.where(f"{ROW} in (5, 6) and {ROW} > 5").count() == 1
        assert df.where(f"{ROW} > 5 and {ROW} < 5").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_tables_that_do_not_fit_together(spark, tmp_path):
    folder = made(tmp_path, [5, 5])
    (tmp_path / "t00001.bin.head").write_text(binary.Header("int", 5, "little", ("a", "b")).dumps())
    with pytest.raises(Exception, match="other columns"):
        tables.read_tables(spark, folder).collect()
    with pytest.raises(Exception, match="no tables"):
        tables.read_tables(spark, f"file://{tmp_path}/none").collect()


@pytest.mark.parametrize("kind,order", [("float", "little"), ("double", "big"), ("long", "little")])
def test_one_file_from_many_tasks(spark, tmp_path, kind, order):
    n = 20_000
    missing = F.lit(0.0 if kind == "long" else None).cast("double")  # whole numbers have no mark for it
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias(ROW)).withColumn("a", F.col(ROW) * 2).withColumn("b", F.when(F.col(ROW) % 3 > 0, F.col(ROW) + 0.5).otherwise(missing)).repartition(200)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert tables.write_table(df, f"file://{tmp_path}/t.bin", kind, order) == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(os.listdir(tmp_path)) == ["t.bin", "t.bin.head"]
    head = binary.read_header(f"file://{tmp_path}/t.bin.head")
    assert (head.kind, head.n_rows, head.order, head.names) == (kind, n, order, ("a", "b"))
    data = np.fromfile(tmp_path / "t.bin", head.dtype).reshape(2, n)
    want = np.arange(n) * 2, np.where(np.arange(n) % 3 > 0, np.arange(n) + 0.5, binary.MISSING if kind != "long" else 0)
    assert all((x == y.astype(head.dtype)).all() for x, y in zip(data, want))
    if kind != "long":
        back = tables.read_tables(spark, f"file://{tmp_path}")
        assert back.where("b is null").count() == -(-n // 3) and back.agg(F.sum("a")).first()[0] == float((np.arange(n) * 2).astype(head.dtype).astype(float).sum())


def test_a_task_that_fails_changes_nothing(spark, tmp_path):
    """The same bytes after attempts that died half way, here the attempts of a writer by hand."""
    schema = StructType().add(ROW, LongType()).add("a", LongType())
    header = binary.Header("double", 6, "little", ("a",))
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_pydict({ROW: pa.array(rows, pa.int64()), "a": pa.array([10 * x for x in rows], pa.int64())})

    def broken():
        yield batch([0, 1])
        raise RuntimeError("lost")

    for order in ([[0, 1, 2], [3, 4, 5]], [[5, 4, 3], [2, 0, 1]]):
        writer = tables.TableWriter(f"file://{tmp_path}/t.bin", schema.names, header, True)
        with pytest.raises(RuntimeError):
            writer.write(broken())
        assert not (tmp_path / "t.bin").exists() or order[0][0] == 5
        writer.commit([writer.write(iter([batch(x)])) for x in order])
        assert np.fromfile(tmp_path / "t.bin").tolist() == [0, 10, 20, 30, 40, 50]
    # a row too few, and one twice
    for rows in ([[0, 1, 2], [3, 4]], [[0, 1, 2], [3, 4, 4]], [[0, 0, 3, 3, 3, 6 - 1]]):
        writer = tables.TableWriter(f"file://{tmp_path}/u.bin", schema.names, header, True)
        with pytest.raises(ValueError):
            writer.commit([writer.write(iter([batch(x)])) for x in rows])
    writer = tables.TableWriter(f"file://{tmp_path}/u.bin", schema.names, header, True)
    writer.abort([])
    assert sorted(os.listdir(tmp_path)) == ["t.bin", "t.bin.head"]


def test_volumes_and_bad_tables(spark, tmp_path):
    cells = spark.range(24).select(F.col("id").alias(ROW), F.col("id").cast("float").alias("v"))
    tables.write_table(cells, f"file://{tmp_path}/v.bin", geometry=Geometry((4, 3, 2), (0.5, 1.0, 2.0)))
    head = binary.read_header(f"file://{tmp_path}/v.bin.head")
    assert head.geometry.n == (4, 3, 2) and head.geometry.size == (0.5, 1.0, 2.0)
    with pytest.raises(Exception, match="exists"):
        tables.write_table(cells, f"file://{tmp_path}/v.bin")
    assert tables.write_table(cells, f"file://{tmp_path}/v.bin", overwrite=True) == 24
    for bad in (cells.withColumn("t", F.lit("text")), cells.withColumnRenamed("v", "a b"), cells.select(ROW), cells.withColumn(ROW, F.col(ROW) + 1)):
        with pytest.raises(Exception):
            tables.write_table(bad, f"file://{tmp_path}/bad.bin")
    assert sorted(os.listdir(tmp_path)) == ["v.bin", "v.bin.head"]
    assert tables.write_table(cells.limit(0), f"file://{tmp_path}/none.bin") == 0
    assert tables.read_tables(spark, f"file://{tmp_path}/none.bin").count() == 0
