from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.model import ROW, Geometry, with_row
from meshlake.sources import binary, halo, text


def numbers(spark, n=100):
    return spark.range(n).select(F.col("id").alias(ROW), (F.col("id") * 0.5).alias("a"), F.when(F.col("id") % 7 != 0, F.col("id") - 50.0).alias("b"))


@pytest.mark.parametrize("order", ["little", "big"])
def test_binary_round_trip(spark, tmp_path, order):
    df = numbers(spark)
    files = binary.write_parts(df.repartition(1), f"file://{tmp_path}", order).collect()
    assert [(f["first_row"], f["n_rows"]) for f in files] == [(0, 100)]
    back, head = binary.read_table(spark, f"file://{files[0]['file']}", rows_per_task=30)
    assert head.order == order and head.names == ("a", "b")
    assert sorted(back.collect()) == sorted(df.collect())
    some, _ = binary.read_table(spark, f"file://{files[0]['file']}", ["b"])
    assert some.columns == [ROW, "b"]


def test_header():
    head = binary.Header("float", 8, "little", ("x", "y"), Geometry((2, 2, 2), (1.0, 2.0, 3.0)))
    assert binary.parse_header(head.dumps()) == head
    assert binary.swap_order(binary.swap_order(head)) == head
    for bad in ("float\n2\n8\nlittle\nx\n", "float\n2\n8\nlittle\nx\nx\n", "float\n1\n9 2 2 2 1 1 1\nlittle\nx\n", "text\n1\n9\nlittle\nx\n"):
        with pytest.raises(ValueError):
            binary.parse_header(bad)


def test_row_lists(spark, tmp_path):
    np.array([5, 1, 5], "<u8").tofile(tmp_path / "ids")
    assert [tuple(r) for r in binary.read_rows(spark, str(tmp_path / "ids")).collect()] == [(0, 5), (1, 1), (2, 5)]
    (tmp_path / "text").write_text("4 2\n 9\n")
    assert [tuple(r) for r in binary.read_rows(spark, str(tmp_path / "text"), "ascii").collect()] == [(0, 4), (1, 2), (2, 9)]


def test_long_row_lists_are_read_in_parts(spark, tmp_path):
    ids = np.arange(5000)[::-1]
    ids.astype("<i4").tofile(tmp_path / "ids")
    (tmp_path / "text").write_text("".join(f"{x} {y}\n" for x, y in ids.reshape(-1, 2)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for df in (binary.read_rows(spark, str(tmp_path / "ids"), "i4", ids_per_task=700), binary.read_rows(spark, str(tmp_path / "text"), "ascii")):
            assert df.rdd.getNumPartitions() > 1 and dict(df.dtypes)["pos"] == "bigint"
            assert sorted(map(tuple, df.collect())) == list(enumerate(ids.tolist()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ascii_and_csv(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# note\nx y\tx\n1 2.5 -3e2\n# more\n4 oops\n\n")
    df = text.read_ascii(spark, str(tmp_path / "a.txt"))
    assert df.columns == ["x", "y", "x_1"]
    assert [tuple(r) for r in df.collect()] == [(1.0, 2.5, -300.0), (4.0, None, None)]
    (tmp_path / "a.csv").write_text("# x , y\n1, 2\n,word\n")
    df = text.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["x", "y"] and [tuple(r) for r in df.collect()] == [(1.0, 2.0), (None, None)]


def test_votable_round_trip(spark, tmp_path):
    df = numbers(spark, 20)
    text.write_votable(df, str(tmp_path / "vo"))
    back = text.read_votable(spark, str(tmp_path / "vo"))
    assert back.columns == ["a", "b"]
    assert sorted(back.collect(), key=repr) == sorted(df.drop(ROW).collect(), key=repr)
    with pytest.raises(ValueError):
        text.write_votable(df, str(tmp_path / "no"), most=10)


def test_halo_particles(spark, tmp_path):
    df = numbers(spark, 10).withColumn("b", F.lit(2.0))
    out = halo.scaled(df, ["a", "a", "a", "b", "b", "b"], 10.0)
    files = halo.write_particles(out.coalesce(1), f"file://{tmp_path}").collect()
    found = np.fromfile(files[0]["file"], "<f4").reshape(-1, 6)
    assert found.shape == (10, 6)
    assert np.allclose(found[3], [0.15, 0.002] * 3)


def test_dense_positions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    assert [r["k"] for r in with_row(df, "k").orderBy(ROW).collect()] == list(range(1000))
    assert with_row(df.where("k < 0"), "k").count() == 0


def test_reasons_of_missing_values(spark, tmp_path):
    want = [(1.0, None, 2.0, None), (None, "text", 3.5, None), (None, "missing", None, "text"), (4.0, None, None, "missing")]
    (tmp_path / "a.csv").write_text("a,b\n1,2\nx,3.5\n,1-2\n4,\n")
    (tmp_path / "a.txt").write_text("# no row\na b\n1 2\nx 3.5\n4\n")
    (tmp_path / "a.xml").write_text('<VOTABLE><RESOURCE><TABLE><FIELD name="a"/><FIELD name="b"/><DATA><TABLEDATA><TR><TD>1</TD><TD>2</TD></TR><TR><TD>x</TD><TD> 3.5 </TD></TR><TR><TD></TD><TD>1-2</TD></TR><TR><TD>4</TD><TD/></TR></TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>')
    key = lambda r: repr(tuple(r))
    for name, read, rows in (("a.csv", text.read_csv, want), ("a.txt", text.read_ascii, [want[0], want[1], want[3]]), ("a.xml", text.read_votable, want)):
        got = read(spark, f"file://{tmp_path}/{name}", reasons=True)
        assert got.columns == ["a", "a__reason", "b", "b__reason"]
        assert sorted(map(key, got.collect())) == sorted(map(key, rows))
        assert read(spark, f"file://{tmp_path}/{name}").columns == ["a", "b"]
