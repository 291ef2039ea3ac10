"""Multi-lists: both byte formats and text, with and without counts, read by ranges and written by many tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.model import ROW
from meshlake.operators import rows
from meshlake.sources import multilist

SIZES = [3, 0, 1, 400, 0, 0, 2, 5000, 1, 0]


def lists_of(sizes, seed=0):
    rng = np.random.default_rng(seed)
    return {k: rng.integers(0, 10**6, n).tolist() for k, n in enumerate(sizes, 1)}


def words_of(lists, counted=True, sized=True):
    return [len(lists)] * counted + [x for k in lists for x in [len(lists[k])] * sized + lists[k]]


def found(df):
    out = {}
    for r in df.orderBy("list_id", "pos").collect():
        out.setdefault(r["list_id"], []).append(r["row_id"])
        assert r["pos"] == len(out[r["list_id"]]) - 1
    return out


def nonempty(lists):
    return {k: v for k, v in lists.items() if v}


@pytest.mark.parametrize("dtype", ["u8", "i4", "ascii"])
@pytest.mark.parametrize("task_words", [7, 64, 1 << 20])
def test_lists_of_all_sizes(spark, tmp_path, dtype, task_words, monkeypatch):
    monkeypatch.setattr(multilist, "SCAN_WORDS", 5)
    lists = lists_of(SIZES)
    for counted in (True, False):
        file, words = f"{tmp_path}/lists-{counted}", words_of(lists, counted)
        if dtype == "ascii":
            with open(file, "w") as f:
                f.write("".join(f"{x}{' ' if x % 3 else chr(10)}" for x in words))
        else:
            np.array(words, f"<{dtype}").tofile(file)
        got = multilist.read_multilist(spark, f"file://{file}", dtype, None if counted else len(lists), task_words=task_words)
        assert found(got) == nonempty(lists)


@pytest.mark.parametrize("dtype", ["u8", "ascii"])
def test_lists_without_sizes(spark, tmp_path, dtype):
    file, ids = f"{tmp_path}/even", list(range(100, 160))
    with open(file, "wb") as f:
        f.write("\n".join(map(str, ids)).encode() if dtype == "ascii" else np.array(ids, "<u8").tobytes())
    got = found(multilist.read_multilist(spark, f"file://{file}", dtype, n_lists=5, n_each=12, task_words=8))
    assert got == {k: ids[12 * k - 12 : 12 * k] for k in range(1, 6)}
    assert found(multilist.read_multilist(spark, f"file://{file}", dtype, one=True, task_words=7)) == {1: ids}
    with pytest.raises(ValueError):
        multilist.read_multilist(spark, f"file://{file}", dtype, n_lists=6, n_each=12)
    with pytest.raises(ValueError):
        multilist.read_multilist(spark, f"file://{file}", dtype, n_each=12)


@pytest.mark.parametrize("words", [[2, 1, 5], [1, -1], [1, 9, 1], []])
def test_files_that_end_too_soon(spark, tmp_path, words):
    np.array(words, "<i4").tofile(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="words|ids"):
        multilist.read_multilist(spark, f"file://{tmp_path}/bad", "i4").count()


def test_a_list_of_most_ids_is_read_by_many_tasks(spark, tmp_path):
    lists = lists_of([5, 90_000, 7, 3000])
    np.array(words_of(lists), "<u8").tofile(f"{tmp_path}/hot")
    got = multilist.read_multilist(spark, f"file://{tmp_path}/hot", task_words=4096)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = got.where("list_id = 2").select(F.spark_partition_id().alias("t")).groupBy("t").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in tasks) < 60_000
    assert found(got) == lists


@pytest.mark.parametrize("counted,sized", [(True, True), (False, True), (False, False), (True, False)])
@pytest.mark.parametrize("dtype", ["u8", "i4", "ascii"])
def test_written_lists(spark, tmp_path, dtype, counted, sized):
    lists = lists_of(SIZES, 3)
    data = [(k, 10 * p, x) for k, v in lists.items() for p, x in enumerate(v)]
    df = spark.createDataFrame(data, multilist.LISTS).repartition(17)
    if dtype == "ascii":
        n, parts = multilist.write_multilist_text(df, f"file://{tmp_path}/text", counted, sized, n_lists=10)
        got = [int(x) for p in parts for x in open(p.removeprefix("file://")).read().split()]
        if counted and sized:
            assert found(multilist.read_multilist(spark, f"file://{tmp_path}/text", "ascii")) == nonempty(lists)
    else:
        n = multilist.write_multilist(df, f"file://{tmp_path}/out.lst", dtype, counted, sized, n_lists=10)
        got = np.fromfile(f"{tmp_path}/out.lst", f"<{dtype}").tolist()
        assert [x.name for x in tmp_path.iterdir()] == ["out.lst"]
    assert n == 10 and got == words_of(lists, counted, sized)


def test_lists_that_cannot_be_written(spark, tmp_path):
    for data, kind in (([(0, 0, 1)], "u8"), ([(None, 0, 1)], "u8"), ([(1, 0, None)], "u8"), ([(1, 0, -1)], "u8"), ([(1, 0, 1 << 40)], "i4")):
        with pytest.raises(Exception):
            multilist.write_multilist(spark.createDataFrame(data, multilist.LISTS), f"file://{tmp_path}/x", kind)
    assert not list(tmp_path.iterdir())
    with pytest.raises(ValueError, match="hdfs"):
        multilist.write_multilist(spark.createDataFrame([(1, 0, 1)], multilist.LISTS), "hdfs://a/b")
    none = spark.createDataFrame([], multilist.LISTS)
    assert multilist.write_multilist(none, f"file://{tmp_path}/none") == 0
    assert multilist.read_multilist(spark, f"file://{tmp_path}/none").count() == 0


def test_text_of_many_files_is_read_in_the_order_of_names(spark, tmp_path):
    for name, n in (("a", 3), ("b", 4000), ("c", 10), ("d", 900)):
        (tmp_path / name).write_text("\n".join(str(ord(name) * 10000 + k) for k in range(n)))
    got = multilist.read_rows(spark, f"file://{tmp_path}", "ascii").orderBy("pos").collect()
    assert [r["row_id"] for r in got] == [ord(x) * 10000 + k for x, n in zip("abcd", (3, 4000, 10, 900)) for k in range(n)]
    assert [r["pos"] for r in got] == list(range(4913))


def test_routed_lists(spark):
    n = 9000
    halos = [(k, float(k % 3 == 0), float(k % 4), None if k % 5 else 2.0) for k in range(n)]
    df = spark.createDataFrame(halos, f"{ROW} long, a double, b double, c double")
    data = [(k + 1, p, 10 * k + p) for k in range(n + 3) for p in range(k % 3)]
    got = rows.halo_routed_lists(spark.createDataFrame(data, multilist.LISTS), df, ["a", "b", "c"], 2.0)
    want, numbers = [], {1: 0, 2: 0, 3: 0}
    for k, *values in halos:
        route = next((j for j, v in enumerate(values, 1) if v is not None and v >= 2.0), None)
        if route:
            numbers[route] += 1
            want += [(route, numbers[route], k + 1, p, 10 * k + p) for p in range(k % 3)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    with pytest.raises(ValueError):
        rows.halo_routed_lists(got, df, ["a"] * 4)
