"""Dense groups by levels against counting and flooding in plain Python."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.model import ROW, Geometry
from meshlake.operators import groups

SCHEMA = f"{ROW} long, X double, Y double, Z double, w double, label string"


def clumps(spark, seed=0, n=1500):
    rng = np.random.default_rng(seed)
    middle = rng.uniform(1, 7, (6, 3))
    place = np.concatenate([middle[k] + rng.normal(0, s, (n // 6, 3)) for k, s in enumerate((0.2, 0.3, 0.5, 0.8, 0.1, 1.5))] + [[[8.0, 8.0, 8.0]], [[0.0, 0.0, 0.0]]])
    rows = [(k, *map(float, p), float(k % 3), "a") for k, p in enumerate(place)] + [(9000, None, 1.0, 1.0, 1.0, "a"), (9001, 8.5, 1.0, 1.0, 1.0, "a"), (9002, float("nan"), 1.0, 1.0, 1.0, "a"), (9003, 4.0, 4.0, 4.0, None, "a")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def brute(rows, geometry, least, levels, periodic):
    """Per level, the cells of each group with their points."""
    out = []
    for level in range(levels):
        n = [m << level for m in geometry.n]
        size = [d / (1 << level) for d in geometry.size]
        count = Counter()
        for r in rows:
            p = r[1:4]
            if all(v is not None and o <= v <= o + d * m for v, o, d, m in zip(p, geometry.origin, geometry.size, geometry.n)):
                count[tuple(min(int((v - o) // d), m - 1) for v, o, d, m in zip(p, geometry.origin, size, n))] += 1
        dense, seen = {c for c, k in count.items() if k >= least}, set()
        found = []
        for start in sorted(dense, key=lambda c: c[::-1]):
            if start in seen:
                continue
            group, todo = set(), [start]
            while todo:
                c = todo.pop()
                if c in group:
                    continue
                group.add(c)
                for k in range(3):
                    for s in (-1, 1):
                        to = list(c)
                        to[k] += s
                        if periodic:
                            to[k] %= n[k]
                        if tuple(to) in dense:
                            todo.append(tuple(to))
            seen |= group
            found.append((frozenset(group), sum(count[c] for c in group)))
        out.append(found)
    return out


@pytest.mark.parametrize("periodic", [False, True])
@pytest.mark.parametrize("least,levels", [(5, 4), (1, 2), (40, 3)])
def test_groups_of_all_levels(spark, periodic, least, levels):
    rows, df = clumps(spark)
    geometry = Geometry((4, 4, 4), (2.0, 2.0, 2.0))
    dense = groups.dense_cells(df, "XYZ", geometry, least, levels)
    cells = groups.group_cells(dense, geometry, levels, periodic).collect()
    want = brute(rows, geometry, least, levels, periodic)
    for level in range(levels):
        found = {}
        for r in cells:
            if r["level"] == level:
                found.setdefault(r["group"], {})[r["x"], r["y"], r["z"]] = r["n"]
        assert {(frozenset(c), sum(c.values())) for c in found.values()} == set(want[level])
    assert len({r["cell"] for r in cells}) == len(cells) and all(r["group"] <= r["cell"] for r in cells)


def test_the_tree_and_its_sums(spark):
    rows, df = clumps(spark, 3)
    geometry = Geometry((4, 4, 4), (2.0, 2.0, 2.0))
    tree = groups.dense_groups(df, "XYZ", least=8, levels=4, mass="w", geometry=geometry).collect()
    by_id = {r["group"]: r for r in tree}
    for r in tree:
        assert (r["parent"] is None) == (r["level"] == 0)
        if r["parent"] is not None:
            up = by_id[r["parent"]]
            assert up["level"] == r["level"] - 1 and up["n"] >= r["n"]
    cells = groups.group_cells(groups.dense_cells(df, "XYZ", geometry, 8, 4), geometry, 4)
    for level in range(4):
        got = groups.members(df, "XYZ", cells, geometry, level)
        assert got.columns == [*df.columns, "group"]
        sums = got.groupBy("group").agg(F.count("*").alias("n"), F.sum("w").alias("w"), *[F.sum(F.coalesce("w", F.lit(0.0)) * F.col(c)).alias(c) for c in "XYZ"]).collect()
        mine = {r["group"]: r for r in tree if r["level"] == level}
        assert {r["group"] for r in sums} == set(mine)
        for r in sums:
            m = mine[r["group"]]
            assert r["n"] == m["n"] and m["mass"] == pytest.approx(r["w"]) and [m[c] for c in "XYZ"] == pytest.approx([r[c] / r["w"] for c in "XYZ"])


def test_long_chains_and_lone_nodes(spark):
    n = 500
    nodes = spark.range(n + 3).select(F.col("id").alias("node"))
    order = np.random.default_rng(0).permutation(n).tolist()
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])], "a long, b long")
    got = {r["node"]: r["least"] for r in groups.components(nodes, edges).collect()}
    assert got == {k: 0 if k < n else k for k in range(n + 3)}


def test_no_points_and_one_place(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert groups.dense_groups(none, "XYZ").count() == 0
    one = spark.createDataFrame([(k, 1.0, 1.0, 1.0, 0.0, "a") for k in range(20)], SCHEMA)
    got = groups.dense_groups(one, "XYZ", least=20, levels=2, mass="w").collect()
    assert [(r["level"], r["n"], r["n_cells"], r["X"]) for r in sorted(got)] == [(0, 20, 1, None), (1, 20, 1, None)]
    assert groups.dense_groups(one, "XYZ", least=21).count() == 0
