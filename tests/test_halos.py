"""Spheres and their bound points against plain numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest

from meshlake.model import ROW, Geometry
from meshlake.operators import groups, halos

SCHEMA = f"{ROW} long, X double, Y double, Z double, m double, VX double, VY double, VZ double"


def clumps(seed=0):
    rng = np.random.default_rng(seed)
    middle = np.array([[2.0, 2, 2], [6.0, 6, 6], [2.0, 6, 2.5]])
    place = np.concatenate([middle[0] + rng.normal(0, 0.2, (900, 3)), middle[1] + rng.normal(0, 0.4, (300, 3)), middle[2] + rng.normal(0, 0.1, (60, 3)), rng.uniform(0, 8, (300, 3))])
    speed = rng.normal(0, 1, place.shape) * rng.choice([4.0, 20.0, 60.0], (len(place), 1)) + [3.0, 0, -1]
    mass = rng.integers(1, 4, len(place)).astype(float)
    rows = [(k, *map(float, p), float(m), *map(float, v)) for k, (p, m, v) in enumerate(zip(place, mass, speed))]
    return middle, rows


def brute(rows, centres, least, reach, bins, gravity, rounds):
    out = {}
    for name, *c in centres:
        at = []
        for r in rows:
            if None in r[1:4]:
                continue
            d = math.sqrt(sum((a - b) ** 2 for a, b in zip(r[1:4], c)))
            if d < reach:
                at.append((min(int(d * bins / reach), bins - 1), r[4] or 0.0, r[5:]))
        edge = [(k + 1) * reach / bins for k in range(bins)]
        inside = [sum(m for b, m, _ in at if b <= k) for k in range(bins)]
        thin = [inside[k] < least * 4 / 3 * math.pi * edge[k] ** 3 for k in range(bins)]
        if all(thin):
            continue
        cut = next((k for k in range(thin.index(False), bins) if thin[k]), bins)
        held = [x for x in at if x[0] < cut]
        bound = [x for x in held if None not in x[2]]
        for _ in range(rounds):
            if not bound:
                break
            total = sum(m for _, m, _ in bound)
            mean = sum(m * np.array(v) for _, m, v in bound) / total
            inside = [sum(m for b, m, _ in bound if b <= k) for k in range(cut)]
            free = [2 * gravity * (total / edge[cut - 1] + sum(inside[k] * (1 / edge[k - 1] - 1 / edge[k]) for k in range(b + 1, cut))) for b in range(cut)]
            left = [x for x in bound if ((np.array(x[2]) - mean) ** 2).sum() <= free[x[0]]]
            if len(left) == len(bound):
                break
            bound = left
        out[name] = (edge[cut - 1], len(held), sum(m for _, m, _ in held), len(bound), sum(m for _, m, _ in bound))
    return out


@pytest.mark.parametrize("rounds,most", [(20, 500_000), (1, 0)])
def test_spheres_and_what_they_hold(spark, monkeypatch, rounds, most):
    monkeypatch.setattr(halos, "BROADCAST", most)
    middle, rows = clumps()
    rows += [(9000, None, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0), (9001, 2.0, 2.0, 2.0, None, 0.0, 0.0, 0.0), (9002, 2.0, 2.0, 2.1, 1.0, None, 0.0, 0.0), (9003, 2.0, 2.0, 2.0, 1.0, 3.0, 0.0, -1.0)]
    centres = [(k, *map(float, c)) for k, c in enumerate(middle)] + [(7, 7.9, 0.1, 0.1), (8, 50.0, 50.0, 50.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    of = spark.createDataFrame(centres, "halo long, X double, Y double, Z double")
    got = halos.halos(df, "XYZ", of, 30.0, 1.5, ["VX", "VY", "VZ"], "m", 24, 1.0, rounds).collect()
    want = brute(rows, centres, 30.0, 1.5, 24, 1.0, rounds)
    assert {r["halo"] for r in got} == set(want) and {0, 1, 2} <= set(want) and 8 not in want
    for r in got:
        assert (r["radius"], r["n"], r["mass"], r["n_bound"], r["mass_bound"]) == pytest.approx(want[r["halo"]])
    assert 0 < want[0][3] < want[0][1]
    plain = halos.halos(df, "XYZ", of, 30.0, 1.5, mass="m", bins=24)
    assert plain.columns == ["halo", "radius", "n", "mass"]
    assert {r["halo"]: r["n"] for r in plain.collect()} == {k: v[1] for k, v in want.items()}


def test_centres_from_the_tree(spark):
    middle, rows = clumps(2)
    df = spark.createDataFrame(rows, SCHEMA)
    tree = groups.dense_groups(df, "XYZ", least=12, levels=3, mass="m", geometry=Geometry((4, 4, 4), (2.0, 2.0, 2.0)))
    cores = halos.cores(tree)
    rows_of = {r["group"]: r for r in tree.collect()}
    parents = {r["parent"] for r in rows_of.values()}
    got = {r["halo"]: (r["X"], r["Y"], r["Z"]) for r in cores.collect()}
    assert set(got) == {k for k in rows_of if k not in parents}
    for c in middle:
        assert min(math.dist(c, x) for x in got.values()) < 0.5
    found = halos.halos(df, "XYZ", cores, 30.0, 1.0, mass="m")
    assert 0 < found.count() <= len(got)


def test_no_points_and_no_centres(spark):
    none = spark.createDataFrame([], SCHEMA)
    of = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "halo long, X double, Y double, Z double")
    assert halos.halos(none, "XYZ", of, 1.0, 1.0, ["VX", "VY", "VZ"]).count() == 0
    some = spark.createDataFrame(clumps()[1][:10], SCHEMA)
    assert halos.halos(some, "XYZ", of.limit(0), 1.0, 1.0, ["VX", "VY", "VZ"]).count() == 0
