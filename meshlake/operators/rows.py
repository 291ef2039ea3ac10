"""Operators that choose rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ROW, Geometry, data_columns

Limits = Mapping[str, tuple[float | None, float | None]]


def limits_predicate(df: DataFrame, limits: Limits, operator: str = "AND") -> Column:
    """Closed intervals, None for an open end; unknown columns are skipped, but one must be known."""
    tests = []
    for name, (low, high) in limits.items():
        if name in df.columns:
            parts = [F.col(name) >= low] * (low is not None) + [F.col(name) <= high] * (high is not None)
            tests.append(reduce(lambda a, b: a & b, parts, F.col(name).isNotNull()))
    if not tests:
        raise ValueError("no limit is on a column of the table")
    return reduce((lambda a, b: a | b) if operator.upper() == "OR" else (lambda a, b: a & b), tests)


def select_rows(df: DataFrame, limits: Limits, operator: str = "AND") -> DataFrame:
    return df.where(limits_predicate(df, limits, operator))


def row_ids(df: DataFrame, limits: Limits, operator: str = "AND") -> DataFrame:
    """Positions of the rows that the limits select."""
    return select_rows(df, limits, operator).select(ROW)


def extract(df: DataFrame, center: Mapping[str, float], radius: float | None = None, box: float | None = None, corner: float | None = None) -> DataFrame:
    """Rows in a sphere around the center, in a box of half-width ``box`` around it, or in one of width ``corner`` from it on.

    Plain bounds for each axis stand beside the sphere, so that they reach the scan.
    """
    low, high = (-radius, radius) if radius is not None else (-box, box) if box is not None else (0.0, corner)
    holds = reduce(lambda a, b: a & b, [F.col(c).between(at + low, at + high) for c, at in center.items()])
    if radius is not None:
        square = reduce(lambda a, b: a + b, [(F.col(c).cast("double") - at) * (F.col(c).cast("double") - at) for c, at in center.items()])
        holds &= F.sqrt(square) <= radius
    return df.where(holds)


def sigma_contours(df: DataFrame, fields: Sequence[str], n_sigma: float = 1.0, exclude: bool = False, all_columns: bool = False) -> DataFrame:
    """Rows in which every field is within (or outside) mean and ``n_sigma`` sample deviations."""
    stats = df.agg(*[f(c).alias(f"{k}_{i}") for i, c in enumerate(fields) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    tests = []
    for i, c in enumerate(fields):
        m, s = stats[f"m_{i}"], stats[f"s_{i}"] or 0.0
        within = F.col(c).between(m - n_sigma * s, m + n_sigma * s) if m is not None else F.lit(False)
        tests.append(~within if exclude else within)
    found = df.where(reduce(lambda a, b: a & b, tests))
    return found if all_columns else found.select(*[c for c in df.columns if c == ROW or c in fields])


def show_volume(df: DataFrame, geometry: Geometry, limits: Limits, operator: str = "AND", n_cells: int | None = None) -> DataFrame:
    """Cells that the limits select, with coordinates from 1 on; the first ``n_cells`` of them."""
    found = select_rows(df, limits, operator)
    if n_cells is not None:
        found = found.orderBy(ROW).limit(n_cells)
    x, y, z = geometry.index()
    return found.select((x + 1).alias("X"), (y + 1).alias("Y"), (z + 1).alias("Z"), *data_columns(df))


def select_volume(df: DataFrame, limits: Limits, operator: str = "AND") -> DataFrame:
    """The volume with 0 in all fields of the cells that the limits do not select."""
    holds = limits_predicate(df, limits, operator)
    return df.withColumns({c: F.when(holds, F.col(c).cast("double")).otherwise(0.0) for c in data_columns(df)})


def extract_list(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows by position: ``ids`` has ``list_id``, ``pos`` and ``row_id``; repeats stay; an id outside the table is an error."""
    found = ids.join(df, ids["row_id"] == df[ROW], "left")
    checked = F.when(F.col(ROW).isNull(), F.raise_error(F.concat(F.lit("no row "), F.col("row_id")))).otherwise(F.col("row_id"))
    return found.withColumn("row_id", checked.cast("long")).drop(ROW)


def extract_subvolume(df: DataFrame, geometry: Geometry, start: Sequence[int], resolution: Sequence[int]) -> tuple[DataFrame, Geometry]:
    """The cells from ``start`` on, as a volume of its own."""
    if any(s < 0 or s + r > n for s, r, n in zip(start, resolution, geometry.n)):
        raise ValueError("the sub-volume is not inside")
    index = geometry.index()
    inside = reduce(lambda a, b: a & b, [i.between(s, s + r - 1) for i, s, r in zip(index, start, resolution)])
    origin = tuple(o + s * d for o, s, d in zip(geometry.origin, start, geometry.size))
    out = Geometry(tuple(resolution), geometry.size, origin)
    return df.where(inside).withColumn(ROW, out.row(*[i - s for i, s in zip(index, start)])), out


def halo_lists(lists: DataFrame, chosen: DataFrame, column: str = "Id") -> DataFrame:
    """The rows of those lists (``list_id`` from 1 on) whose number is in a column; numbers of no list are ignored."""
    return lists.join(chosen.select(F.col(column).cast("long").alias("list_id")).distinct(), "list_id", "left_semi")


def halo_routes(halos: DataFrame, fields: Sequence[str], threshold: float = 1.0) -> DataFrame:
    """``route`` k for the first of the fields that reaches the threshold; halos of which none does go."""
    route = F.coalesce(*[F.when(F.col(c) >= threshold, k) for k, c in enumerate(fields, 1)])
    return halos.withColumn("route", route).where("route is not null")


def halo_routed_lists(lists: DataFrame, halos: DataFrame, fields: Sequence[str], threshold: float = 1.0) -> DataFrame:
    """The ids of the lists by route: ``route``, ``list_id``, ``pos`` and ``row_id``, the lists of a route numbered from 1 on.

    List k belongs to the halo of row k - 1 and takes its route (see ``halo_routes``); lists
    of halos without a route, and beyond the table, go.  ``old_id`` is a list's number before.
    Halos of a route are numbered from counts of ranges of rows; lists meet them by a join on
    the list's number, which a list of very many ids makes uneven: Spark's skew join splits it.
    """
    if not 1 <= len(fields) <= 3:
        raise ValueError("one to three fields")
    routed = halo_routes(halos, fields, threshold).select((F.col(ROW) + 1).alias("old_id"), "route")
    marks = [F.sum((F.col("route") == k).cast("long")).alias(f"r{k}") for k in range(1, len(fields) + 1)]
    blocks = routed.groupBy(F.floor(F.col("old_id") / 4096).alias("block")).agg(*marks)
    before = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", *[F.coalesce(F.sum(f"r{k}").over(before), F.lit(0)).alias(f"r{k}") for k in range(1, len(fields) + 1)])
    inside = F.row_number().over(Window.partitionBy("block", "route").orderBy("old_id"))
    numbered = routed.withColumn("block", F.floor(F.col("old_id") / 4096)).withColumn("inside", inside).join(blocks, "block")
    outside = F.coalesce(*[F.when(F.col("route") == k, F.col(f"r{k}")) for k in range(1, len(fields) + 1)])
    numbered = numbered.select("old_id", "route", (outside + F.col("inside")).cast("long").alias("new_id"))
    found = lists.withColumnRenamed("list_id", "old_id").join(numbered, "old_id")
    return found.select("route", F.col("new_id").alias("list_id"), "old_id", "pos", "row_id")
