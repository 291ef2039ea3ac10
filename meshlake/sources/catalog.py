"""What is known of a table without reading it: the least and greatest value of each column in each range of rows.

``describe`` reads a binary table (a file, or a folder of files as one) once and keeps, for
every range of RANGE rows and every column, the least and the greatest value, how many
there are and their sum, as a Parquet table beside it.  ``select`` then reads only ranges in
which a row can meet the limits, ``extract`` those that a ball or a box can reach, and
``statistic`` reads no range at all.  The files' sizes and times are kept with it; if they
have changed, all three say so instead of answering from what was.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROW, data_columns
from ..operators import rows
from .tables import read_tables, table_files

#: Rows of a range.
RANGE = 1 << 20


def mark(path: str) -> str:
    """A hash of the names, sizes and times of the table's files."""
    out = hashlib.sha256()
    for file in table_files(path):
        fs, at = pafs.FileSystem.from_uri(file)
        for info in fs.get_file_info([at, f"{at}.head"]):
            out.update(f"{info.path} {info.size} {info.mtime_ns}\n".encode())
    return out.hexdigest()


def place(path: str) -> str:
    return path.rstrip("/") + ".index"


def describe(spark: SparkSession, path: str, range_rows: int = RANGE) -> DataFrame:
    """Make the table of ranges and keep it: ``first``, ``last``, ``rows``, ``column``, ``low``, ``high``, ``n`` and ``total``.

    NULL is no value and neither is NaN; a range without a value of a column has NULL ends.
    Partial aggregates are all that moves.
    """
    df, seen = read_tables(spark, path), mark(path)
    names = data_columns(df)
    value = lambda c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`"))
    sums = [f(value(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count), ("su", F.sum))]
    found = df.groupBy(F.floor(F.col(ROW) / range_rows).alias("range")).agg(F.min(ROW).alias("first"), F.max(ROW).alias("last"), F.count("*").alias("rows"), *sums)
    each = [F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(x) for k, x in (("lo", "low"), ("hi", "high"), ("n", "n"), ("su", "total"))]) for i, c in enumerate(names)]
    found.select("first", "last", "rows", F.explode(F.array(*each)).alias("c"), F.lit(seen).alias("mark")).select("first", "last", "rows", "c.*", "mark").write.mode("overwrite").parquet(place(path))
    return described(spark, path)


def described(spark: SparkSession, path: str) -> DataFrame:
    """What ``describe`` kept; a table that has changed since is an error."""
    found = spark.read.parquet(place(path))
    if [r["mark"] for r in found.select("mark").distinct().collect()] not in ([mark(path)], []):
        raise ValueError(f"{path} has changed since it was described")
    return found.drop("mark")


def statistic(spark: SparkSession, path: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Minimum, maximum, average and sum of each column, as ``stats.statistic`` gives them, from the ranges alone."""
    found = described(spark, path)
    found = found if fields is None else found.where(F.col("column").isin(list(fields)))
    sums = found.groupBy("column").agg(F.min("low").alias("minimum"), F.max("high").alias("maximum"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    return sums.select("column", "minimum", "maximum", F.try_divide("total", "n").alias("average"), "total")


def _ranges(found: DataFrame, test: Column) -> list[tuple[int, int]]:
    """First and last rows of the ranges that pass; one number for each range comes to the driver, neighbours in one pair."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(map(tuple, found.where(test).select("first", "last").collect())):
        if out and out[-1][1] + 1 == first:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def _ends(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A row for each range with the ends of the columns."""
    found = described(spark, path)
    ends = [f(F.when(F.col("column") == c, F.col(k))).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("low", F.min), ("high", F.max))]
    return found.groupBy("first", "last").agg(*ends)


def select(spark: SparkSession, path: str, limits: rows.Limits, operator: str = "AND", columns: Sequence[str] | None = None) -> DataFrame:
    """``rows.select_rows`` of the table, reading only ranges in which a row can meet the limits."""
    names = data_columns(read_tables(spark, path))
    known = [c for c in limits if c in names]
    if not known:
        raise ValueError("no limit is on a column of the table")
    tests = []
    for i, c in enumerate(known):
        low, high = limits[c]
        test = F.col(f"low_{i}").isNotNull()
        test = test if low is None else test & (F.col(f"high_{i}") >= low)
        tests.append(test if high is None else test & (F.col(f"low_{i}") <= high))
    join = (lambda a, b: a | b) if operator.upper() == "OR" else (lambda a, b: a & b)
    chosen = _ranges(_ends(spark, path, known), reduce(join, tests))
    wanted = None if columns is None else [c for c in names if c in columns or c in known]
    found = rows.select_rows(read_tables(spark, path, wanted, chosen), limits, operator)
    return found if columns is None else found.select(ROW, *[c for c in names if c in columns])


def extract(spark: SparkSession, path: str, center: Mapping[str, float], radius: float | None = None, box: float | None = None, corner: float | None = None) -> DataFrame:
    """``rows.extract`` of the table, reading only ranges whose ends reach the ball or the box."""
    low, high = (-radius, radius) if radius is not None else (-box, box) if box is not None else (0.0, corner)
    tests = [(F.col(f"high_{i}") >= at + low) & (F.col(f"low_{i}") <= at + high) for i, at in enumerate(center.values())]
    if radius is not None:
        # from the center to the nearest place between the ends
        away = [F.greatest(F.col(f"low_{i}") - at, F.lit(at) - F.col(f"high_{i}"), F.lit(0.0)) for i, at in enumerate(center.values())]
        tests.append(F.sqrt(reduce(lambda a, b: a + b, [d * d for d in away])) <= radius)
    chosen = _ranges(_ends(spark, path, list(center)), reduce(lambda a, b: a & b, tests))
    return rows.extract(read_tables(spark, path, None, chosen), center, radius, box, corner)
