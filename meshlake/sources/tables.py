"""Binary column-major tables as a Spark data source, ``meshtable``.

``spark.read.format("meshtable").load(path)``: a table file, a folder of them, or a pattern,
as one table in the order of the files' names.  Row numbers follow from the headers' row
counts; one scan reads all files, and a task's share is a range of rows, part of a large
file or several small ones.  Options:

* ``columns``: names, separated by blanks; others are not read.  A schema says the same.
* ``rows``: ``first:last``, either end open, both included, or several such ranges with commas
  between them; what is outside is not read.
* ``rows_per_task``: 1048576.
* ``pushdown``: ``true`` where the session pushes filters to Python sources
  (``spark.sql.python.filterPushdown.enabled``); bounds on ``__row`` in a filter then do the
  same as ``rows``.  ``read_tables`` sets it as the session has it.

``df.write.format("meshtable").option("rows", n).save(path)`` writes one file and its header
from many tasks; see ``write_table``, which counts the rows.
"""

from __future__ import annotations

import os
import posixpath
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..model import ROW, Geometry, data_columns
from . import onefile
from .binary import MISSING, TEXT, Header, read_header

NAME = "meshtable"
ROWS_PER_TASK = 1 << 20
#: Headers that are read at once, and rows of a column that a task holds before it gives them on.
THREADS, BATCH_ROWS = 32, 1 << 17


@dataclass(frozen=True)
class Part:
    """Rows ``first`` to ``first + n - 1`` of a file, which are rows from ``row`` on of the table."""

    path: str
    header: Header
    first: int
    n: int
    row: int


class Share(InputPartition):
    def __init__(self, parts: list[Part]):
        self.parts = parts


def table_files(path: str) -> list[str]:
    """The data files that ``path`` names, in order: a file, a folder's files with headers, or a pattern in the last part of the path."""
    place, _, pattern = path.rpartition("/")
    if not any(c in pattern for c in "*?["):
        place, pattern = path, "*"
    fs, folder = pafs.FileSystem.from_uri(place)
    prefix = place.removesuffix(folder)
    if fs.get_file_info(folder).type == pafs.FileType.File:
        return [path]
    names = [x.path for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if x.type == pafs.FileType.File]
    found = sorted(x.removesuffix(".head") for x in names if x.endswith(".head") and fnmatch(posixpath.basename(x).removesuffix(".head"), pattern))
    if not found:
        raise ValueError(f"{path} has no tables")
    return [prefix + x for x in found]


def parts_of(files: Sequence[str]) -> list[Part]:
    """Every file whole, with its first row; all must have the same columns, types and byte orders may differ."""
    with ThreadPoolExecutor(THREADS) as pool:
        headers = list(pool.map(lambda x: read_header(f"{x}.head"), files))
    row, out = 0, []
    for file, header in zip(files, headers):
        if header.names != headers[0].names:
            raise ValueError(f"{file} has other columns than {files[0]}")
        out.append(Part(file, header, 0, header.n_rows, row))
        row += header.n_rows
    return out


def shares(parts: Sequence[Part], ranges: Sequence[tuple[int, int]], rows_per_task: int) -> list[list[Part]]:
    """The rows of ascending ranges (first, last) in shares of ``rows_per_task`` rows at most, large files cut and small ones together."""
    out: list[list[Part]] = []
    room, ends = 0, [p.row + p.n for p in parts]
    for low, high in ranges:
        for p in parts[bisect_right(ends, low) :] if low <= high else ():
            if p.row > high:
                break
            a, b = max(low - p.row, 0), min(high - p.row + 1, p.n)
            while a < b:
                if not room:
                    out.append([])
                    room = rows_per_task
                n = min(room, b - a)
                out[-1].append(Part(p.path, p.header, a, n, p.row + a))
                a, room = a + n, room - n
    return out


def ranges_of(text: str) -> list[tuple[int, int]]:
    """Ranges as the option ``rows`` has them; those that are empty are left out."""
    out = []
    for word in (w for w in text.split(",") if w):
        low, _, high = word.partition(":")
        out.append((int(low or 0), int(high) if high else 1 << 62))
    if any(b >= c for (_, b), (c, _) in zip(out, out[1:])):
        raise ValueError("ranges must ascend")
    return out


def read_part(part: Part, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """``__row`` and the wanted columns as doubles, the marks of missing values and of text as NULL."""
    kind = part.header.dtype
    size = kind.itemsize
    fs, at = pafs.FileSystem.from_uri(part.path)
    with fs.open_input_file(at) as f:
        for a in range(part.first, part.first + part.n, BATCH_ROWS):
            n = min(BATCH_ROWS, part.first + part.n - a)
            columns = []
            for name in names:
                if name == ROW:
                    columns.append(pa.array(np.arange(n) + (part.row + a - part.first)))
                    continue
                f.seek((part.header.names.index(name) * part.header.n_rows + a) * size)
                raw = f.read(n * size)
                if len(raw) < n * size:
                    raise ValueError(f"{part.path} is shorter than its header says")
                values = np.frombuffer(raw, kind)
                marks = np.isin(values, np.array([MISSING, TEXT]).astype(kind)) if kind.kind == "f" else None
                columns.append(pa.array(values.astype(np.float64), mask=marks))
            yield pa.RecordBatch.from_arrays(columns, names=list(names))


class TableReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, ranges: Sequence[tuple[int, int]], rows_per_task: int):
        self.path, self.names, self.ranges, self.rows_per_task = path, schema.names, ranges, rows_per_task
        self.low, self.high = 0, 1 << 62

    def partitions(self) -> Sequence[InputPartition]:
        wanted = [(max(a, self.low), min(b, self.high)) for a, b in self.ranges]
        return [Share(x) for x in shares(parts_of(table_files(self.path)), wanted, self.rows_per_task)] or [Share([])]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        for part in partition.parts:
            yield from read_part(part, self.names)


class PushingReader(TableReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on the row number are taken, and need no test afterwards; all else is left to Spark."""
        for f in filters:
            row = getattr(f, "attribute", None) == (ROW,)
            value = getattr(f, "value", None)
            whole = isinstance(value, int) and not isinstance(value, bool)
            if row and whole and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if row and whole and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, value - isinstance(f, LessThan))
            if row and isinstance(f, In) and value:
                # the range between them; Spark still tests which
                self.low, self.high = max(self.low, min(value)), min(self.high, max(value))
            if not (row and whole and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))):
                yield f


@dataclass
class Written(WriterCommitMessage):
    n: int
    #: Sum of the row numbers and of their squares, as whole numbers.
    total: int
    squares: int


class TableWriter(DataSourceArrowWriter):
    """Every task writes its rows at their places in a temporary file; the driver checks that all rows are there and names the file."""

    def __init__(self, path: str, names: Sequence[str], header: Header, overwrite: bool):
        self.path, self.names, self.header = path, list(names), header
        local = onefile.local_path(path)
        if os.path.exists(local) and not overwrite:
            raise ValueError(f"{path} exists")
        if ROW not in self.names:
            raise ValueError(f"a table without {ROW} has no order")
        self.made = onefile.begun(path, header.n_rows * len(header.names) * header.dtype.itemsize)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        n, total, squares = 0, 0, 0
        head, size = self.header, self.header.dtype.itemsize
        with onefile.Places(self.made) as file:
            for batch in iterator:
                rows = batch.column(self.names.index(ROW)).to_numpy(zero_copy_only=False)
                if not len(rows):
                    continue
                if batch.column(self.names.index(ROW)).null_count or rows.min() < 0 or rows.max() >= head.n_rows:
                    raise ValueError(f"rows must be numbered from 0 to {head.n_rows - 1}")
                runs = [0, *(np.flatnonzero(np.diff(rows) != 1) + 1).tolist(), len(rows)]
                for k, name in enumerate(head.names):
                    values = batch.column(self.names.index(name)).cast(pa.float64()).fill_null(MISSING).to_numpy().astype(head.dtype)
                    for a, b in zip(runs, runs[1:]):
                        file.put((k * head.n_rows + int(rows[a])) * size, values[a:b].tobytes())
                n += len(rows)
                total += sum(rows.tolist())
                squares += sum(x * x for x in rows.tolist())
        return Written(n, total, squares)

    def commit(self, messages: list[Written | None]) -> None:
        n = self.header.n_rows
        got = [sum(getattr(m, x) for m in messages if m is not None) for x in ("n", "total", "squares")]
        if got != [n, n * (n - 1) // 2, (n - 1) * n * (2 * n - 1) // 6]:
            onefile.dropped(self.made)
            raise ValueError(f"{got[0]} rows came, and they are not each of 0 to {n - 1} once")
        head = onefile.begun(f"{self.path}.head", 0)
        with open(head, "w") as f:
            f.write(self.header.dumps())
        onefile.finished(self.made, self.path)
        onefile.finished(head, f"{self.path}.head")

    def abort(self, messages: list[Written | None]) -> None:
        onefile.dropped(self.made)


class TableSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        head = read_header(f"{table_files(self.options['path'])[0]}.head")
        wanted = self.options.get("columns")
        unknown = set((wanted or "").split()) - set(head.names)
        if unknown:
            raise ValueError(f"no column {', '.join(sorted(unknown))}")
        names = [c for c in head.names if wanted is None or c in wanted.split()]
        return StructType([StructField(ROW, LongType(), False), *[StructField(c, DoubleType()) for c in names]])

    def reader(self, schema: StructType) -> DataSourceReader:
        ranges = ranges_of(self.options.get("rows", ":"))
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else TableReader
        return kind(self.options["path"], schema, ranges, int(self.options.get("rows_per_task", ROWS_PER_TASK)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        cells, sizes = (self.options.get(k, "").split() for k in ("cells", "sizes"))
        geometry = Geometry(tuple(map(int, cells)), tuple(map(float, sizes)) if sizes else (1.0, 1.0, 1.0)) if cells else None
        n = int(self.options["rows"])
        if geometry is not None and geometry.cells != n:
            raise ValueError("cells and rows differ")
        names = tuple(c for c in schema.names if c != ROW)
        bad = [f.name for f in schema if f.name != ROW and not f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")] + [c for c in names if len(c.split()) != 1]
        if bad or not names:
            raise ValueError(f"not numbers, or no names of a header: {', '.join(bad)}" if bad else "a table needs a column")
        header = Header(self.options.get("kind", "float"), n, self.options.get("order", "little"), names, geometry)
        return TableWriter(self.options["path"], schema.names, header, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(TableSource)
    return spark


def read_tables(spark: SparkSession, path: str, columns: Sequence[str] | None = None, rows: tuple[int | None, int | None] | Sequence[tuple[int, int]] | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``__row`` and the wanted columns of a table, or of a folder of tables as one, by one scan.

    ``rows``: the first and the last, None for an open end, or a list of ascending pairs.
    """
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    found = registered(spark).read.format(NAME).option("rows_per_task", rows_per_task).option("pushdown", pushes)
    if columns is not None:
        found = found.option("columns", " ".join(columns))
    if rows is not None:
        pairs = rows if isinstance(rows, list) else [rows]
        found = found.option("rows", ",".join(":".join("" if x is None else str(x) for x in r) for r in pairs))
    return found.load(path)


def write_table(df: DataFrame, path: str, kind: str = "float", order: str = "little", geometry: Geometry | None = None, overwrite: bool = False) -> int:
    """One table file from ``df``, which has each ``__row`` from 0 on once, and its header; returns the number of rows.

    Columns are all of ``df`` but ``__row``, numbers, in its order; NULL is the missing mark.
    Ranges of rows are sorted, so that a task writes long stretches of each column.  What
    is written does not depend on the partitions, nor on tasks that ran twice.  Only counts
    come to the driver.  For folders whose files take writes at any place, see ``onefile``.
    """
    n = df.count()
    cells = {"cells": " ".join(map(str, geometry.n)), "sizes": " ".join(map(str, geometry.size))} if geometry else {}
    ordered = df.select(F.col(ROW).cast("long").alias(ROW), *[F.col(f"`{c}`") for c in data_columns(df)]).repartitionByRange(ROW).sortWithinPartitions(ROW)
    registered(df.sparkSession)
    ordered.write.format(NAME).options(rows=n, kind=kind, order=order, **cells).mode("overwrite" if overwrite else "append").save(path)
    return n
