"""Binary column-major tables: a data file beside a text header.

The header's tokens are the element type, the number of columns, the number of rows
(for a volume followed by the cells and cell sizes of three axes), the byte order, and
the column names.  Reading is dealt out by ranges of rows, each task reads its part of
each wanted column.  Writing makes one such table for each partition, so nothing passes
through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROW, Geometry, data_columns

#: Fixed values of the format: names of element types.
TYPES = {
    "float": "f4", "f": "f4", "double": "f8", "d": "f8", "long double": "f16", "ld": "f16", "int": "i4", "i": "i4",
    "long": "i8", "l": "i8", "long int": "i8", "li": "i8", "long long int": "i8", "lli": "i8", "long long": "i8", "ll": "i8",
}
#: Fixed values of the format: what stands for a missing value and for text.
MISSING, TEXT = -1.0918273645e23, -1.4536271809e15


@dataclass(frozen=True)
class Header:
    kind: str
    n_rows: int
    order: str
    names: tuple[str, ...]
    geometry: Geometry | None = None

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(("<" if self.order.startswith("l") else ">") + TYPES[self.kind])

    def dumps(self) -> str:
        g = self.geometry
        shape = f"{self.n_rows}" + (f" {g.n[0]} {g.n[1]} {g.n[2]} {g.size[0]} {g.size[1]} {g.size[2]}" if g else "")
        return "\n".join([self.kind, str(len(self.names)), shape, self.order, *self.names]) + "\n"


def parse_header(text: str) -> Header:
    """Raises ValueError where names are missing or double, or the cells are not the rows."""
    lines = [x for x in text.splitlines() if x.strip()]
    kind, n_cols, shape, order = lines[0].strip(), int(lines[1]), lines[2].split(), lines[3].strip()
    names = tuple(" ".join(lines[4:]).split())
    if kind not in TYPES or len(names) != n_cols or len(set(names)) != n_cols:
        raise ValueError("not a valid header")
    geometry = None
    if len(shape) >= 7:
        geometry = Geometry(tuple(map(int, shape[1:4])), tuple(map(float, shape[4:7])))
        if geometry.cells != int(shape[0]):
            raise ValueError("cells and rows differ")
    return Header(kind, int(shape[0]), order, names, geometry)


def read_header(path: str) -> Header:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        return parse_header(f.read().decode())


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, header: str | None = None, rows_per_task: int = 1 << 20) -> tuple[DataFrame, Header]:
    """``__row`` and the wanted columns as doubles, with the missing and text marks as NULL.  ``path`` is a URI that executors can open."""
    head = read_header(header or f"{path}.head")
    names = [c for c in head.names if columns is None or c in columns]
    n_tasks = max(1, -(-head.n_rows // rows_per_task))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(path)
        size = head.dtype.itemsize
        for batch in batches:
            for k in batch.column(0).to_pylist():
                a, b = k * rows_per_task, min(head.n_rows, (k + 1) * rows_per_task)
                found = [pa.array(np.arange(a, b))]
                with fs.open_input_file(at) as f:
                    for name in names:
                        f.seek((head.names.index(name) * head.n_rows + a) * size)
                        values = np.frombuffer(f.read((b - a) * size), head.dtype)
                        marks = np.isin(values, np.array([MISSING, TEXT]).astype(head.dtype)) if head.dtype.kind == "f" else None
                        found.append(pa.array(values.astype(np.float64), mask=marks))
                yield pa.RecordBatch.from_arrays(found, names=[ROW, *names])

    schema = ", ".join([f"{ROW} long", *[f"`{c}` double" for c in names]])
    return spark.range(n_tasks, numPartitions=n_tasks).mapInArrow(read, schema), head


def write_parts(df: DataFrame, folder: str, order: str = "little", names: Sequence[str] | None = None, geometry: Geometry | None = None, rows_per_file: int = 1 << 20, kind: str = "float") -> DataFrame:
    """Tables of at most ``rows_per_file`` rows, by ranges of ``__row``; returns ``file`` (a path), ``first_row``, ``n_rows`` and ``uri``.

    NULL is written as the missing mark.  A volume (``geometry``) is cut between planes,
    so that each file is a volume with a header that says so; a plane that is larger than
    ``rows_per_file`` is a file.  Files of a task that runs again are the same.
    """
    names = list(names or data_columns(df))
    plane = geometry.n[0] * geometry.n[1] if geometry else 1
    each = plane * max(1, rows_per_file // plane)

    def write(group: pa.Table) -> pa.Table:
        group = group.sort_by(ROW)
        first, n = group[ROW][0].as_py(), group.num_rows
        shape = Geometry((*geometry.n[:2], n // plane), geometry.size, geometry.origin) if geometry else None
        head = Header(kind, n, order, tuple(names), shape)
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        file = f"{at}/part-{first // each:09d}.bin"
        with fs.open_output_stream(file) as f:
            for c in names:
                values = group[c].cast(pa.float64()).fill_null(MISSING).to_numpy()
                f.write(values.astype(head.dtype).tobytes())
        with fs.open_output_stream(f"{file}.head") as f:
            f.write(head.dumps().encode())
        uri = folder[: len(folder) - len(at)] + file
        return pa.table({"file": [file], "first_row": pa.array([first], pa.int64()), "n_rows": pa.array([n], pa.int64()), "uri": [uri]})

    dealt = df.select(F.col(ROW).cast("long").alias(ROW), *names).withColumn("__part", F.floor(F.col(ROW) / each))
    return dealt.groupBy("__part").applyInArrow(write, "file string, first_row long, n_rows long, uri string")


def swap_order(head: Header) -> Header:
    """The header with the other byte order; ``write_parts`` with it gives the swapped bytes."""
    return Header(head.kind, head.n_rows, "big" if head.order.startswith("l") else "little", head.names, head.geometry)


def read_rows(spark: SparkSession, path: str, dtype: str = "u8", ids_per_task: int = 1 << 20) -> DataFrame:
    """Row positions from a binary list of ``u8`` or ``i4`` numbers, or from a text file (``ascii``): ``pos`` and ``row_id``.

    A binary file, a URI or path that executors can open, is read by ranges of ids; a text
    file line by line, with a count for each partition at the driver.
    """
    if dtype == "ascii":
        return _read_ascii_rows(spark, path)
    fs, at = pafs.FileSystem.from_uri(path)
    width = np.dtype(dtype).itemsize
    n_bytes = fs.get_file_info(at).size
    if n_bytes is None or n_bytes % width:
        raise ValueError("not a list of whole numbers")
    n_ids = n_bytes // width
    n_tasks = max(1, -(-n_ids // ids_per_task))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                a, b = k * ids_per_task, min(n_ids, (k + 1) * ids_per_task)
                with fs.open_input_file(at) as f:
                    f.seek(a * width)
                    ids = np.frombuffer(f.read((b - a) * width), f"<{dtype}").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(ids)], names=["pos", "row_id"])

    return spark.range(n_tasks, numPartitions=n_tasks).mapInArrow(read, "pos long, row_id long")


def write_rows(rows: DataFrame, folder: str, dtype: str = "u8", column: str = ROW) -> DataFrame:
    """Row positions in ascending order, as lists of ``u8`` or ``i4`` numbers or as text (``ascii``); returns ``file`` and ``n``.

    A task writes one file; in the order of their names they are one list.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        file, n = f"{at}/rows-{TaskContext.get().partitionId():06d}.{'txt' if dtype == 'ascii' else 'bin'}", 0
        with fs.open_output_stream(file) as f:
            for b in batches:
                ids = b.column(0).to_numpy()
                f.write("".join(f"{x}\n" for x in ids.tolist()).encode() if dtype == "ascii" else ids.astype(f"<{dtype}").tobytes())
                n += len(ids)
        yield pa.RecordBatch.from_pydict({"file": [folder[: len(folder) - len(at)] + file], "n": [n]}, pa.schema([("file", pa.string()), ("n", pa.int64())]))

    ordered = rows.select(F.col(column).cast("long").alias("id")).where("id is not null").repartitionByRange("id").sortWithinPartitions("id")
    return ordered.mapInArrow(write, "file string, n long")


def _read_ascii_rows(spark: SparkSession, path: str) -> DataFrame:
    """The numbers of a text, or of a folder of texts in the order of their names; a count for each split comes to the driver."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
        for batch in batches:
            for line, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                yield file, block, line.split()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], int] = {}
        for file, block, words in tokens(batches):
            found[file, block] = found.get((file, block), 0) + len(words)
        yield pa.RecordBatch.from_pydict({"file": [x[0] for x in found], "block": [x[1] for x in found], "n": list(found.values())}, pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64())]))

    starts, total = {}, 0
    for file, block, n in sorted(map(tuple, lines.mapInArrow(counted, "file string, block long, n long").collect())):
        starts[file, block] = total
        total += n

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[str, int], int] = {}
        for batch in batches:
            pos, ids = [], []
            for file, block, words in tokens([batch]):
                first = at.get((file, block), starts[file, block])
                pos += range(first, first + len(words))
                ids += map(int, words)
                at[file, block] = first + len(words)
            yield pa.RecordBatch.from_arrays([pa.array(pos, pa.int64()), pa.array(ids, pa.int64())], names=["pos", "row_id"])

    return lines.mapInArrow(placed, "pos long, row_id long")
