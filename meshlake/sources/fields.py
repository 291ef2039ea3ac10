"""Numeric fields at known places of binary files, read by ranges of rows.

A field has a first byte, a distance from one value to the next, and an element type; so
columns end to end, interleaved ones and records of several types are all alike.  The
readers of snapshots, raw files and images find out the places from a file's header, on
the driver, and leave the reading to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..model import ROW

#: Bytes of a file that a task reads, and holds at once.
TASK_BYTES, READ_BYTES = 128 << 20, 16 << 20


@dataclass(frozen=True)
class Field:
    """``value = raw * scale + zero``; ``null`` is the raw number that stands for a missing one.  Without a type all values are missing."""

    name: str
    offset: int
    stride: int
    dtype: str | None
    null: int | None = None
    scale: float = 1.0
    zero: float = 0.0

    @property
    def size(self) -> int:
        return np.dtype(self.dtype).itemsize

    def values(self, raw: bytes, at: int, n: int) -> pa.Array:
        """``n`` values, the first of them at byte ``at`` of ``raw``; what is no number is missing."""
        if self.dtype == "bool":  # a letter
            letters = np.ndarray((n,), "u1", raw, at, (self.stride,))
            return pa.array((letters == ord("T")).astype(np.float64), mask=~np.isin(letters, (ord("T"), ord("F"))))
        got = np.ndarray((n,), self.dtype, raw, at, (self.stride,))
        missing = np.isnan(got) if got.dtype.kind == "f" else np.zeros(n, bool) if self.null is None else got == self.null
        value = got.astype(np.float64)
        if (self.scale, self.zero) != (1.0, 0.0):
            value = value * self.scale + self.zero
        return pa.array(value, mask=missing)


def regions(fields: Sequence[Field]) -> list[list[Field]]:
    """Fields that lie in one record are read together."""
    out: list[list[Field]] = []
    for f in sorted((f for f in fields if f.dtype), key=lambda f: (f.stride, f.offset)):
        if out and out[-1][0].stride == f.stride and f.offset + f.size <= out[-1][0].offset + f.stride:
            out[-1].append(f)
        else:
            out.append([f])
    return out


def read_fields(spark: SparkSession, path: str, n_rows: int, fields: Sequence[Field], first_row: int = 0) -> DataFrame:
    """``__row`` (from ``first_row`` on) and the fields as doubles.  ``path`` is a URI that driver and executors can open."""
    parts = regions(fields)
    width = sum(p[0].stride for p in parts) or 8
    a_read = max(1, READ_BYTES // width)
    a_task = a_read * max(1, TASK_BYTES // READ_BYTES)
    n_tasks = max(1, -(-n_rows // a_task))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(path)
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            with fs.open_input_file(at) as f:
                for a in range(k * a_task, min(n_rows, (k + 1) * a_task), a_read):
                    n = min(a_read, n_rows - a, (k + 1) * a_task - a)
                    found = {}
                    for part in parts:
                        first, stride = part[0].offset, part[0].stride
                        f.seek(first + a * stride)
                        last = max(x.offset + x.size for x in part)
                        raw = f.read((n - 1) * stride + last - first)
                        if len(raw) < (n - 1) * stride + last - first:
                            raise ValueError(f"{path} is shorter than its header says")
                        found |= {x.name: x.values(raw, x.offset - first, n) for x in part}
                    columns = [found.get(x.name, pa.nulls(n, pa.float64())) for x in fields]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n) + first_row), *columns], names=[ROW, *(x.name for x in fields)])

    schema = ", ".join([f"{ROW} long", *["`" + x.name.replace("`", "``") + "` double" for x in fields]])
    return spark.range(n_tasks, numPartitions=n_tasks).mapInArrow(read, schema)


def opened(path: str) -> pa.NativeFile:
    fs, at = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


def beside(path: str, name: str) -> str:
    """A file that a descriptor names, in the descriptor's folder unless it is a whole path or URI."""
    return name if "://" in name or name.startswith("/") else f"{path.rpartition('/')[0]}/{name}"
