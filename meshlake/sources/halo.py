"""Particles for a halo finder: positions in units of the box, velocities scaled, six floats interleaved."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ROW


def scaled(df: DataFrame, columns: Sequence[str], box: float, velocity: float = 1.0, scale: float = 1.0, hubble: float = 100.0) -> DataFrame:
    """x, vx, y, vy, z, vz from three positions and three velocities."""
    if len(columns) != 6:
        raise ValueError("six columns are needed")
    out = [F.col(ROW)]
    for k, name in enumerate("xyz"):
        out.append(((F.col(columns[k]).cast("double") / box + 1) % 1).alias(name))
        out.append((F.col(columns[k + 3]).cast("double") * F.lit(velocity * scale / (box * hubble))).alias(f"v{name}"))
    return df.select(*out)


def write_particles(particles: DataFrame, folder: str) -> DataFrame:
    """One raw file for each partition; returns ``file`` and ``n``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        file, n = f"{at}/part-{TaskContext.get().partitionId():06d}.raw", 0
        with fs.open_output_stream(file) as f:
            for b in batches:
                rows = np.stack([c.to_numpy() for c in b.columns[1:]], 1).astype("<f4")
                f.write(rows.tobytes())
                n += len(rows)
        yield pa.RecordBatch.from_pydict({"file": [file], "n": [n]}, pa.schema([("file", pa.string()), ("n", pa.int64())]))

    return particles.select(ROW, "x", "vx", "y", "vy", "z", "vz").sortWithinPartitions(ROW).mapInArrow(write, "file string, n long")
