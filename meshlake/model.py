"""Row positions and volume geometry.

A table is a DataFrame with a dense long column ``__row`` (0, 1, ...) where an operator
needs positions.  A volume is a table whose ``__row`` is ``ix + nx * (iy + ny * iz)``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = "__row"


@dataclass(frozen=True)
class Geometry:
    """Cells along each axis, their sizes, and the place of cell 0."""

    n: tuple[int, int, int]
    size: tuple[float, float, float] = (1.0, 1.0, 1.0)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @property
    def cells(self) -> int:
        return self.n[0] * self.n[1] * self.n[2]

    @property
    def volume(self) -> float:
        return self.size[0] * self.size[1] * self.size[2]

    def index(self) -> list[Column]:
        """ix, iy and iz of the cell in ``__row``."""
        nx, ny, _ = self.n
        row = F.col(ROW)
        return [(row % nx).cast("int"), F.expr(f"int({ROW} div {nx} % {ny})"), F.expr(f"int({ROW} div {nx * ny})")]

    def row(self, ix: Column, iy: Column, iz: Column) -> Column:
        nx, ny, _ = self.n
        return ix.cast("long") + F.lit(nx) * (iy.cast("long") + F.lit(ny) * iz.cast("long"))


def declared(n_rows: int, cells: tuple[int, int, int] | None = None, sizes: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Geometry | None:
    """The volume that ``n_rows`` cells are: of the given cells along each axis, or without them a cube.

    None where the numbers do not come out: such a table stays a table.
    """
    if cells is None or 0 in cells:
        side = round(n_rows ** (1 / 3))
        cells = (side, side, side)
    return Geometry(tuple(cells), tuple(sizes)) if n_rows and cells[0] * cells[1] * cells[2] == n_rows else None


_made: list[str] = []


def new_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; what is in it goes when the interpreter ends, if the session is still there."""
    if not _made:
        atexit.register(_clear)
    _made.append(f"{shared_top(spark)}/meshlake-{uuid.uuid4().hex}")
    return _made[-1]


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    for path in _made if spark is not None else []:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared folder, read back."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_sums(df: DataFrame, key: str, n: str) -> DataFrame:
    """``key`` and ``before``: the sum of ``n`` over all lesser ones of the distinct whole numbers ``key``.

    By blocks of 4096 numbers, then over the blocks: one row for each block meets in one task.
    """
    rows = df.select(key, F.col(n).alias("__n"), F.floor(F.col(key) / 4096).alias("__block"))
    blocks = rows.groupBy("__block").agg(F.sum("__n").alias("__sum"))
    blocks = blocks.select("__block", (F.sum("__sum").over(Window.partitionBy(F.lit(0)).orderBy("__block")) - F.col("__sum")).alias("__outside"))
    inside = F.sum("__n").over(Window.partitionBy("__block").orderBy(key)) - F.col("__n")
    return rows.withColumn("__inside", inside).join(blocks, "__block").select(key, (F.col("__outside") + F.col("__inside")).cast("long").alias("before"))


def shared_top(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Where that is unset: a temporary one in local mode, and an error on a cluster, which would not share it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="meshlake-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def with_row(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``__row``: its dense rank by the unique columns ``order``.

    Ranges are sorted apart; only a count for each partition comes to the driver.
    """
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.drop(ROW).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = kept(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__in", inside))
    total, before = 0, []
    for part, n in sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect()):
        before.append((part, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "__part int, __before long"))
    return ranged.join(offsets, "__part").withColumn(ROW, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def rows_of(df: DataFrame, row: str | None) -> DataFrame:
    """``df`` with the dense key column ``row`` as ``__row``."""
    return df if row is None else df.withColumn(ROW, F.col(row).cast("long"))


def dense(spark: SparkSession, geometry: Geometry) -> DataFrame:
    """``__row`` of every cell."""
    return spark.range(geometry.cells).withColumnRenamed("id", ROW)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]
