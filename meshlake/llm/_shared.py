"""The folder that driver and executors share, tables kept in it, and names of rows.

A table written there cuts lineage: if an executor is lost, its rows are read again
instead of being made again, and no block lives on one machine only.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..model import shared_top

#: Rows of a few numbers that may be broadcast, by count; more go by a shuffle.
BROADCAST = 500_000
#: Bytes of an Arrow batch on its way to a task's Python: texts are long, and both sides hold a few batches.
BATCH_BYTES = 2 << 20
#: Bytes of text in a bucket of a bucketed table, and most buckets.
BUCKET_BYTES, MOST_BUCKETS = 256 << 20, 100_000

_made: list[str] = []
_tables: dict[str, str] = {}


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of long rows small; rows of a few numbers still go by their usual count."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) != str(BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``."""
    bounded_batches(spark)
    path = f"{shared_top(spark)}/meshlake-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clear)
    _made.append(path)
    return path


def keep(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame of ``make``, kept; whatever else was kept on the way to it is deleted."""
    folders, names = len(_made), set(_tables)
    out = keep(make())
    for name in [x for x in _tables if x not in names]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        del _tables[name]
    for path in _made[folders:-1]:
        delete(spark, path)
    del _made[folders:-1]
    return out


def small(df: DataFrame) -> DataFrame:
    """``df``, a kept table of narrow rows, marked for a broadcast if it has at most BROADCAST of them."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one made from it that no column of ``df`` has, upper and lower case being alike."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(names: list[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def identity(*columns: Column) -> Column:
    """16 bytes of a SHA-256 over the columns as text, nulls and borders told apart."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts += [F.coalesce(F.octet_length(text).cast("string"), F.lit("n")), F.lit(":"), F.coalesce(text, F.lit(""))]
    return F.unhex(F.substring(F.sha2(F.concat(*parts).cast("binary"), 256), 1, 32))


def numbered(df: DataFrame, count: str, spread: bool = False) -> DataFrame:
    """Each row ``count`` times, with ``__copy`` from 0 on; by runs of 4096, with ``spread`` dealt over the tasks."""
    last = F.col(count) - 1
    runs = df.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / 4096))))
    runs = runs.repartition(*[F.col(f"`{c}`") for c in runs.columns]) if spread else runs
    return runs.withColumn("__copy", F.explode(F.sequence(F.col("__run") * 4096, F.least(last, F.col("__run") * 4096 + 4095)))).drop("__run", count)


def running(counts: DataFrame, key: str, n: str) -> DataFrame:
    """``key``, ``before`` and ``total``: the sum of ``n`` over all lesser keys, and over all; by blocks of 4096 keys, then over blocks."""
    counts = counts.select(key, n, F.floor(F.col(key) / 4096).alias("block"))
    every = Window.partitionBy(F.lit(0))
    blocks = counts.groupBy("block").agg(F.sum(n).alias("m"))
    blocks = blocks.select("block", (F.sum("m").over(every.orderBy("block")) - F.col("m")).alias("outside"), F.sum("m").over(every).alias("total"))
    inside = F.sum(n).over(Window.partitionBy("block").orderBy(key)) - F.col(n)
    return counts.withColumn("inside", inside).join(blocks, "block").select(key, (F.col("outside") + F.col("inside")).alias("before"), "total")


def bucketed(df: DataFrame, key: str, n_bytes: int) -> DataFrame:
    """``df``, of about ``n_bytes``, as a kept table in buckets by ``key``: joins on it move the other side only.

    The buckets have a bounded size on average; where there are more of them than shuffle
    partitions the rows are dealt first, so that a task writes few files.
    """
    spark = df.sparkSession
    name, path = f"meshlake_{uuid.uuid4().hex}", shared_folder(spark)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MOST_BUCKETS, -(-n_bytes // BUCKET_BYTES))
    parts = max(usual, wanted)
    if wanted > usual:
        df = df.repartition(parts, key)
    df.write.bucketBy(parts, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    _tables[name] = path
    return spark.table(name)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    for name, path in [(x, None) for x in _tables] + [(None, x) for x in _made] if spark is not None else []:
        try:
            if name:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
            else:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
