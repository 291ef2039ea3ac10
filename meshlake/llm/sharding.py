"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters every record by a seeded hash into buckets small enough for a
task's memory.  Pass two permutes each bucket with a Fisher-Yates shuffle
(``functions.shuffle``).  Buckets in turn, each in its permuted order, are one random
order of the table, which is cut into shards whose row counts differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import keep, numbered, quoted, running, small

#: A row per bucket, 16 bytes each, is broadcast up to this number of buckets; beyond it the join shuffles.
BROADCAST_BUCKETS = 500_000
#: Rows of one id and text are dealt apart from this share of a bucket on; bytes of a row besides its text.
HOT_SHARE, ROW_BYTES = 0.125, 64
#: Most tasks of the second pass; with more buckets than that, a task permutes several, one after the other.
MOST_TASKS = 50_000


def shuffle_shards(
    df: DataFrame,
    n_shards: int = 16,
    seed: int = 0,
    bucket_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every row of ``df`` with ``shard`` (0 to ``n_shards - 1``) and ``slot`` (gapless from 0).

    Law: the shards' row counts are at most one apart; with fewer rows than shards the
    last shards are empty.  An empty table gives an empty result.  A null text has no
    bytes.  The bucket comes from the id and the text, so null ids and ties are dealt like
    any other row.  Rows of one id and text that fill over HOT_SHARE of a bucket are dealt
    over all buckets, by all their columns and the number of the copy.  Columns of the
    input named ``shard`` or ``slot`` are replaced, all others come through.  Columns must be of orderable types
    (no maps), as each bucket is put in a fixed order before it is permuted.
    """
    df = df.drop("shard", "slot")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    total = df.agg(F.sum(size.cast("long")).alias("b")).first()["b"] or 0
    n_buckets = max(1, -(-total // bucket_bytes))

    # all columns in one, so that none of them clashes with those of this function
    whole = F.struct(*quoted(df.columns)).alias("row")
    plain = df.select(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("key"), size.cast("long").alias("bytes"), whole)
    sizes = plain.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("bytes") + ROW_BYTES).alias("b"))
    hot = keep(sizes.where((F.col("n") > 1) & (F.col("b") > bucket_bytes * HOT_SHARE)).select("key"))
    plain = plain.select("key", "row")
    if not hot.isEmpty():
        hot = small(hot)
        # equal rows are counted before they move, and numbered after
        equal = plain.join(hot, "key", "left_semi").groupBy("key", "row").agg(F.count("*").alias("n"))
        dealt = numbered(equal, "n", spread=True).select(F.xxhash64("key", "__copy", "row").alias("key"), "row")
        plain = plain.join(hot, "key", "left_anti").unionByName(dealt)
    # other bits of the key than those that order the rows of a bucket
    bucket = F.pmod(F.shiftrightunsigned(F.xxhash64("key", F.lit(seed + 1)), 8), F.lit(n_buckets))
    scattered = plain.select(bucket.alias("bucket"), F.struct("key", "row").alias("row"))

    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = running(counts, "bucket", "n")
    if n_buckets <= BROADCAST_BUCKETS:
        starts = F.broadcast(starts)

    permuted = (
        scattered.repartition(min(n_buckets, MOST_TASKS), "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .sortWithinPartitions("bucket")  # the permutation depends on the order of the buckets of a task
        .select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("place", "row"))
    )
    at = F.col("before") + F.col("place")
    base = F.expr(f"total div {n_shards}")
    wide = F.expr(f"total % {n_shards} * (total div {n_shards} + 1)")  # rows in the shards that have one more
    shard = F.when(at < wide, F.floor(at / (base + 1))).otherwise(F.expr(f"total % {n_shards}") + F.floor((at - wide) / F.greatest(base, F.lit(1))))
    slot = F.when(at < wide, at % (base + 1)).otherwise((at - wide) % F.greatest(base, F.lit(1)))
    out = [F.col("row.row").getField(c).alias(c) for c in df.columns]
    return permuted.join(starts, "bucket").select(*out, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, each in slot order, as Parquet."""
    sharded.repartition("shard", F.expr("slot div 1000000")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
