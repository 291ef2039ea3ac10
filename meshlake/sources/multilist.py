"""Multi-lists: many lists of row positions in one file.

The file is a sequence of words, numbers of 8 or 4 bytes or tokens of text: the number of
lists, then for each list its size and its ids.  Either count may be left out where it is
given instead, and a file of one list has neither.

Where list k begins follows from the sizes of all lists before it.  So reading has two
steps.  The first finds where each list begins, by a scan that reads sizes and skips ids,
and writes the places as a table.  The second deals out the file by ranges of words and
not by lists: a list that is most of the file is read by many tasks, and many short lists
by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROW, kept, new_folder, prefix_sums, with_row
from . import onefile
from .binary import read_rows

#: Words that a task reads, and words that the scan of the sizes reads at once.
TASK_WORDS, SCAN_WORDS = 1 << 20, 1 << 12
LISTS = "list_id long, pos long, row_id long"


class Words:
    """The words of a binary file, or of the files that a text's tokens were written to."""

    def __init__(self, path: str, dtype: str, n: int, each: int | None = None):
        self.path, self.dtype, self.n, self.each = path, np.dtype(f"<{dtype}"), n, each

    def read(self, start: int, n: int) -> np.ndarray:
        """``n`` words from ``start`` on, fewer at the end."""
        n, out = min(n, self.n - start), []
        while n > 0:
            part = n if self.each is None else min(n, self.each - start % self.each)
            path, at = (self.path, start) if self.each is None else (f"{self.path}/words-{start // self.each:09d}", start % self.each)
            fs, name = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(name) as f:
                f.seek(at * self.dtype.itemsize)
                out.append(np.frombuffer(f.read(part * self.dtype.itemsize), self.dtype))
            if len(out[-1]) < part:
                raise ValueError(f"{path} ends before its words do")
            start, n = start + part, n - part
        found = np.concatenate(out) if out else np.zeros(0, self.dtype)
        if found.dtype.kind == "u" and len(found) and found.max() > np.uint64(np.iinfo(np.int64).max):
            raise ValueError(f"{self.path} has a number that is no row position")
        return found.astype(np.int64)


def list_places(words: Words, n_lists: int | None, n_each: int | None) -> Iterator[tuple[int, int, int]]:
    """``(list_id, begin, size)`` of each list, ids from 1 on; ``begin`` is the word of its first id.

    A list that does not fit in the file is an error; words after the last one are none of them.
    """
    at, block, block_at = 0, np.zeros(0, np.int64), 0

    def word(k: int) -> int:
        nonlocal block, block_at
        if k >= words.n:
            raise ValueError(f"{words.path} has {words.n} words and needs more")
        if not block_at <= k < block_at + len(block):
            block, block_at = words.read(k, SCAN_WORDS), k
        return int(block[k - block_at])

    if n_lists is None:
        n_lists, at = word(0), 1
    for list_id in range(1, n_lists + 1):
        size = n_each
        if size is None:
            size, at = word(at), at + 1
        if size < 0 or at + size > words.n:
            raise ValueError(f"list {list_id} of {words.path} has {size} ids and {words.n - at} words are left")
        yield list_id, at, size
        at += size


def read_multilist(spark: SparkSession, path: str, dtype: str = "u8", n_lists: int | None = None, n_each: int | None = None, one: bool = False, task_words: int = TASK_WORDS) -> DataFrame:
    """``list_id`` (from 1 on), ``pos`` (from 0 on in each list) and ``row_id``.

    ``dtype`` is ``u8``, ``i4`` or ``ascii``.  ``n_lists``: the file does not begin with the
    number of lists.  ``n_each`` (with ``n_lists``): all lists have so many ids, and no
    sizes stand before them.  ``one``: the file is one list and nothing else.  Empty lists
    have no rows; repeated ids stay.

    The places of the lists are kept as a table in the shared folder; the scan for them is
    one task with a small read for each list, or for each SCAN_WORDS words where lists are
    short, and holds one block.  Without sizes in the file there is no scan.  A task of the
    second step holds ``task_words`` words.
    """
    if n_each is not None and n_lists is None:
        raise ValueError("lists of one size need their number")
    words = _text_words(spark, path, task_words) if dtype == "ascii" else _binary_words(path, dtype)
    if one:
        n_lists, n_each = 1, words.n
    if n_lists is not None and n_each is not None:
        if n_lists * n_each > words.n:
            raise ValueError(f"{path} has {words.n} words, fewer than {n_lists} lists of {n_each}")
        index = spark.range(1, n_lists + 1).select(F.col("id").alias("list_id"), ((F.col("id") - 1) * n_each).alias("begin"), F.lit(n_each).cast("long").alias("size"))
    else:

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _ in (k for batch in batches for k in batch.column(0).to_pylist()):
                found: list[tuple[int, int, int]] = []
                for place in list_places(words, n_lists, n_each):
                    found.append(place)
                    if len(found) == 1 << 16:
                        yield _batch(found)
                        found = []
                yield _batch(found)

        index = kept(spark.range(1, numPartitions=1).mapInArrow(scan, "list_id long, begin long, size long"))
    return _pieces(index, words, task_words)


def _batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    table = np.array(found, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(3)], names=["list_id", "begin", "size"])


def _pieces(index: DataFrame, words: Words, task_words: int) -> DataFrame:
    """Cut the lists where ranges of the file end, and read each range once."""
    last = F.expr(f"(begin + size - 1) div {task_words}")
    pieces = index.where("size > 0").withColumn("range", F.explode(F.sequence(F.expr(f"begin div {task_words}"), last)))
    begin = F.greatest(F.col("begin"), F.col("range") * task_words)
    end = F.least(F.col("begin") + F.col("size"), (F.col("range") + 1) * task_words)
    pieces = pieces.select("range", "list_id", (begin - F.col("begin")).alias("first"), begin.alias("at"), (end - begin).alias("n"))

    def read(group: pa.Table) -> pa.Table:
        at, n = group["at"].to_numpy(), group["n"].to_numpy()
        low = int(at.min())
        found = words.read(low, int((at + n).max()) - low)
        before = np.repeat(np.cumsum(n) - n, n)
        step = np.arange(len(before)) - before
        return pa.table({
            "list_id": np.repeat(group["list_id"].to_numpy(), n), "pos": np.repeat(group["first"].to_numpy(), n) + step, "row_id": found[np.repeat(at - low, n) + step],
        })

    return pieces.groupBy("range").applyInArrow(read, LISTS)


def _binary_words(path: str, dtype: str) -> Words:
    fs, at = pafs.FileSystem.from_uri(path)
    size, width = fs.get_file_info(at).size, np.dtype(dtype).itemsize
    if size is None or size % width:
        raise ValueError(f"{path} is not a file of whole numbers")
    return Words(path, dtype, size // width)


def _text_words(spark: SparkSession, path: str, each: int) -> Words:
    """The tokens of a text as files of ``each`` numbers in the shared folder: a token's place is then arithmetic."""
    folder = new_folder(spark)
    tokens = read_rows(spark, path, "ascii")

    def write(group: pa.Table) -> pa.Table:
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        group = group.sort_by("pos")
        with fs.open_output_stream(f"{at}/words-{group['part'][0].as_py():09d}") as f:
            f.write(group["row_id"].to_numpy().astype("<i8").tobytes())
        return pa.table({"n": pa.array([group.num_rows], pa.int64())})

    made = tokens.withColumn("part", F.expr(f"pos div {each}")).groupBy("part").applyInArrow(write, "n long")
    return Words(folder, "i8", made.agg(F.sum("n")).first()[0] or 0, each)


def placed(lists: DataFrame, counted: bool = True, sized: bool = True, n_lists: int | None = None) -> tuple[DataFrame, int, int]:
    """``word`` and ``value`` of all lists, the number of lists and of words; ``lists`` has ``list_id`` (from 1 on), ``pos`` and ``row_id``.

    Numbers up to the greatest one, or up to ``n_lists``, that have no rows are empty lists.
    ``pos`` says the order in a list, and need not be dense; of equal positions the lesser id
    is first.  An id's word follows from its place among all ids and the number of its list;
    a size's from the sizes before it.
    """
    spark = lists.sparkSession
    sizes = kept(lists.groupBy("list_id").agg(F.count("*").alias("size")))
    found = sizes.agg(F.min("list_id").alias("least"), F.max("list_id").alias("most"), F.sum("size").alias("ids"), F.count_if(F.col("list_id").isNull()).alias("nulls")).first()
    total = n_lists if n_lists is not None else found["most"] or 0
    if found["nulls"] or (found["least"] is not None and found["least"] < 1) or (found["most"] or 0) > total:
        raise ValueError(f"lists are numbered from 1 to {total}")
    ranked = with_row(lists.select(F.col("list_id").cast("long").alias("list_id"), "pos", "row_id"), "list_id", "pos", "row_id")
    words = ranked.select((F.col(ROW) + int(counted) + F.col("list_id") * int(sized)).alias("word"), F.col("row_id").cast("long").alias("value"))
    if sized:
        every = spark.range(1, total + 1).select(F.col("id").alias("list_id")).join(sizes, "list_id", "left").select("list_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
        places = every.join(prefix_sums(every, "list_id", "size"), "list_id")
        words = words.unionByName(places.select((F.col("before") + F.col("list_id") - 1 + int(counted)).alias("word"), F.col("size").alias("value")))
    if counted:
        words = words.unionByName(spark.createDataFrame([(0, total)], "word long, value long"))
    return words, total, (found["ids"] or 0) + int(counted) + total * int(sized)


def write_multilist(lists: DataFrame, path: str, dtype: str = "u8", counted: bool = True, sized: bool = True, n_lists: int | None = None) -> int:
    """One file of ``u8`` or ``i4`` numbers with all lists (see ``placed``); returns the number of lists.

    ``counted``: the number of lists stands first; ``sized``: each list's size stands before
    it.  Tasks write their words at their places, see ``onefile``; only counts come to the
    driver.  A null id or one that the type does not hold is an error.
    """
    rows, total, n_words = placed(lists, counted, sized, n_lists)
    kind = np.dtype(f"<{dtype}")
    made = onefile.begun(path, n_words * kind.itemsize)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with onefile.Places(made) as file:
            for b in batches:
                if b.column(1).null_count:
                    raise ValueError("a list has a null id")
                at, value = b.column(0).to_numpy(), b.column(1).to_numpy()
                if len(value) and (value.min() < 0 or value.max() > np.iinfo(kind).max):
                    raise ValueError(f"{dtype} does not hold all numbers")
                value = value.astype(kind)
                for k in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
                    if len(k):
                        file.put(int(at[k[0]]) * kind.itemsize, value[k[0] : k[-1] + 1].tobytes())
                n += len(at)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    try:
        n = rows.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0
        if n != n_words:
            raise ValueError(f"{n} words were written to {n_words} places")
        onefile.finished(made, path)
    finally:
        onefile.dropped(made)
    return total


def write_multilist_text(lists: DataFrame, folder: str, counted: bool = True, sized: bool = True, n_lists: int | None = None) -> tuple[int, list[str]]:
    """The same as text, a word in a line, in parts; returns the number of lists, and the parts in their order.

    ``read_multilist`` takes the folder as one text.
    """
    words, total, _ = placed(lists, counted, sized, n_lists)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        file = f"{at}/part-{TaskContext.get().partitionId():06d}.txt"
        with fs.open_output_stream(file) as f:
            for b in batches:
                f.write("".join(f"{x}\n" for x in b.column(1).to_pylist()).encode())
        yield pa.RecordBatch.from_pydict({"file": [folder[: len(folder) - len(at)] + file]})

    written = words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(write, "file string").collect()
    return total, sorted(r["file"] for r in written)
