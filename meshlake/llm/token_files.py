"""Token ids in binary files: Simple-8b word-aligned coding with escapes and block offsets.

A file holds whole documents in ascending id order::

    magic      8 bytes  b"S8BTOK01"
    n_docs     u64
    n_ids      u64
    n_words    u64      64-bit code words
    n_blocks   u64
    doc_ids    i64 * n_docs      (a null id: the lowest value, with its bit in ``nulls``)
    nulls      u8  * n_docs
    lengths    u64 * n_docs      ids of each document
    block_at   u64 * n_blocks    first code word of each block of BLOCK ids
    words      u64 * n_words

All numbers are little-endian.  The top four bits of a code word select how many ids it
holds and in how many bits each; selector 15 is an escape: the next word holds one raw
64-bit id.  Blocks start on a word, so all blocks of a file are coded and decoded at
once: step k handles the k-th word of every block.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import keep, running, shared_folder
from ._words import Words, coded, slices, text_bytes

#: Fixed values of the code: ids in a word and bits of each, by selector; the first two are runs of zeros.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30])
#: Selector 15 would be one id of 60 bits; here it marks a raw word, for ids of any size.
ESCAPE = 15
BLOCK = 256
_LEVELS = np.unique(BITS)
MAGIC = b"S8BTOK01"
#: A file is closed when it has this many ids, so that reading one takes bounded memory.
FILE_IDS = 1_000_000


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(words, block_at)`` for uint64 ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    width = np.zeros(n, np.int8)
    for b in _LEVELS:
        width += ids >= np.uint64(1 << b)  # the place in _LEVELS of the bits it needs
    # the selector of a word that would start at each id: the fullest whose ids all fit
    selector = np.full(n, ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):
        level = int(np.searchsorted(_LEVELS, BITS[s]))
        at = np.flatnonzero(width <= level)
        if not len(at):
            break  # and for fewer bits there are none either
        # the end of the run of ids that fit, or of the block
        ends = np.flatnonzero(np.append(np.diff(at) > 1, True))
        stop = np.repeat(at[ends] + 1, np.diff(ends, prepend=-1))
        end = np.minimum((at // BLOCK + 1) * BLOCK, n)
        stop = np.minimum(stop, end)
        selector[at[(stop - at >= COUNTS[s]) | (stop == end)]] = s  # the block's rest may fill a word in part
    taken = np.append(np.minimum(COUNTS, 240), 1)
    # all blocks step by step
    pos = np.arange(n_blocks) * BLOCK
    last = np.minimum(pos + BLOCK, n)
    starts, blocks, steps = [], [], []
    live, step = np.arange(n_blocks), 0
    while len(live):
        p = pos[live]
        starts.append(p)
        blocks.append(live)
        steps.append(np.full(len(live), step))
        pos[live] = p + taken[selector[p]]
        live = live[pos[live] < last[live]]
        step += 1
    start, block, step = np.concatenate(starts), np.concatenate(blocks), np.concatenate(steps)
    order = np.lexsort((step, block))
    start, block = start[order], block[order]
    chosen = selector[start]
    size = np.where(chosen == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(chosen):
        here = chosen == s
        w, p = place[here], start[here]
        words[w] = np.uint64(int(s) << 60)
        if s == ESCAPE:
            words[w + 1] = ids[p]
        elif BITS[s]:
            stop = last[block[here]]
            for k in range(COUNTS[s]):
                value = np.where(p + k < stop, ids[np.minimum(p + k, n - 1)], np.uint64(0))
                words[w] |= value << np.uint64(k * BITS[s])
    return words, place[np.searchsorted(block, np.arange(n_blocks))].astype(np.uint64)


def decode(words: np.ndarray, block_at: np.ndarray, n: int) -> np.ndarray:
    """The ids, all blocks at once."""
    out = np.zeros(n, np.uint64)
    n_blocks = len(block_at)
    at = block_at.astype(np.int64)
    pos = np.arange(n_blocks) * BLOCK
    last = np.minimum(pos + BLOCK, n)
    live = np.arange(n_blocks)
    while len(live):
        word = words[at[live]]
        chosen = (word >> np.uint64(60)).astype(np.int64)
        for s in np.unique(chosen):
            b = live[chosen == s]
            if s == ESCAPE:
                out[pos[b]] = words[at[b] + 1]
                at[b] += 2
                pos[b] += 1
                continue
            w = word[chosen == s]
            if BITS[s]:
                mask = np.uint64((1 << int(BITS[s])) - 1)
                for k in range(COUNTS[s]):
                    inside = pos[b] + k < last[b]
                    out[pos[b][inside] + k] = (w[inside] >> np.uint64(k * BITS[s])) & mask
            at[b] += 1
            pos[b] += COUNTS[s]
        live = live[pos[live] < last[live]]
    return out


def pack_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, block_at = encode(ids)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    docs = np.array([-(2**63) if d is None else d for d in doc_ids], "<i8")
    head = np.array([len(docs), len(ids), len(words), len(block_at)], "<u8")
    return b"".join([MAGIC, head.tobytes(), docs.tobytes(), nulls.tobytes(), lengths.astype("<u8").tobytes(), block_at.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def unpack_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """``(doc_ids, lengths, ids)``; raises ValueError where the file is not whole."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, n_words, n_blocks = (int(x) for x in np.frombuffer(raw, "<u8", 4, 8))
    at = 40
    docs = np.frombuffer(raw, "<i8", n_docs, at)
    nulls = np.frombuffer(raw, "u1", n_docs, at := at + 8 * n_docs)
    lengths = np.frombuffer(raw, "<u8", n_docs, at := at + n_docs)
    block_at = np.frombuffer(raw, "<u8", n_blocks, at := at + 8 * n_docs)
    words = np.frombuffer(raw, "<u8", n_words, at := at + 8 * n_blocks)
    if len(raw) != at + 8 * n_words:
        raise ValueError("a token file of the wrong length")
    return [None if z else int(d) for d, z in zip(docs, nulls)], lengths.astype(np.int64), decode(words, block_at, n_ids)


#: Kinds of bytes: white space, letter, digit, other ASCII, and those that only the tokenizer can judge.
_KIND = np.full(256, 4, np.uint8)
_KIND[:128] = 3
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[97:123] = _KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[ord("'")] = 4
_KIND[[*range(9), *range(14, 32), 127]] = 4


def pre_tokens(words: Words, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, first)`` of parts that the tokenizer encodes apart: runs of ASCII letters, single digits and
    runs of other ASCII marks; a word with an apostrophe or a byte beyond ASCII, or one of ``whole``, stays whole.
    """
    kind = _KIND[words.data]
    hard = np.zeros(len(kind) + 1, np.int32)
    np.cumsum(kind == 4, out=hard[1:])
    plain = hard[words.end] == hard[words.start]
    plain[whole] = False
    edge = np.zeros(len(kind) + 1, np.int8)
    edge[words.start[plain]] += 1
    edge[words.end[plain]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    cut = np.zeros(len(kind), bool)
    cut[1:] = inside[1:] & inside[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind[1:] > 0) & (kind[:-1] > 0)
    cut[words.start] = False  # two words of one text never touch; those of two texts may, and begin there anyway
    cuts = np.flatnonzero(cut)
    start = np.sort(np.concatenate([words.start, cuts]), kind="stable")
    end = np.sort(np.concatenate([words.end, cuts]), kind="stable")
    return start, end, np.searchsorted(start, words.offsets)


class WordTokenizer:
    """Ids of texts for a tokenizer that lower-cases and never joins over ASCII white space or the edges of ``pre_tokens``.

    Each distinct part of a batch is encoded once; a bounded cache keeps parts over batches.
    The strings of special tokens are what the tokenizer takes them for; words that hold
    one, in upper or lower case, are encoded as they stand.
    """

    MOST = 800_000
    AT_ONCE = 10_000
    #: Parts encoded in one text, and what stands between those that may hold several runs: a control character, which no printable part has.
    JOIN, GLUE = 256, "\x01"

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.shortest = min(map(len, self.special), default=1 << 30)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ends = np.array([i for t, i in vocabulary.items() if t.endswith("</w>")], np.int64)
        glue = self.encode([self.GLUE])[0]
        most = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.word_ends, self.glue_ends = np.zeros((2, most + 1), bool)
        self.word_ends[ends] = True
        if not len(ends) or len(glue) != 1:  # no such marks: every part is encoded alone
            self.word_ends = np.zeros(0, bool)
        else:
            self.glue_ends[glue] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.ids = np.zeros(1, np.uint32)  # the first one is the end id's place

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for a in range(0, len(texts), self.AT_ONCE) for x in self.tokenizer.encode_batch_fast(texts[a : a + self.AT_ONCE], add_special_tokens=False)]

    def together(self, parts: list[str], glue: str, last: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray] | None:
        """``(sizes, ids)`` of parts encoded JOIN at a time; each ends with an id in ``last``, of which the last ``drop`` are the glue's."""
        rows = self.encode([glue.join(parts[a : a + self.JOIN]) + glue for a in range(0, len(parts), self.JOIN)])
        ids = np.fromiter(chain.from_iterable(rows), np.uint32, sum(map(len, rows)))
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) != len(parts):
            return None
        stay = np.ones(len(ids), bool)
        if drop:
            stay[ends - 1] = False
        return np.diff(ends, prepend=0) - drop, ids[stay]

    def learn(self, parts: list[str]) -> None:
        """Encode new parts: many in one text where the ids tell where each ends, else one by one."""
        plain, glued, alone = [], [], []
        for k, p in enumerate(parts):
            # a printable ASCII part without apostrophe is one run, so only its last id ends a word
            odd = not p.isprintable() or not len(self.word_ends) or len(p) >= self.shortest and any(x in p.lower() for x in self.special)
            group = alone if odd else plain if p.isascii() and "'" not in p else glued
            group.append(k)
        sizes, starts = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
        new, total = [self.ids], len(self.ids)
        for group, glue, last, drop in ((plain, " ", self.word_ends, 0), (glued, f" {self.GLUE} ", self.glue_ends, 1), (alone, None, None, 0)):
            found = self.together([parts[k] for k in group], glue, last, drop) if glue and group else None
            if found is None:
                rows = self.encode([parts[k] for k in group])
                found = np.fromiter(map(len, rows), np.int32, len(rows)), np.fromiter(chain.from_iterable(rows), np.uint32)
            sizes[group] = found[0]
            starts[group] = total + np.cumsum(found[0]) - found[0]
            new.append(found[1])
            total += len(found[1])
        self.ids = np.concatenate(new)
        self.sizes, self.starts = np.concatenate([self.sizes, sizes]), np.concatenate([self.starts, starts])
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))

    def special_words(self, words: Words, data: np.ndarray) -> np.ndarray:
        """The words with the string of a special token; in ``words.data`` they get back their own letters from ``data``."""
        lower, found = words.data.tobytes(), set()
        for x in self.special:
            at = lower.find(x.encode())
            while at >= 0:
                found.add(int(np.searchsorted(words.start, at, side="right")) - 1)
                at = lower.find(x.encode(), at + 1)
        for w in found:
            words.data[words.start[w] : words.end[w]] = data[words.start[w] : words.end[w]]
        return np.array(sorted(found), np.int64)

    def __call__(self, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """``(lengths, ids)`` of all texts; ``end_id`` follows each text."""
        words = Words(column, lower=True)
        begin, stop, first_of = pre_tokens(words, self.special_words(words, text_bytes(column)[0]))
        codes, distinct = coded(words.data, begin, stop)
        parts = distinct.cast(pa.large_string()).to_pylist()
        if len(self.known) > self.MOST:
            self.clear()
        new = [p for p in parts if p not in self.known]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        size, start = self.sizes[at][codes], self.starts[at][codes]
        lengths = np.diff(np.concatenate([[0], np.cumsum(size)])[first_of])
        if end_id is not None:  # one more part behind each text
            self.ids[0] = end_id
            size, start = np.insert(size, first_of[1:], 1), np.insert(start, first_of[1:], 0)
            lengths += 1
        total = np.cumsum(size)
        n = int(total[-1]) if len(total) else 0
        return lengths, self.ids[np.repeat(start - total + size, size) + np.arange(n)]


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: Callable[[], Callable[[pa.Array, int | None], tuple[np.ndarray, np.ndarray]]],
    end_id: int | None = 1,
    partition_bytes: int = 64 << 20,
    file_ids: int = FILE_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all texts in ascending id order (nulls first, ties by text) and return one row per file: its name, the ``part``
    and ``number`` in it, and how much it holds.

    Rows are dealt by ranges of the id and written by their tasks; file names ascend
    with the ids.  A file appears under its name by one rename, and a task that runs
    again writes the same files again, so lost executors leave no broken or double file.
    ``folder`` must be a file system that all executors share.  A null text is empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # the text's hash deals out the rows of one id, should it have very many
    order = ["doc_id", F.xxhash64("text"), "text"]
    ranged = rows.repartitionByRange(max(1, -(-n_bytes // partition_bytes)), "doc_id", F.xxhash64("text")).sortWithinPartitions(*order)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode_texts, number = tokenizer(), 0
        ids, lengths, doc_ids, held = [], [], [], 0
        found: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal ids, lengths, doc_ids, held, number
            name = f"part-{part:06d}-{number:06d}.s8b"
            put(folder, name, pack_file(doc_ids, np.concatenate(lengths), np.concatenate(ids)))
            found.append((name, len(doc_ids), held))
            ids, lengths, doc_ids, held, number = [], [], [], 0, number + 1

        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                n, got = encode_texts(b.column("text"), end_id)
                ids.append(got)
                lengths.append(n)
                doc_ids += b.column("doc_id").to_pylist()
                held += len(got)
                if held >= file_ids:
                    close()
        if doc_ids:
            close()
        n = len(found)
        columns = [pa.array([f[0] for f in found], pa.string()), pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int64()), *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2))]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "part", "number", "n_docs", "n_ids"])

    return ranged.mapInArrow(written, "file string, part long, number long, n_docs long, n_ids long")


def put(folder: str, name: str, raw: bytes) -> None:
    """Write a file whole or not at all."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    hidden = posixpath.join(path, f".{name}.{uuid.uuid4().hex}")
    with fs.open_output_stream(hidden) as out:
        out.write(raw)
    try:
        fs.move(hidden, posixpath.join(path, name))
    except OSError:  # a store whose rename does not replace: the same file is there from another attempt
        if fs.get_file_info(posixpath.join(path, name)).type != pafs.FileType.File:
            raise
        fs.delete_file(hidden)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file, in name order of files: ``file``, ``documents`` as an array of (doc_id, n_tokens, ids_crc32, ids_at)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.s8b").load(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                doc_ids, lengths, ids = unpack_file(raw.as_py())
                small = ids.astype("<u4")
                if len(ids) and ids.max() >= 2**32:
                    raise ValueError("an id over 32 bits")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(small[e - n : e]) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([posixpath.basename(path)] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["file", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    return files.select("path", "content").mapInArrow(read, "file string, doc_id long, at long, n_tokens long, ids_crc32 long")


def document_table(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` with the tokenizer at ``path`` and return, read from the files, doc_id, start, n_tokens and ids_crc32.

    ``start`` counts the ids of all documents before; the sums before each file come from
    one row per file.  An empty table writes no file and gives an empty result.
    """
    folder = shared_folder(spark) + "/tokens"
    files = write_token_files(docs, folder, lambda: WordTokenizer(path), end_id)
    sizes = keep(files)  # runs the writing once
    # sums within a part's files, and over the parts
    parts = running(sizes.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "n")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    starts = sizes.withColumn("inside", inside).join(parts, "part").select("file", (F.col("before") + F.col("inside")).alias("before"))
    if sizes.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder).join(starts, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
