"""Benchmark decontamination: documents that hold a window close to a benchmark item.

Every window of a document with as many words as an item is compared with it by the
weighted Jaccard similarity of their 5-word shingles (weights: how often each stands in
the window or item).  The steps, per batch of documents:

1. Every item-sized window gets a 64-bit SimHash.  (A window without any shingle of any
   item has similarity 0 to all of them, so it gets none; which item it may be near is
   left to the next step.)
2. A multi-index brings windows and items together.  A fingerprint is cut into BLOCKS
   blocks of 16 bits; if two differ in at most RADIUS bits, one of their blocks differs
   in at most RADIUS // BLOCKS.  So each item stands in the tables at all values that near
   to its own blocks, and a window looks up its own four values: that finds every item
   within the radius.
3. The candidates are verified by the exact similarity.

At similarity 0.8 the two fingerprints differ in about 10 of 64 bits (standard deviation
below 3), which leaves 9 bits to the radius.

The items are a stated query set.  They go to the tasks in blocks of at most
``block_words`` words, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fresh, identity, keep, small
from ._words import Words, mix64, positions, slices

SHINGLE, SIMILARITY = 5, 0.8
#: Most differing bits of fingerprints that are looked up; blocks of a fingerprint in the index, and their bits.
RADIUS, BLOCKS, BLOCK_BITS = 19, 4, 16
#: Words of items in a block: with items of about 40 words, the index takes up to 130 MB of a task's memory.
BLOCK_WORDS = 150_000

OUT = "item_id long, similarity double, window_start long, window_words long"


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on."""
    out = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        out = mix64(out + words[k : len(words) - width + 1 + k])
    return out


def simhash(shingles: np.ndarray, starts: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Fingerprints of the windows of ``size`` shingles at each (ascending) start: the sign of the sum of all their bits."""
    stops = starts + size
    # the shingles of these windows only, window after window where they are apart
    need = np.zeros(len(shingles) + 1, np.int64)
    np.add.at(need, starts, 1)
    np.add.at(need, stops, -1)
    used = np.flatnonzero(np.cumsum(need[:-1]) > 0)
    bits = np.unpackbits(shingles[used].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
    run = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    a, b = np.searchsorted(used, starts), np.searchsorted(used, stops)
    return np.packbits((run[b] - run[a]) > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the lesser weights over the sum of the greater, for two lists of shingles."""
    u, n = np.unique(a, return_counts=True)
    v, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


def near_values(radius: int) -> np.ndarray:
    """All values of a block with at most ``radius`` bits; by exclusive or with a value, all within the radius of it."""
    every = np.arange(1 << BLOCK_BITS, dtype=np.uint64)
    return every[np.bitwise_count(every) <= radius].astype(np.int64)


class MultiIndex:
    """Fingerprints that a lookup finds within RADIUS, up to 64 of them in one table of bit masks."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        near = near_values(RADIUS // BLOCKS)
        self.tables = []
        for a in range(0, len(prints), 64):
            part = prints[a : a + 64]
            kind = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if bits >= len(part))
            masks = np.zeros((BLOCKS, 1 << BLOCK_BITS), kind)
            for k, p in enumerate(part):
                for j in range(BLOCKS):
                    masks[j, near ^ int(block(p, j))] |= kind(1 << k)
            self.tables.append(masks)

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(i, k)``: all pairs of a given fingerprint and one of the index within the radius."""
        found = []
        for a, masks in enumerate(self.tables):
            hit = masks[0, block(prints, 0)]
            for j in range(1, BLOCKS):
                hit |= masks[j, block(prints, j)]
            for k in range(min(64, len(self.prints) - 64 * a)):
                i = np.flatnonzero(hit & hit.dtype.type(1 << k))
                i = i[np.bitwise_count(prints[i] ^ self.prints[64 * a + k]) <= RADIUS]
                found.append((i, np.full(len(i), 64 * a + k)))
        return tuple(np.concatenate(x) for x in zip(*found))


def block(prints: np.ndarray, j: int) -> np.ndarray:
    return ((prints >> np.uint64(BLOCK_BITS * j)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


class Items:
    """A block of benchmark items: their shingles, and a multi-index for each size."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = Words(pa.array(texts, pa.string()), lower=True)
        hashes = words.hashes()
        self.ids, self.n, self.shingles = [], [], []
        for i, item in enumerate(ids):
            own = hashes[words.first[i] : words.first[i + 1]]
            if len(own):  # an item without words is in no document
                self.ids.append(item)
                self.n.append(len(own))
                self.shingles.append(rolled(own, min(SHINGLE, len(own))))
        self.prints = np.array([simhash(x, np.zeros(1, np.int64), len(x))[0] for x in self.shingles], np.uint64)
        sizes = np.array(self.n, np.int64)
        self.of_size = {n: np.flatnonzero(sizes == n) for n in sorted(set(self.n))}
        self.widths = sorted({min(SHINGLE, n) for n in self.n})
        # all shingles of items of one width, and the sizes of the items that have them
        self.known, self.sizes = {}, {}
        for width in self.widths:
            pairs = sorted({(s, n) for n, x in zip(self.n, self.shingles) if min(SHINGLE, n) == width for s in x.tolist()})
            self.known[width] = np.array([s for s, _ in pairs], np.uint64)
            self.sizes[width] = np.array([n for _, n in pairs], np.int64)
        self._index: dict[int, MultiIndex] = {}

    def candidates(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``(window, item)`` of all fingerprints within the radius, for windows of ``n`` words."""
        at = self.of_size[n]
        if n not in self._index:  # made where it is used, so that only the fingerprints travel
            self._index[n] = MultiIndex(self.prints[at])
        window, k = self._index[n].lookup(prints)
        return window, at[k]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_index"}

    def __setstate__(self, state):
        self.__dict__.update(state, _index={})


def _windows_around(pos: np.ndarray, of: np.ndarray, first: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(start, size)`` of the windows of ``n`` words that hold one of the shingles; a text shorter than that is one window."""
    text = of[pos]
    size = np.minimum(n, first[text + 1] - first[text])
    low = np.maximum(first[text], pos + width - size)
    high = np.minimum(pos, first[text + 1] - size)
    ok = (size >= width) & (low <= high)
    count = (high - low + 1)[ok]
    starts = np.repeat(low[ok], count) + positions(count)
    starts, once = np.unique(starts, return_index=True)
    return starts, np.repeat(size[ok], count)[once]


def search(column: pa.Array, items: Items) -> list[tuple[int, int, float, int, int]]:
    """``(text, item, similarity, start, words)``, the best (then first) window for each text and item."""
    words = Words(column, lower=True)
    hashes, of = words.hashes(), words.text_of()
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for width in items.widths:
        if len(hashes) < width:
            continue
        rolls = rolled(hashes, width)
        inside = of[width - 1 :] == of[: len(of) - width + 1]
        known, sizes = items.known[width], items.sizes[width]
        # a small table of 2^20 bits first, then the exact list
        low = np.zeros(1 << 20, bool)
        low[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        at = np.flatnonzero(low[(rolls & np.uint64((1 << 20) - 1)).astype(np.int64)] & inside)
        left, right = np.searchsorted(known, rolls[at]), np.searchsorted(known, rolls[at], side="right")
        count = right - left
        pos = np.repeat(at, count)
        n_of = sizes[np.repeat(left, count) + positions(count)]
        for n in np.unique(n_of).tolist():
            starts, size = _windows_around(pos[n_of == n], of, words.first, n, width)
            for lo in range(0, len(starts), 1 << 14):
                some, sized = starts[lo : lo + (1 << 14)], size[lo : lo + (1 << 14)]
                prints = simhash(rolls, some, sized - width + 1)
                for w, k in zip(*items.candidates(prints, n)):
                    s, own = int(some[w]), int(sized[w])
                    sim = weighted_similarity(rolls[s : s + own - width + 1], items.shingles[k])
                    text = int(of[s])
                    key, start = (text, int(k)), s - int(words.first[text])
                    if sim >= SIMILARITY and (key not in best or (-sim, start) < (-best[key][0], best[key][1])):
                        best[key] = (sim, start, own)
    return [(t, items.ids[k], *x) for (t, k), x in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and item it holds: similarity and place of the best window, the first of equals.

    Words are lower-cased in A-Z.  An item of fewer than five words has its whole sequence
    as its only shingle; null or empty items and texts match nothing.  Equal items each
    get a row, and so do equal documents; null ids are kept.  Other columns are not read.
    An empty benchmark or table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _found(rows, benchmark, block_words, item_col, item_text_col)


def _found(rows: DataFrame, benchmark: DataFrame, block_words: int, item_col: str, item_text_col: str) -> DataFrame:
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    out, ids, texts, held = [], [], [], 0
    for r in items.toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        held += len(r["text"].split())
        if held >= block_words:
            out.append(_pass(rows, Items(ids, texts)))
            ids, texts, held = [], [], 0
    if ids or not out:
        out.append(_pass(rows, Items(ids, texts)))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _pass(rows: DataFrame, items: Items) -> DataFrame:
    kind = rows.schema["doc_id"].dataType.simpleString()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "text")):
            found = search(b.column("text"), items)
            doc = b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([doc, *(pa.array([f[k + 1] for f in found], t) for k, t in enumerate(kinds))], names=["doc_id", "item_id", "similarity", "window_start", "window_words"])

    return rows.mapInArrow(searched, f"doc_id {kind}, {OUT}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    Rows equal in id and text go or stay together.  All columns come through, whatever
    their names.  An empty benchmark leaves all documents.
    """
    mark = fresh(docs, "__mark")
    marked = docs.withColumn(mark, identity(F.col(id_col), F.col(text_col)))
    bad = _found(marked.select(F.col(mark).alias("doc_id"), F.col(text_col).alias("text")), benchmark, BLOCK_WORDS, item_col, item_text_col)
    return marked.join(small(keep(bad.select(F.col("doc_id").alias(mark)).distinct())), mark, "left_anti").drop(mark)
