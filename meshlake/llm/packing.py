"""Variable-capacity best-fit packing of documents into training sequences.

Documents are dealt by a hash into blocks of bounded size; each block is packed by
itself from (id, length) pairs, so texts never move.  Inside a block, pieces are taken
longest first.  A piece goes into the open bin with the least room that still holds it.
If none does, a bin is opened in the permitted length whose cost per packed word is
least, judged jointly for all lengths by what the pieces still to come would fill.
At the end every bin shrinks to the smallest permitted length that holds its contents.

The cost of a sequence of c positions is ``overhead + c + c * c / attention``: a fixed
part, one that grows with the positions, and that of attending between them.  A long
sequence is dear, a short one wastes its fixed part and fits fewer pieces well, so which
length is least depends on the pieces at hand.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import numbered

#: Permitted sequence lengths, in words (with one end mark for each document).
CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its positions, in positions, and the length at which attention costs as much as all else in them.
OVERHEAD, ATTENTION = 64, 4096
#: Documents of a block, on average, and most tasks, which pack several blocks each where there are more.
BLOCK_DOCS, MOST_TASKS = 4096, 50_000

WORD = r"[^\x20\x09-\x0D]+"
_OUT = "bin long, bin_capacity int, bin_used int, bin_offset int, doc_id long, piece int, piece_start long, piece_length int, n_length long"


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def pack(
    docs: DataFrame,
    length: Column | None = None,
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: float = OVERHEAD,
    attention: float = ATTENTION,
    block_docs: int = BLOCK_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: its document, its span, and its bin with capacity, use and offset.

    ``length`` defaults to the words of the text plus one end mark, so a null or empty
    text has length 1 and no document is lost.  A document longer than the largest
    capacity is cut into pieces of that capacity and one rest; ``piece_start`` counts
    from 0 in the document.  Repeated rows are packed like different ones.  A null id
    stays null.  An empty table gives an empty result.  Bin numbers are unique, not dense.
    """
    caps = tuple(sorted(capacities))
    length = word_count(text_col) + 1 if length is None else length
    items = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.cast("long").alias("n"))
    n_blocks = max(1, -(-docs.select(F.lit(1)).count() // block_docs))
    # rows of one id (or none) and one length are alike here: they are counted, and their copies dealt by number
    items = numbered(items.groupBy("doc_id", "n").agg(F.count("*").alias("m")), "m")
    salted = F.when(F.col("__copy") == 0, F.xxhash64("doc_id", "n")).otherwise(F.xxhash64("doc_id", "n", "__copy"))
    block = F.pmod(salted, F.lit(n_blocks)).cast("int")

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "doc_id"], ascending=[False, True], kind="stable")
        return pack_block(int(key[0]), frame["doc_id"], frame["n"].to_numpy(), caps, overhead, attention)

    return items.withColumn("block", block).drop("__copy").repartition(min(n_blocks, MOST_TASKS), "block").groupBy("block").applyInPandas(packed, _OUT)


def cost(cap: float, overhead: float, attention: float) -> float:
    return overhead + cap + cap * cap / attention


def pack_block(block: int, ids: pd.Series, lengths: np.ndarray, caps: tuple[int, ...], overhead: float, attention: float) -> pd.DataFrame:
    """Pack one block; ``lengths`` descend."""
    top = caps[-1]
    # cut into pieces
    count = np.maximum(1, -(-lengths // top))
    doc = np.repeat(np.arange(len(lengths)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(top, np.repeat(lengths, count) - piece * top).astype(np.int64)
    order = np.lexsort((doc, -size))

    left = np.bincount(size, minlength=top + 1)  # pieces not packed yet, by size
    nonempty = sum(1 << int(s) for s in np.flatnonzero(left))
    rooms: dict[int, list[int]] = {}  # open bins by the room they have
    roomy = 0  # bit r: there is a bin with room r
    used: list[int] = []
    offset = np.zeros(len(size), np.int64)
    bin_of = np.zeros(len(size), np.int64)
    bin_cap: list[int] = []

    for i in order:
        s = int(size[i])
        left[s] -= 1
        if not left[s]:
            nonempty &= ~(1 << s)
        fit = roomy >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                roomy &= ~(1 << room)
        else:
            room = _cheapest(s, left, nonempty, caps, overhead, attention)
            b = len(used)
            used.append(0)
            bin_cap.append(room)
        bin_of[i], offset[i] = b, used[b]
        used[b] += s
        room -= s
        rooms.setdefault(room, []).append(b)
        roomy |= 1 << room
    roomed = np.array(used, np.int64)
    final = np.array([caps[bisect_left(caps, int(u))] for u in roomed], np.int32)  # downsized to the contents
    return pd.DataFrame(
        {
            "bin": block * (1 << 32) + bin_of,
            "bin_capacity": final[bin_of],
            "bin_used": roomed[bin_of].astype(np.int32),
            "bin_offset": offset.astype(np.int32),
            "doc_id": ids.to_numpy()[doc] if not ids.isna().any() else pd.array(ids.iloc[doc], dtype="Int64"),
            "piece": piece.astype(np.int32),
            "piece_start": piece * top,
            "piece_length": size.astype(np.int32),
            "n_length": lengths[doc],
        }
    )


def _cheapest(s: int, left: np.ndarray, nonempty: int, caps: tuple[int, ...], overhead: float, attention: float) -> int:
    """The capacity with the least cost per position filled, if best-filled from what is left."""
    best, best_cost = caps[-1], float("inf")
    for cap in caps[bisect_left(caps, s) :]:
        filled, room, taken = s, cap - s, {}
        have = nonempty & ((1 << (room + 1)) - 1)
        while have:
            size = have.bit_length() - 1
            if size == 0:
                break
            n = min(room // size, int(left[size]) - taken.get(size, 0))
            filled += n * size
            room -= n * size
            have &= (1 << min(size, room + 1)) - 1
        a_position = cost(cap, overhead, attention) / filled
        if a_position < best_cost:
            best, best_cost = cap, a_position
    return best


def assemble(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences as texts: ``bin``, ``bin_capacity`` and the words of its pieces in bin order.

    Only for lengths counted in words.  A bin holds at most its capacity, so the
    gathered pieces are bounded.  Ids must be unique, since pieces find texts by them.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(f"({WORD})"), 1).alias("words"))
    part = F.array_join(F.slice("words", (F.col("piece_start") + 1).cast("int"), F.col("piece_length")), " ")
    return (
        pieces.join(texts, "doc_id")
        .select("bin", "bin_capacity", "bin_used", F.struct("bin_offset", part.alias("text")).alias("part"))
        .groupBy("bin", "bin_capacity", "bin_used")
        .agg(F.sort_array(F.collect_list("part")).alias("parts"))
        .select("bin", "bin_capacity", "bin_used", F.col("parts.text").alias("texts"))
    )
