"""Substring dedup by recompression.

Rounds of recompression rename token sequences until windows are a symbol or two wide.
A round first names maximal runs of one symbol, then all pairs of a "left" and a "right"
symbol (a coin that the symbol's name decides).  A name is a hash of what it stands for,
so all tasks give equal content equal names without asking each other.

Inside two equal substrings the rounds do the same, but for symbols at the edges, which
may go together with what stands outside.  ``anchors`` follows for each window which
symbols no neighbour can change, up to the last round in which one is left.  The first
of those is the window's anchor: equal windows have equal anchors.

Documents with the text of an earlier one are copies: all their windows stand earlier, so
they go on to step 3 at once.  The others take all steps.

1. Spark counts the anchors' names over the corpus.  A window whose anchor stands nowhere
   else is no repeat.
2. The other windows are verified by a cryptographic hash of all their words (128 bits of
   BLAKE2), and Spark finds the earliest place of each.
3. Words of windows that stand earlier elsewhere are taken out.

A name or window that is found twice in one batch needs nobody else to be shared, so what
meets by key in steps 1 and 2 is at most one row for each batch, however many documents
share a passage.

The texts are written once as a table bucketed by document, so that steps 2 and 3 bring
the findings to the texts without moving texts again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import bucketed, identity, keep, small
from ._words import Words, joined, mix64, positions, signed, slices

#: Words of a window.
WINDOW = 20
#: Rounds end where no window has ENOUGH symbols left; an anchor is the least-named phrase of PHRASE of them.
ROUNDS, ENOUGH, PHRASE = 12, 7, 4
_SLICE = 2 << 20


def windows_of(words: Words, width: int) -> np.ndarray:
    """The first words of all windows that lie in one text."""
    n = np.maximum(0, words.count - width + 1)
    return positions(n) + np.repeat(words.first[:-1], n)


def least_phrases(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """``(name, index)`` of the least-named phrase of PHRASE symbols in each range, the first of equals."""
    name = np.zeros(len(symbols) - PHRASE + 1, np.uint64)
    for k in range(PHRASE):
        name = mix64(name + symbols[k : len(symbols) - PHRASE + 1 + k] + np.uint64(level << 32))
    size = right - left - PHRASE + 1
    # index of the least name of 1, 2, 4, ... phrases from each place on; two of them cover a range
    least = [np.arange(len(name))]
    while 2 << (len(least) - 1) <= size.max():
        one, step = least[-1], 1 << (len(least) - 1)
        other = one[np.minimum(np.arange(len(name)) + step, len(name) - 1)]
        least.append(np.where(name[other] < name[one], other, one))
    found = np.empty(len(left), np.int64)
    power = np.frexp(size)[1] - 1  # of the largest span that fits
    for k, table in enumerate(least):
        of = power == k
        a, b = table[left[of]], table[left[of] + size[of] - (1 << k)]
        found[of] = np.where(name[b] < name[a], b, a)
    return name[found], found


def anchors(symbols: np.ndarray, of: np.ndarray, at: np.ndarray, width: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """``(name, place)`` of the anchor of each window of ``width`` symbols that begins in ``at``; ``of`` tells texts apart."""
    if not len(at):
        return np.zeros(0, np.uint64), at
    if width < PHRASE:
        return window_hashes(symbols, width)[at], at
    name, place = least_phrases(symbols, at, at + width, 0)
    start = np.arange(len(symbols))  # first word of each symbol
    left, right = at, at + width  # the symbols of the window that no neighbour changes
    live = np.arange(len(at))
    for level in range(1, rounds + 1):
        # runs; the first and the last may go on outside
        head = np.ones(len(symbols), bool)
        head[1:] = (symbols[1:] != symbols[:-1]) | (of[1:] != of[:-1])
        run = np.cumsum(head) - 1
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(symbols))).astype(np.uint64)
        symbols, of, start = symbols[begin], of[begin], start[begin]
        symbols = np.where(size > 1, mix64(symbols + size * np.uint64(0xD6E8FEB86659FD93)), symbols)
        left, right = run[left] + 1, run[right - 1]
        ok = left < right
        live, left, right = live[ok], left[ok], right[ok]
        if not len(live):
            break
        # pairs; a right symbol in front, or a left one at the end, may belong to one outside
        coin = (mix64(symbols + np.uint64(level)) >> np.uint64(63)).astype(bool)  # True: a right one
        pair = np.zeros(len(symbols), bool)
        pair[:-1] = ~coin[:-1] & coin[1:] & (of[1:] == of[:-1])
        second = np.zeros(len(symbols), bool)
        second[1:] = pair[:-1]
        index = np.cumsum(~second) - 1
        left, right = left + coin[left], right - ~coin[right - 1]
        ok = left < right
        live, left, right = live[ok], left[ok], right[ok]
        if not len(live):
            break
        left, right = index[left], index[right - 1] + 1
        ok = right - left >= ENOUGH
        live, left, right = live[ok], left[ok], right[ok]
        if not len(live):
            break
        joined = np.where(pair, mix64(mix64(symbols + np.uint64(0xA0761D6478BD642F)) + np.roll(symbols, -1)), symbols)
        symbols, of, start = joined[~second], of[~second], start[~second]
        name[live], found = least_phrases(symbols, left, right, level)
        place[live] = start[found]
    return name, place


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on, as far as there are so many: spans of 1, 2, 4, ... words are mixed in their order."""
    out, have, span, size = None, 0, hashes, 1
    while True:
        if width & size:
            part = span[have : len(hashes) - size + 1]
            out = part if out is None else mix64(mix64(out[: len(part)] + np.uint64(size)) + part)
            have += size
        size *= 2
        if size > width or len(span) <= size // 2:
            break
        span = mix64(mix64(span[: len(span) - size // 2] + np.uint64(size)) + span[size // 2 :])
    return out[: max(0, len(hashes) - width + 1)] if have == width else np.zeros(0, np.uint64)


def window_names(words: Words, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of BLAKE2 over the words from each place in ``at``, joined by blanks."""
    text, ends = joined(words)
    begin, stop = (ends[at] - (words.end - words.start)[at]).tolist(), ends[at + width - 1].tolist()
    names = b"".join([hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(begin, stop)])
    pair = np.frombuffer(names, np.uint64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def _named(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The names of each document's anchors, once each, under the key by which they are counted.

    A name at two places of the batch counts for two, in one row without a document; those
    places come under keys of their own, so that they are counted as shared and meet nobody.
    """
    for b in (part for batch in batches for part in slices(batch, "text", _SLICE)):
        words = Words(b.column("text"))
        at, of = windows_of(words, width), words.text_of()
        name, place = anchors(words.hashes(), of, at, width)
        if not len(at):
            continue
        new = np.append(True, (place[1:] != place[:-1]) | (name[1:] != name[:-1]))
        name, place, doc = name[new], place[new], of[at[new]]
        order = np.lexsort((place, doc, name))
        name, place, doc = name[order], place[order], doc[order]
        head = np.append(True, name[1:] != name[:-1])  # of a name
        first = head | np.append(True, doc[1:] != doc[:-1])  # of a name in a document
        group = np.cumsum(head) - 1
        begin = np.flatnonzero(head)
        shared = np.zeros(len(begin), bool)
        shared[group[np.append(False, (place[1:] != place[:-1])) & ~head]] = True
        many = shared[group[first]]
        name_of, row = name[first], b.column("row").take(pa.array(doc[first]))
        key = np.where(many, mix64(name_of + mix64(doc[first].astype(np.uint64)) + mix64(row.to_numpy().astype(np.uint64))), name_of)
        known = name[begin[shared]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(signed(np.concatenate([key, known]))), pa.array(signed(np.concatenate([name_of, known]))),
                pa.concat_arrays([row, pa.nulls(len(known), pa.int64())]), pa.array(np.concatenate([np.where(many, 2, 1), np.full(len(known), 2)]).astype(np.int32)),
            ],
            names=["key", "name", "row", "weight"],
        )


def _verified(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The windows whose anchors are shared: the two halves of a hash and the place.

    Of equal windows in one batch only the earliest has to be compared; the others go on
    with hashes of their own and the complement of their start, which marks them as repeats.
    """
    for b in (part for batch in batches for part in slices(batch, "text", _SLICE)):
        words = Words(b.column("text"))
        at, of, hashes = windows_of(words, width), words.text_of(), words.hashes()
        name, _ = anchors(hashes, of, at, width)
        names = b.column("names")
        wanted = np.sort(mix64(names.flatten().to_numpy().view(np.uint64)) + mix64(np.asarray(pa.compute.list_parent_indices(names)).astype(np.uint64)))
        if not len(wanted) or not len(at):
            continue
        key = mix64(name) + mix64(of[at].astype(np.uint64))
        at = at[wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key]
        one, two = window_names(words, at, width)
        ids = b.column("doc_id")
        known = np.asarray(ids.is_valid())
        value = ids.fill_null(0).to_numpy()
        rank = np.lexsort((value, known))
        place = np.empty(len(rank), np.int64)  # the document's, equal for equal ids
        place[rank] = np.cumsum(np.append(False, (value[rank][1:] != value[rank][:-1]) | (known[rank][1:] != known[rank][:-1])))
        doc = of[at]
        order = np.lexsort((at - words.first[doc], place[doc], two, one))
        at, doc, one, two = at[order], doc[order], one[order], two[order]
        start, spot = at - words.first[doc], place[doc]
        if len(at):
            again = np.append(False, (one[1:] == one[:-1]) & (two[1:] == two[:-1]))
            # rows of one id are one document: the same place is no repeat of itself
            lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
            again &= (spot != spot[lead]) | (start != start[lead])
            row = b.column("row").to_numpy()[doc].astype(np.uint64)
            one = np.where(again, mix64(one + mix64(row) + mix64(start.astype(np.uint64))), one)
            start = np.where(again, ~start, start)
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(one)), pa.array(signed(two)), b.column("doc_id").take(pa.array(doc)), b.column("row").take(pa.array(doc)), pa.array(start.astype(np.int32))],
            names=["one", "two", "doc_id", "row", "start"],
        )


def _left(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The words that stay, joined by one space: none of a copy, but for one too short for a window."""
    for b in (part for batch in batches for part in slices(batch, "text", _SLICE)):
        words = Words(b.column("text"))
        starts = b.column("starts")
        doc = np.asarray(pa.compute.list_parent_indices(starts))
        at = starts.flatten().to_numpy() + words.first[doc]
        covered = np.bincount(at, minlength=len(words) + width + 1)[: len(words) + width + 1]
        covered[width:] -= np.bincount(at, minlength=len(words) + width + 1)[: len(words) + 1]
        copy = np.asarray(b.column("copy").to_numpy(zero_copy_only=False), bool) & (words.count >= width)
        gone = (np.cumsum(covered)[: len(words)] > 0) | copy[words.text_of()]
        stay = np.flatnonzero(~gone)
        of = words.text_of()
        data = words.data.copy()
        edge = np.zeros(len(data) + 1, np.int8)
        np.add.at(edge, words.start[stay], 1)
        np.add.at(edge, words.end[stay], -1)
        mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
        later = stay[1:][of[stay[1:]] == of[stay[:-1]]]  # words with one before them: the byte between is white space
        data[words.start[later] - 1] = 0x20
        mask[words.start[later] - 1] = True
        size = np.concatenate([[0], np.cumsum(mask)])[words.offsets]
        text = pa.LargeStringArray.from_buffers(b.num_rows, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(data[mask].tobytes())).cast(pa.string())
        n_gone = np.concatenate([[0], np.cumsum(gone)])[words.first]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), text, pa.array(words.count), pa.array(np.diff(n_gone))], names=["doc_id", "text", "n_words", "n_removed"])


def dedup_substrings(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the ``text`` of the words that stay, ``n_words`` and ``n_removed`` of each document.

    A word goes if a window of ``width`` words that covers it also starts earlier: in a
    document of smaller id (null first), or further up in the same one.  Windows are
    judged on the input.  A null or empty text has no words and comes out empty; texts
    of fewer words than a window lose nothing.  Rows of one id are one document: the same
    start in two of them is one place, so equal rows come out alike, each as one row.
    Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), identity(text).alias("named"))
    first = rows.groupBy("named").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("c"), F.max(F.struct("doc_id")).alias("last"))
    first = small(keep(first.where("c > 1 and first < last").select("named", "first")))
    copy = F.coalesce(F.struct("doc_id") > F.col("first"), F.lit(False))
    n_bytes = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    # a number for each row, fixed as the table is written
    numbered = rows.join(first, "named", "left").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", copy.alias("copy"))
    table = bucketed(numbered, "row", n_bytes)

    named = table.where("not copy").select("text", "row").mapInArrow(lambda batches: _named(batches, width), "key long, name long, row long, weight int")
    total = F.sum("weight").over(Window.partitionBy("key"))
    shared = keep(named.withColumn("total", total).where("total > 1 and row is not null").groupBy("row").agg(F.collect_set("name").alias("names")))
    verify = table.join(shared, "row").select("doc_id", "row", "text", "names")
    places = verify.mapInArrow(lambda batches: _verified(batches, width), "one long, two long, doc_id long, row long, start int")
    place = F.struct("doc_id", "start")
    judged = places.withColumn("first", F.min(place).over(Window.partitionBy("one", "two")))
    start = F.when(F.col("start") < 0, F.bitwise_not("start")).otherwise(F.col("start"))
    removed = keep(judged.where((F.col("start") < 0) | (place > F.col("first"))).groupBy("row").agg(F.collect_set(start).alias("starts")))
    left = table.join(removed, "row", "left").select("doc_id", "text", "copy", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))
    return left.mapInArrow(lambda batches: _left(batches, width), "doc_id long, text string, n_words long, n_removed long")
