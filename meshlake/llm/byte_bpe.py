"""Byte-level BPE: encoding by a replay of the merges over many words at once, and decoding.

A text is split by a pattern into words, each of which is encoded apart.  The distinct
words that a task meets are laid out in one line, and an inverted index leads from each
pair of neighbours that merges to all places where it stands.  The merges are then applied
in the order of their ranks, each to all its places, and only the two new pairs beside a
merged one enter the index.  Words that a task has encoded before are looked up.

No row moves: a document's ids need its own words only, so encoding and decoding are each
one pass over the table.  A replay over the words of the whole corpus would give the same
ids and have to send every use of a word through a shuffle to meet them.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, fresh, quoted

#: Words split before they are encoded together, and most bytes of new words in one replay (one word may have more).
WORDS, REPLAY_BYTES = 200_000, 1 << 20
#: Words that a task remembers, and bytes of the longest of them.
KNOWN, LONGEST = 500_000, 256
#: Characters of a text from which on its words are split off in parts.
LONG_TEXT = 1 << 20


@lru_cache(maxsize=1)
def class_differences() -> dict[int, str]:
    """Code points that the splitting module and the tiktoken library class differently, each with one of its class in the latter.

    Both know letters, numbers and white space by the Unicode tables that they were built with.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    kind: dict[str, dict[str, str]] = {"there": {}, "here": {}}
    for stand_in, pattern in (("é", r"\p{L}"), ("1", r"\p{N}"), (" ", r"\s")):
        there = tiktoken.Encoding(f"class {stand_in}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        # only what matches is encoded
        found = bytes(there.encode_ordinary(every)).decode()
        kind["there"] |= dict.fromkeys(found, stand_in)
        kind["here"] |= dict.fromkeys(regex.findall(pattern, every), stand_in)
    unassigned = "͸"
    odd = {c for c in kind["there"].keys() | kind["here"].keys() if kind["there"].get(c) != kind["here"].get(c)}
    return {ord(c): kind["there"].get(c, unassigned) for c in odd}


class Encoder:
    """A vocabulary of byte strings with ranks, and the pattern that splits a text."""

    def __init__(self, raw: bytes, pattern: str, odd: dict[int, str] | None = None):
        """``raw``: lines of a token in base 64 and its rank; all 256 bytes must be tokens.  ``odd``: see ``class_differences``."""
        import regex

        self.raw, self.pattern, self.odd = raw, pattern, class_differences() if odd is None else odd
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}
        if any(bytes([b]) not in self.rank for b in range(256)) or len(set(self.rank.values())) != len(self.rank):
            raise ValueError("not a vocabulary of bytes: each byte needs a token, and each token its own rank")
        self.token = {n: t for t, n in self.rank.items()}
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.first = np.full(1 << 16, -1, np.int32)  # what two bytes merge to
        for token, n in self.rank.items():
            if len(token) == 2:
                self.first[token[0] << 8 | token[1]] = n
        self._split = regex.compile(pattern)
        self._odd = frozenset(map(chr, self.odd))
        self._may_be_odd = re.compile(f"[{chr(min(self.odd))}-{chr(0x10FFFF)}]") if self.odd else None

    @staticmethod
    def load(path: str, pattern: str) -> "Encoder":
        with open(path, "rb") as f:
            return Encoder(f.read(), pattern)

    def __getstate__(self):
        return self.raw, self.pattern, self.odd

    def __setstate__(self, state):
        self.__init__(*state)

    def words(self, text: str) -> Iterator[list[str]]:
        """The pattern's matches in their order, in lists of bounded length."""
        if self._may_be_odd is not None and not text.isascii() and self._may_be_odd.search(text) and not self._odd.isdisjoint(text):
            # one character for another, so the places are the same
            found = (text[m.start() : m.end()] for m in self._split.finditer(text.translate(self.odd)))
        elif len(text) < LONG_TEXT:
            yield self._split.findall(text)
            return
        else:
            found = (m.group() for m in self._split.finditer(text))
        while part := list(islice(found, WORDS)):
            yield part

    def encode(self, texts: Iterable[str | None], known: dict[str, bytes]) -> list[bytes]:
        """The ids of each text, little-endian in 4 bytes each; ``known`` holds words encoded before."""
        out: list[list[bytes]] = []
        pending: list[tuple[int, list[str]]] = []

        def flush() -> None:
            new = {w for _, words in pending for w in words if w not in known}
            known.update(self.replayed(list(new)))
            for i, words in pending:
                out[i].append(b"".join(map(known.__getitem__, words)))
            pending.clear()
            for w in [w for w in new if len(w) > LONGEST]:
                del known[w]
            if len(known) > KNOWN:
                known.clear()

        n = 0
        for i, text in enumerate(texts):
            out.append([])
            for words in self.words(text or ""):
                pending.append((i, words))
                n += len(words)
                if n >= WORDS:
                    flush()
                    n = 0
        flush()
        return [b"".join(x) for x in out]

    def replayed(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words, some REPLAY_BYTES of them at a time."""
        out, part, size = {}, [], 0
        for w in words:
            raw = w.encode()
            if raw in self.rank:  # a whole word that is a token is never split
                out[w] = self.rank[raw].to_bytes(4, "little")
                continue
            part.append((w, raw))
            size += len(raw)
            if size >= REPLAY_BYTES:
                out |= zip((w for w, _ in part), self.replay([raw for _, raw in part]))
                part, size = [], 0
        return out | dict(zip((w for w, _ in part), self.replay([raw for _, raw in part])))

    def replay(self, words: list[bytes]) -> list[bytes]:
        """All merges, in the order of their ranks, over all the words.

        A place is a byte, with one more behind every word; its symbol is -1 there and where
        a merge has swallowed it.  Where a merge makes a pair of lower rank, that one comes
        first and the places that are left wait, as they would if each word were alone.
        """
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        stop = begin[1:] - 1
        symbols = self.single[data]
        symbols[stop] = -1
        pair = self.first[data[:-1].astype(np.int32) << 8 | data[1:]]
        pair[stop[:-1]] = -1
        pair[stop - 1] = -1
        order = np.argsort(pair, kind="stable")
        ranks, at = np.unique(pair[order], return_index=True)
        index = {int(r): order[a:b] for r, a, b in zip(ranks, at, [*at[1:], len(order)]) if r >= 0}
        heap = sorted(index)

        word = array("i", np.repeat(np.arange(len(words), dtype=np.int32), sizes + 1).tobytes())
        symbol, after, before = array("i", symbols.tobytes()), array("i", range(1, len(data) + 1)), array("i", range(-1, len(data) - 1))
        token, rank_of, added = self.token, self.rank.get, {}
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            places = added.pop(rank, []) if places is None else places.tolist() + added.pop(rank, [])
            places.sort()
            whole, waits, rest = token[rank], -1, []
            for i in places:
                one, j = symbol[i], after[i]
                if one < 0 or (two := symbol[j]) < 0 or token[one] + token[two] != whole:
                    continue  # the pair is gone
                if word[i] == waits:
                    rest.append(i)
                    continue
                near, far = before[i], after[j]
                symbol[i], symbol[j] = rank, -1
                after[i] = far
                before[far] = i
                if (side := symbol[near]) >= 0 and (new := rank_of(token[side] + whole)) is not None:
                    if new in added:
                        added[new].append(near)
                    else:
                        added[new] = [near]
                        if new not in index:
                            heapq.heappush(heap, new)
                    if new < rank:
                        waits = word[i]
                if (side := symbol[far]) >= 0 and (new := rank_of(whole + token[side])) is not None:
                    if new in added:
                        added[new].append(i)
                    else:
                        added[new] = [i]
                        if new not in index:
                            heapq.heappush(heap, new)
                    if new < rank:
                        waits = word[i]
            if rest:
                added[rank] = rest
                heapq.heappush(heap, rank)
        symbols = np.frombuffer(symbol, np.int32)
        kept = symbols >= 0
        ends = np.concatenate([[0], np.cumsum(kept)])[begin].tolist()
        raw = symbols[kept].astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes that the ids stand for; an unknown id is an error."""
        found = np.frombuffer(ids or b"", "<u4")
        try:
            return b"".join(b"".join(map(self.token.__getitem__, found[a : a + WORDS].tolist())) for a in range(0, len(found), WORDS))
        except KeyError as error:
            raise ValueError(f"no token has the id {error.args[0]}") from None


def _mapped(df: DataFrame, column: str, keep: list[str], name: str, make) -> DataFrame:
    """``keep`` and a binary column ``name``, made from ``column`` by batches; it must not have the name of a kept one."""
    if name.lower() in [c.lower() for c in keep]:
        raise ValueError(f"{name} is a column that is kept")
    bounded_batches(df.sparkSession)
    source = fresh(df.select(*quoted(keep)), "__source")
    rows = df.select(*quoted(keep), *[c.alias(source) for c in quoted([column])])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(run(b.columns[-1].to_pylist()), pa.binary())], names=[*keep, name])

    return rows.mapInArrow(mapped, rows.drop(source).withColumn(name, F.lit(b"")).schema)


def encode(docs: DataFrame, encoder: Encoder, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``ids_col``: the ids of each whole text as little-endian unsigned 32-bit numbers, end to end.

    One row for each row, repeated ones too.  A null or empty text has no ids.  No special
    tokens.  Other columns are not read.  A task holds a batch of texts and some hundred
    bytes for each byte of the longest match of the pattern.
    """

    def make():
        known: dict[str, bytes] = {}
        return lambda texts: encoder.encode(texts, known)

    return _mapped(docs, text_col, list(keep), ids_col, make)


def decode(rows: DataFrame, encoder: Encoder, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), bytes_col: str = "decoded") -> DataFrame:
    """The columns ``keep`` and ``bytes_col``: the bytes of the ids, none for null ones.  An id that no token has is an error."""
    return _mapped(rows, ids_col, list(keep), bytes_col, lambda: lambda column: [encoder.decode(x) for x in column])


def n_ids(ids: str | Column) -> Column:
    """How many ids there are in a column of them."""
    return F.floor(F.octet_length(ids) / 4).cast("long")
