"""Vectorised word work on Arrow string columns, used inside Spark tasks.

A word is ``[^\\x20\\x09-\\x0D]+``.  White space is ASCII only, so UTF-8 bytes
can be classified one by one and no Python string is ever built.  Every helper
takes one Arrow batch, so memory is bounded by the batch and not by the table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)`` of a string column; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch of texts: byte spans and the first word of each text.

    ``start``/``end`` are byte positions in ``data``; the words of text ``i`` are
    ``first[i]:first[i + 1]``.  ``gap`` marks the bytes that are in no word.
    """

    def __init__(self, column: pa.Array, lower: bool = False, gap: np.ndarray = _SPACE):
        data, offsets = text_bytes(column)
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        # A gap before and after every text keeps words of neighbours apart.
        solid = ~gap[self.data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begins[edge] = solid[edge]
        ends[edge - 1] = solid[edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def count(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The number of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """One 64-bit hash for each word (equal bytes, equal hash)."""
        return span_hashes(self.data, self.start, self.end, seed)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


#: Spans of more bytes than this are hashed one by one with BLAKE2; shorter ones eight bytes at a time, all at once.
_LONG = 512
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each byte span ``data[start:end]``.

    The length and every block of eight bytes are mixed, one after the other, into all that
    came before; equal spans have equal hashes, and different ones of up to eight bytes and
    one length never have.
    """
    size = end - start
    out = mix64(size.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x51ED27) % 2**64))
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # eight bytes from each place on
    short = size <= _LONG
    live = None if short.all() else np.flatnonzero(short)
    at, left = (start, size) if live is None else (start[live], size[live])
    step = 0
    while len(left):
        value = blocks[at] & _MASKS[np.minimum(left, 8)]
        if live is None:
            out = mix64(out ^ value)
        else:
            out[live] = mix64(out[live] ^ value)
        on = left > 8
        at, left = at[on] + 8, left[on] - 8
        live = np.flatnonzero(on) if live is None else live[on]
        step += 1
    if not short.all():
        salt = int(seed).to_bytes(8, "little", signed=True)
        for i in np.flatnonzero(~short):
            raw = hashlib.blake2b(data[start[i] : end[i]], digest_size=8, salt=salt).digest()
            out[i] = int.from_bytes(raw, "little")
    return out


def compact(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
    """The spans, ascending, apart and none of them empty, as an Arrow column."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] = 1
    edge[end] -= 1  # where two spans touch, one begins as the other ends
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])


def coded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """``(codes, distinct)``: which of the distinct spans each span is, by comparing bytes."""
    found = compact(data, start, end).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def joined(words: Words) -> tuple[memoryview, np.ndarray]:
    """The words of all texts, with one blank after every word but the last of its text; and where each word ends in it."""
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.start] = 1
    edge[words.end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    # the blank takes the place of a byte of white space
    between = np.ones(len(words), bool)
    between[words.first[1:][words.count > 0] - 1] = False
    blank = words.end[between]
    inside[blank] = True
    data = words.data.copy()
    data[blank] = 0x20
    blanks = np.concatenate([[0], np.cumsum(between)])[:-1]
    return memoryview(data[inside]), np.cumsum(words.end - words.start) + blanks


def normal(words: Words) -> pa.Array:
    """16 bytes that name the words of each text in their order, null without any."""
    raw, ends = joined(words)
    out = []
    for a, n in zip(words.first[:-1].tolist(), words.count.tolist()):
        if not n:
            out.append(None)
            continue
        begin = int(ends[a]) - int(words.end[a] - words.start[a])
        out.append(hashlib.blake2b(raw[begin : int(ends[a + n - 1])], digest_size=16).digest())
    return pa.array(out, pa.binary())


def exact_shingles(codes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(value, text)``: the distinct shingles of each text, by numbers that equal shingles alone share, from the words' codes.

    A text of fewer words has its whole sequence as its only shingle, as in ``shingle_hashes``.
    """
    count = np.diff(first)
    # short texts are filled up with a code that no word has
    fill = np.where((count > 0) & (count < width), width - count, 0)
    begin = np.concatenate([[0], np.cumsum(count + fill)])
    full = np.full(begin[-1], codes.max(initial=-1) + 1, np.int64)
    full[np.arange(len(codes)) + np.repeat(begin[:-1] - first[:-1], count)] = codes
    n = np.maximum(0, count + fill - width + 1)
    at = positions(n) + np.repeat(begin[:-1], n)
    text = np.repeat(np.arange(len(count)), n)
    value, top = full[at], int(full.max(initial=0)) + 1
    for k in range(1, width):
        # two numbers in one, and both of them below the number of words
        value, top = np.unique(value * (int(full.max(initial=0)) + 1) + full[at + k], return_inverse=True)[1], len(at)
    distinct = np.unique(text * max(1, top) + value)
    return distinct % max(1, top), distinct // max(1, top)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and the first shingle of each text.

    A text with fewer words, but at least one, has its whole word sequence as its only
    shingle; a text without words has none.
    """
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, (count > 0).astype(count.dtype))
    begin = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(begin[-1], np.uint64)
    long = count >= width
    if long.any():
        roll = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            roll = mix64(roll + words[k : len(words) - width + 1 + k])
        at = positions(n * long) + np.repeat(first[:-1], n * long)
        out[np.repeat(long, n)] = roll[at]
    for i in np.flatnonzero(~long & (count > 0)):
        h = np.zeros(1, np.uint64)
        for w in words[first[i] : first[i + 1]]:
            h = mix64(h + w)
        out[begin[i]] = mix64(h + np.uint64(count[i]))[0]
    return out, begin


def positions(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group of the given sizes."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 bits as Spark's BIGINT."""
    return np.ascontiguousarray(x).view(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Parts of a batch with about ``most`` bytes of text each (one row at least)."""
    _, offsets = text_bytes(batch.column(column))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b
