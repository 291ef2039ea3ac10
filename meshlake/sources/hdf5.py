"""Numeric data sets of HDF5 files, by hyperslabs, read by ranges of rows.

The driver follows a data set's path and reads its description; tasks read the elements.
Where a data set is stored in chunks, a task goes down the tree of chunks itself, into the
branches that can hold its rows and no others, so the list of all chunks is nowhere.

What is read: groups by symbol tables or by links in their headers; whole numbers and
floating-point numbers; compact, contiguous and chunked storage (trees of version 1, one
chunk, or chunks one behind the other); the deflate, shuffle and checksum filters, of which
checksums are not tested.  All else is an error that names it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..model import ROW, Geometry
from .binary import MISSING

#: Values that a task reads at once.
VALUES = 1 << 20
SIGNATURE = b"\x89HDF\r\n\x1a\n"


class Reader:
    """Bytes of the file, and numbers in the widths that its superblock tells."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.base, self.offset, self.length = file, 0, 8, 8

    def at(self, place: int, n: int) -> bytes:
        self.file.seek(self.base + place)
        raw = self.file.read(n)
        if len(raw) < n:
            raise ValueError("the file ends too soon")
        return raw

    def number(self, raw: bytes, place: int, width: int) -> int:
        return int.from_bytes(raw[place : place + width], "little")

    def undefined(self, address: int) -> bool:
        return address == (1 << 8 * self.offset) - 1

    def root(self) -> int:
        """The address of the root group's header."""
        size = self.file.size()
        start = 0
        while start < size and self.at(start, min(8, size - start)) != SIGNATURE:
            start = start * 2 or 512
        if start >= size:
            raise ValueError("not an HDF5 file")
        version = self.at(start + 8, 1)[0]
        if version > 3:
            raise ValueError(f"superblock version {version}")
        raw = self.at(start, min(128, size - start))
        if version < 2:
            self.offset, self.length = raw[13], raw[14]
            place = 24 + (4 if version == 1 else 0)
            self.base = self.number(raw, place, self.offset)
            return self.number(raw, place + 5 * self.offset, self.offset)
        self.offset, self.length = raw[9], raw[10]
        self.base = self.number(raw, 12, self.offset)
        return self.number(raw, 12 + 3 * self.offset, self.offset)

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """``(type, content)`` of an object's header, continued blocks too."""
        head = self.at(address, 16)
        if head[:4] == b"OHDR":
            flags = head[5]
            place = 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            size = self.number(self.at(address, place + width), place, width)
            blocks, second, extra = [(address + place + width, size)], True, 2 if flags & 4 else 0
        else:
            blocks, second, extra = [(address + 16, self.number(head, 8, 4))], False, 0
        out: list[tuple[int, bytes]] = []
        while blocks:
            start, size = blocks.pop(0)
            raw, place = self.at(start, size), 0
            lead = 4 + extra if second else 8
            while place + lead <= size:
                kind = raw[place] if second else self.number(raw, place, 2)
                n = self.number(raw, place + (1 if second else 2), 2)
                if raw[place + (3 if second else 4)] & 2:
                    raise ValueError("shared header messages")
                content = raw[place + lead : place + lead + n]
                place += lead + n
                if kind == 0x10:
                    to, m = self.number(content, 0, self.offset), self.number(content, self.offset, self.length)
                    blocks.append((to + 4, m - 8) if second else (to, m))
                else:
                    out.append((kind, content))
        return out

    def members(self, address: int) -> dict[str, int]:
        """The headers of a group's members by name."""
        out, dense = {}, False
        for kind, raw in self.messages(address):
            if kind == 0x11:
                heap = self.at(self.number(raw, self.offset, self.offset), 8 + 2 * self.length + self.offset)
                names = self.at(self.number(heap, 8 + 2 * self.length, self.offset), self.number(heap, 8, self.length))
                self._symbols(self.number(raw, 0, self.offset), names, out)
            elif kind == 6:
                flags, place = raw[1], 2
                link = raw[place] if flags & 8 else 0
                place += bool(flags & 8) + (8 if flags & 4 else 0) + bool(flags & 0x10)
                width = 1 << (flags & 3)
                n = self.number(raw, place, width)
                name = raw[place + width : place + width + n].decode()
                if link == 0:
                    out[name] = self.number(raw, place + width + n, self.offset)
            elif kind == 2:
                place = 2 + (8 if raw[1] & 1 else 0)
                dense = not self.undefined(self.number(raw, place, self.offset))
        if dense and not out:
            raise ValueError("links in a fractal heap")
        return out

    def _symbols(self, address: int, names: bytes, out: dict[str, int]) -> None:
        head = self.at(address, 8)
        if head[:4] == b"SNOD":
            width = 2 * self.offset + 24
            raw = self.at(address + 8, self.number(head, 6, 2) * width)
            for k in range(0, len(raw), width):
                start = self.number(raw, k, self.offset)
                out[names[start : names.index(b"\0", start)].decode()] = self.number(raw, k + self.offset, self.offset)
            return
        n, place = self.number(head, 6, 2), 8 + 2 * self.offset
        raw = self.at(address + place, n * (self.length + self.offset))
        for k in range(n):
            self._symbols(self.number(raw, k * (self.length + self.offset) + self.length, self.offset), names, out)


@dataclass(frozen=True)
class DataSet:
    """Where and how the elements of a data set lie."""

    path: str
    base: int
    offset: int
    shape: tuple[int, ...]
    dtype: str
    fill: float
    #: compact, contiguous, tree, single or rowwise
    storage: str
    address: int
    data: bytes = b""
    chunk: tuple[int, ...] = ()
    filters: tuple[tuple[int, int], ...] = ()
    stored: int = 0

    def reader(self, file: pa.NativeFile) -> Reader:
        out = Reader(file)
        out.base, out.offset = self.base, self.offset
        return out

    def read(self, reader: Reader, start: Sequence[int], count: Sequence[int]) -> np.ndarray:
        """A hyperslab as doubles."""
        kind = np.dtype(self.dtype)
        out = np.full(count, self.fill, np.float64)
        missing = reader.undefined(self.address) and self.storage != "compact"
        if 0 in count or missing:
            return out
        if self.storage == "compact":
            whole = np.frombuffer(self.data, kind, int(np.prod(self.shape))).reshape(self.shape)
            return whole[tuple(slice(a, a + n) for a, n in zip(start, count))].astype(np.float64)
        if self.storage == "contiguous":
            steps = [int(np.prod(self.shape[k + 1 :])) for k in range(len(self.shape))]
            for at in product(*map(range, count[:-1])):
                first = sum((a + i) * s for a, i, s in zip(start, (*at, 0), steps))
                out[at] = np.frombuffer(reader.at(self.address + first * kind.itemsize, count[-1] * kind.itemsize), kind)
            return out
        for place, address, size, mask in self.chunks(reader, start, [a + n for a, n in zip(start, count)]):
            raw = reader.at(address, size)
            for k, (name, value) in reversed(list(enumerate(self.filters))):
                if not mask >> k & 1:
                    raw = unfiltered(raw, name, value)
            part = np.frombuffer(raw, kind, int(np.prod(self.chunk))).reshape(self.chunk)
            low = [max(a, p) for a, p in zip(start, place)]
            high = [min(a + n, p + c, s) for a, n, p, c, s in zip(start, count, place, self.chunk, self.shape)]
            out[tuple(slice(x - a, y - a) for x, y, a in zip(low, high, start))] = part[tuple(slice(x - p, y - p) for x, y, p in zip(low, high, place))]
        return out

    def chunks(self, reader: Reader, low: Sequence[int], high: Sequence[int]) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """``(place, address, bytes, mask of left out filters)`` of the chunks that hold elements from ``low`` up to ``high``."""
        size = int(np.prod(self.chunk)) * np.dtype(self.dtype).itemsize
        if self.storage == "single":
            yield (0,) * len(self.shape), self.address, self.stored or size, 0
        elif self.storage == "rowwise":
            across = [-(-s // c) for s, c in zip(self.shape, self.chunk)]
            for at in product(*(range(a // c, -(-b // c)) for a, b, c in zip(low, high, self.chunk))):
                number = 0
                for i, n in zip(at, across):
                    number = number * n + i
                yield tuple(i * c for i, c in zip(at, self.chunk)), self.address + number * size, size, 0
        else:
            yield from self._tree(reader, self.address, list(low), list(high))

    def _tree(self, reader: Reader, address: int, low: list[int], high: list[int]) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
        """Keys ascend in the order of places; a branch from one key up to the next that is beyond ``high``, or ends before ``low``, holds none."""
        head = reader.at(address, 8 + 2 * self.offset)
        if head[:4] != b"TREE" or head[4] != 1:
            raise ValueError("not a tree of chunks")
        n, rank = reader.number(head, 6, 2), len(self.shape)
        key = 8 + 8 * (rank + 1)
        raw = reader.at(address + 8 + 2 * self.offset, n * (key + self.offset) + key)
        places = [tuple(int.from_bytes(raw[k + 8 + 8 * j : k + 16 + 8 * j], "little") for j in range(rank)) for k in range(0, len(raw), key + self.offset)]
        first = tuple(a // c * c for a, c in zip(low, self.chunk))
        last = tuple((b - 1) // c * c for b, c in zip(high, self.chunk))
        for k in range(n):
            at = k * (key + self.offset)
            child = reader.number(raw, at + key, self.offset)
            if head[5]:
                if places[k] <= last and places[k + 1] >= first:
                    yield from self._tree(reader, child, low, high)
            elif all(p < b and p + c > a for p, c, a, b in zip(places[k], self.chunk, low, high)):
                yield places[k], child, reader.number(raw, at, 4), reader.number(raw, at + 4, 4)


def unfiltered(raw: bytes, name: int, value: int) -> bytes:
    if name == 1:
        return zlib.decompress(raw)
    if name == 2:
        n = len(raw) // value
        return np.frombuffer(raw, np.uint8, n * value).reshape(value, n).T.tobytes() + raw[n * value :]
    if name == 3:
        return raw[:-4]
    raise ValueError(f"filter {name}")


def data_set(path: str, name: str) -> DataSet:
    """The description of the data set ``name``, groups and it with / between them, in the file ``path``, a URI."""
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as file:
        reader = Reader(file)
        header = reader.root()
        for part in (x for x in name.split("/") if x):
            found = reader.members(header)
            if part not in found:
                raise ValueError(f"{path} has no {name}")
            header = found[part]
        return described(path, name, reader, reader.messages(header))


def described(path: str, name: str, reader: Reader, messages: list[tuple[int, bytes]]) -> DataSet:
    known = dict(reversed(messages))  # the first of a kind counts
    if not {1, 3, 8} <= known.keys():
        raise ValueError(f"{name} is no data set")
    space, kind, layout = known[1], known[3], known[8]
    begin = 8 if space[0] == 1 else 4
    shape = tuple(reader.number(space, begin + k * reader.length, reader.length) for k in range(space[1]))
    if not shape:
        raise ValueError(f"{name} is a single value")
    if kind[0] & 15 not in (0, 1) or (kind[0] & 15 == 1 and kind[1] & 0x40):
        raise ValueError(f"{name} holds no numbers")
    letter = "f" if kind[0] & 15 == 1 else "i" if kind[1] & 8 else "u"
    dtype = f"{'>' if kind[1] & 1 else '<'}{letter}{reader.number(kind, 4, 4)}"
    size = np.dtype(dtype).itemsize
    common = {"path": path, "base": reader.base, "offset": reader.offset, "shape": shape, "dtype": dtype, "fill": _fill(reader, known.get(5), dtype)}
    version, form = layout[0], layout[1]
    if version not in (3, 4):
        raise ValueError(f"layout version {version}")
    if form == 0:
        return DataSet(**common, storage="compact", address=0, data=layout[4 : 4 + reader.number(layout, 2, 2)])
    if form == 1:
        return DataSet(**common, storage="contiguous", address=reader.number(layout, 2, reader.offset))
    if form != 2:
        raise ValueError(f"storage {form}")
    filters = _filters(reader, known[11]) if 11 in known else ()
    if version == 3:
        chunk = tuple(reader.number(layout, 3 + reader.offset + 4 * k, 4) for k in range(layout[2] - 1))
        return DataSet(**common, storage="tree", address=reader.number(layout, 3, reader.offset), chunk=chunk, filters=filters)
    flags, rank, width = layout[2], layout[3], layout[4]
    chunk = tuple(reader.number(layout, 5 + width * k, width) for k in range(rank - 1))
    place = 5 + width * rank
    index, stored = layout[place], int(np.prod(chunk)) * size
    place += 1
    if index == 1:
        if flags & 2:
            stored = reader.number(layout, place, reader.length)
            place += reader.length + 4
        return DataSet(**common, storage="single", address=reader.number(layout, place, reader.offset), chunk=chunk, filters=filters, stored=stored)
    if index == 2:
        return DataSet(**common, storage="rowwise", address=reader.number(layout, place, reader.offset), chunk=chunk)
    raise ValueError(f"index of chunks of kind {index}")


def _fill(reader: Reader, raw: bytes | None, dtype: str) -> float:
    if raw is None:
        return 0.0
    if raw[0] == 3:
        place = 6 if raw[1] & 0x20 else None
    else:
        place = 8 if raw[0] == 1 or raw[3] else None
    if place is None or reader.number(raw, place - 4, 4) != np.dtype(dtype).itemsize:
        return 0.0
    return float(np.frombuffer(raw, dtype, 1, place)[0])


def _filters(reader: Reader, raw: bytes) -> tuple[tuple[int, int], ...]:
    """Number and first value of each filter, in the order of writing."""
    out, place = [], 8 if raw[0] == 1 else 2
    for _ in range(raw[1]):
        name = reader.number(raw, place, 2)
        named = raw[0] == 1 or name >= 256
        n_name = reader.number(raw, place + 2, 2) if named else 0
        place += 4 if named else 2
        n_values = reader.number(raw, place + 2, 2)
        place += 4 + (-(-n_name // 8) * 8 if raw[0] == 1 else n_name)
        out.append((name, reader.number(raw, place, 4) if n_values else 0))
        place += 4 * n_values + (4 if raw[0] == 1 and n_values % 2 else 0)
    return tuple(out)


Slab = tuple[Sequence[int], Sequence[int]]


def read_hdf5(spark: SparkSession, path: str, names: Sequence[str], slabs: Mapping[str, Slab] | None = None, volume: bool = False, values: int = VALUES) -> tuple[DataFrame, Geometry | None]:
    """``__row`` and the data sets as columns, by hyperslabs (start and count along each axis; counts beyond the end are clipped).

    A data set of one axis is a column.  One of more has a column for each place of its
    leading axes, ``name_i_j``, and rows along its last one.  There are as many rows as the
    longest has; the others are NULL there, as are NaN and the missing mark.  With
    ``volume`` all data sets have three axes and equal counts, each is a column, and the
    cells go along the last axis first.  Names are those behind the last /, and must differ.
    A task holds about ``values`` values, of a volume a whole plane at least, and one chunk.
    """
    sets, boxes, columns = [data_set(path, n) for n in names], [], []
    for name, d in zip(names, sets):
        start, count = (slabs or {}).get(name, ([0] * len(d.shape), list(d.shape)))
        if len(start) != len(d.shape) or len(count) != len(d.shape) or any(not 0 <= a < max(1, s) for a, s in zip(start, d.shape)) or min(count) <= 0 < min(d.shape):
            raise ValueError(f"the hyperslab of {name} is not inside {d.shape}")
        boxes.append((list(start), [min(n, s - a) for a, n, s in zip(start, count, d.shape)]))
    if volume and any(len(n) != 3 or n != boxes[0][1] for _, n in boxes):
        raise ValueError("a volume needs three axes of equal counts")
    for k, (name, (start, count)) in enumerate(zip(names, boxes)):
        short = name.rsplit("/", 1)[-1]
        leading = [()] if volume else list(product(*(range(a, a + n) for a, n in zip(start[:-1], count[:-1]))))
        columns += [(k, at, "_".join([short, *map(str, at)])) for at in leading]
    if len({c[2].lower() for c in columns}) != len(columns):
        raise ValueError("two columns have one name")
    n_rows = int(np.prod(boxes[0][1])) if volume else max(n[-1] for _, n in boxes)
    plane = int(np.prod(boxes[0][1][1:])) if volume else 1
    each = max(1, values // max(1, len(columns)) // plane) * plane
    n_tasks = max(1, -(-n_rows // each))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as file:
            for t in (t for b in batches for t in b.column(0).to_pylist()):
                a, b = t * each, min(n_rows, (t + 1) * each)
                found: dict[tuple[int, tuple[int, ...]], np.ndarray] = {}
                for k, (d, (start, count)) in enumerate(zip(sets, boxes)):
                    if volume:
                        got = d.read(d.reader(file), [start[0] + a // plane, *start[1:]], [(b - a) // plane, *count[1:]])
                        found[k, ()] = got.reshape(-1)
                        continue
                    here = max(0, min(b, count[-1]) - a)
                    got = d.read(d.reader(file), [*start[:-1], start[-1] + min(a, count[-1])], [*count[:-1], here])
                    for place in product(*map(range, count[:-1])):
                        value = np.full(b - a, np.nan)
                        value[:here] = got[place]
                        found[k, tuple(s + p for s, p in zip(start, place))] = value
                arrays = [found[k, place] for k, place, _ in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), *[pa.array(x, mask=np.isnan(x) | np.isin(x, (MISSING, float(np.float32(MISSING))))) for x in arrays]], names=[ROW, *[c[2] for c in columns]])

    schema = ", ".join([f"{ROW} long", *["`" + c[2].replace("`", "``") + "` double" for c in columns]])
    geometry = Geometry(tuple(reversed(boxes[0][1]))) if volume else None
    return spark.range(n_tasks, numPartitions=n_tasks).mapInArrow(read, schema), geometry
