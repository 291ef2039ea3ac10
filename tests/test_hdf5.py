"""HDF5 data sets: both kinds of header, all storages, hyperslabs; the files are made here, byte by byte."""

from __future__ import annotations

import zlib
from itertools import product

import numpy as np
import pytest

from meshlake.model import ROW
from meshlake.plans.source_queries import _hdf5
from meshlake.sources import hdf5

UNDEFINED = b"\xff" * 8


def number(x, width=8):
    return int(x).to_bytes(width, "little")


def type_message(dtype):
    order = dtype.byteorder == ">"
    return (bytes([0x11, 0x20 | order, 63, 0]) if dtype.kind == "f" else bytes([0x10, (8 if dtype.kind == "i" else 0) | order, 0, 0])) + number(dtype.itemsize, 4) + bytes(12)


class File:
    """Bytes that grow; ``second`` writes headers of version 2, with links."""

    def __init__(self, second):
        self.raw, self.second = bytearray(512 + 96), second  # a user block before the superblock

    def put(self, data):
        self.raw += bytes(-len(self.raw) % 8)
        self.raw += data
        return len(self.raw) - len(data) - 512

    def header(self, *messages):
        if self.second:
            # the last message goes into a continued block
            lead = lambda kind, raw: bytes([kind]) + number(len(raw), 2) + bytes(1) + raw
            more = self.put(b"OCHK" + lead(*messages[-1]) + bytes(4))
            body = b"".join(lead(*m) for m in messages[:-1]) + lead(0x10, number(more) + number(8 + 4 + len(messages[-1][1])))
            return self.put(b"OHDR" + bytes([2, 2]) + number(len(body), 4) + body + bytes(4))
        padded = [(k, r.ljust(-(-len(r) // 8) * 8, b"\0")) for k, r in messages]
        body = b"".join(number(k, 2) + number(len(r), 2) + bytes(4) + r for k, r in padded)
        return self.put(bytes([1, 0]) + number(len(messages), 2) + number(1, 4) + number(len(body), 4) + bytes(4) + body)

    def group(self, members):
        names = sorted(members)
        if self.second:
            links = [(6, bytes([1, 0, len(n)]) + n.encode() + number(members[n])) for n in names]
            return self.header((2, bytes(2) + UNDEFINED * 2), *links)
        text, starts = bytearray(8), []
        for n in names:
            starts.append(len(text))
            text += n.encode() + b"\0"
        heap = self.put(b"HEAP" + bytes(4) + number(len(text)) + UNDEFINED + number(self.put(text)))
        leaves = []
        for k in range(0, len(names), 2):  # two names a leaf
            part = list(zip(starts, names))[k : k + 2]
            leaves.append(self.put(b"SNOD" + bytes([1, 0]) + number(len(part), 2) + b"".join(number(s) + number(members[n]) + bytes(24) for s, n in part)))
        tree = self.put(b"TREE" + bytes([0, 0]) + number(len(leaves), 2) + UNDEFINED * 2 + number(0) + b"".join(number(x) + number(0) for x in leaves))
        return self.header((0x11, number(tree) + number(heap)))

    def data(self, x, storage, chunk=None, filters=(), fill=None, absent=(), fan=3):
        rank = x.ndim
        space = bytes([2, rank, 0, 1]) + b"".join(map(number, x.shape)) if self.second else bytes([1, rank, 0, 0, 0, 0, 0, 0]) + b"".join(map(number, x.shape))
        more = [(1, space), (3, type_message(x.dtype))]
        if fill is not None:
            value = np.array(fill, x.dtype).tobytes()
            more.append((5, (bytes([3, 0x20]) if self.second else bytes([2, 2, 2, 1])) + number(len(value), 4) + value))
        if filters:
            values = {1: [6], 2: [x.dtype.itemsize], 3: []}
            if self.second:
                more.append((11, bytes([2, len(filters)]) + b"".join(number(f, 2) + number(0, 2) + number(len(values[f]), 2) + b"".join(number(v, 4) for v in values[f]) for f in filters)))
            else:
                more.append((11, bytes([1, len(filters)]) + bytes(6) + b"".join(number(f, 2) + number(8, 2) + number(0, 2) + number(len(values[f]), 2) + b"name\0\0\0\0" + b"".join(number(v, 4) for v in values[f]) + bytes(4 * (len(values[f]) % 2)) for f in filters)))
        if storage == "compact":
            layout = bytes([3, 0]) + number(x.nbytes, 2) + x.tobytes()
        elif storage == "contiguous":
            layout = bytes([3, 1]) + number(self.put(x.tobytes())) + number(x.nbytes)
        elif storage == "none":
            layout = bytes([3, 1]) + UNDEFINED + number(x.nbytes)
        elif storage in ("single", "rowwise"):
            chunk = x.shape if storage == "single" else chunk
            parts = [self.encoded(x, at, chunk, filters) for at in product(*(range(0, s, c) for s, c in zip(x.shape, chunk)))]
            at = self.put(b"".join(parts))
            tail = bytes([1]) + number(len(parts[0])) + number(0, 4) if filters else bytes([1]) if storage == "single" else bytes([2])
            layout = bytes([4, 2, 2 if filters else 0, rank + 1, 4]) + b"".join(number(c, 4) for c in (*chunk, x.dtype.itemsize)) + tail + number(at)
        else:
            leaves = []
            for at in product(*(range(0, s, c) for s, c in zip(x.shape, chunk))):
                if at not in absent:
                    raw = self.encoded(x, at, chunk, filters)
                    leaves.append((number(len(raw), 4) + number(0, 4) + b"".join(map(number, (*at, 0))), self.put(raw)))
            end = number(0, 4) * 2 + b"".join(map(number, (*x.shape, 0)))
            level = 0
            while True:
                level_nodes = []
                for k in range(0, len(leaves), fan):
                    part = leaves[k : k + fan]
                    last = leaves[k + fan][0] if k + fan < len(leaves) else end
                    level_nodes.append((part[0][0], self.put(b"TREE" + bytes([1, level]) + number(len(part), 2) + UNDEFINED * 2 + b"".join(key + number(child) for key, child in part) + last)))
                leaves, level = level_nodes, level + 1
                if len(leaves) == 1:
                    break
            layout = bytes([3, 2, rank + 1]) + number(leaves[0][1]) + b"".join(number(c, 4) for c in (*chunk, x.dtype.itemsize))
        return self.header(*more, (8, layout))

    @staticmethod
    def encoded(x, at, chunk, filters):
        part = np.zeros(chunk, x.dtype)
        got = x[tuple(slice(a, a + c) for a, c in zip(at, chunk))]
        part[tuple(slice(0, n) for n in got.shape)] = got
        raw = part.tobytes()
        for f in filters:
            raw = zlib.compress(raw) if f == 1 else np.frombuffer(raw, np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() if f == 2 else raw + b"sum!"
        return raw

    def write(self, path, root):
        sign = b"\x89HDF\r\n\x1a\n"
        if self.second:
            block = sign + bytes([2, 8, 8, 0]) + number(512) + UNDEFINED + number(len(self.raw)) + number(root) + bytes(4)
        else:
            block = sign + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + number(4, 2) + number(16, 2) + bytes(4) + number(512) + UNDEFINED + number(len(self.raw)) + UNDEFINED + number(0) + number(root) + bytes(24)
        self.raw[512 : 512 + len(block)] = block
        path.write_bytes(bytes(self.raw))
        return f"file://{path}"


LINE = np.arange(1000, dtype="<f8") * 1.5
GRID = np.arange(4 * 50, dtype=">i4").reshape(4, 50)
CUBE = np.arange(6 * 5 * 7, dtype="<f4").reshape(6, 5, 7)
KINDS = [("contiguous", {}), ("compact", {}), ("tree", {}), ("tree", {"filters": (2, 1)}), ("tree", {"filters": (2, 1, 3)}), ("single", {}), ("single", {"filters": (1,)}), ("rowwise", {})]


def rows_of(df):
    return [tuple(r) for r in df.orderBy(ROW).collect()]


@pytest.mark.parametrize("second", [False, True])
@pytest.mark.parametrize("storage,more", KINDS)
def test_all_storages(spark, tmp_path, second, storage, more):
    f = File(second)
    chunks = {1: (64,), 2: (3, 8), 3: (2, 4, 3)}
    sets = {n: f.data(x, storage, chunks[x.ndim], **more) for n, x in (("line", LINE), ("grid", GRID), ("cube", CUBE), ("more", LINE[:5]), ("other", LINE))}
    path = f.write(tmp_path / "t.h5", f.group({"top": f.group({"in": f.group(sets)}), "x": sets["line"]}))
    got, _ = hdf5.read_hdf5(spark, path, ["top/in/line", "/x"], values=100)
    assert rows_of(got) == [(k, v, v) for k, v in enumerate(LINE.tolist())] and got.columns == [ROW, "line", "x"]
    got, _ = hdf5.read_hdf5(spark, path, ["top/in/grid", "top/in/more"], {"top/in/grid": ([1, 10], [2, 100])}, values=30)
    assert got.columns == [ROW, "grid_1", "grid_2", "more"]
    assert rows_of(got) == [(k, float(GRID[1, 10 + k]), float(GRID[2, 10 + k]), LINE[k] if k < 5 else None) for k in range(40)]
    box, geometry = hdf5.read_hdf5(spark, path, ["top/in/cube"], {"top/in/cube": ([1, 2, 3], [4, 2, 4])}, True, values=10)
    assert geometry.n == (4, 2, 4) and [r[1] for r in rows_of(box)] == CUBE[1:5, 2:4, 3:7].reshape(-1).tolist()
    flat, _ = hdf5.read_hdf5(spark, path, ["top/in/cube"])
    assert flat.columns[1:] == [f"cube_{i}_{j}" for i in range(6) for j in range(5)]
    assert [list(r)[1:] for r in rows_of(flat)] == CUBE.reshape(30, 7).T.tolist()


def test_missing_chunks_and_marks(spark, tmp_path):
    f = File(False)
    x = LINE[:100].copy()
    x[[3, 50]] = np.nan, -1.0918273645e23
    sets = {"a": f.data(x, "tree", (16,), fill=7.5, absent={(32,), (64,)}), "b": f.data(x, "none", fill=2.0), "c": f.data(x, "none")}
    path = f.write(tmp_path / "t.h5", f.group(sets))
    got = rows_of(hdf5.read_hdf5(spark, path, ["a", "b", "c"])[0])
    want = [7.5 if 32 <= k < 48 or 64 <= k < 80 else None if k in (3, 50) else v for k, v in enumerate(x.tolist())]
    assert [r[1] for r in got] == want and {r[2:] for r in got} == {(2.0, 0.0)}


def test_a_task_goes_down_its_own_branches(tmp_path):
    """Blocks of the tree that cannot hold the rows are not read."""
    f = File(False)
    path = f.write(tmp_path / "t.h5", f.group({"a": f.data(np.arange(4096, dtype="<i8"), "tree", (8,), fan=4)}))
    d = hdf5.data_set(path, "a")
    import pyarrow.fs as pafs

    with pafs.LocalFileSystem().open_input_file(path.removeprefix("file://")) as file:
        reader = d.reader(file)
        reads, real = [], reader.at
        reader.at = lambda place, n: reads.append(n) or real(place, n)
        assert d.read(reader, [2050], [5]).tolist() == [2050, 2051, 2052, 2053, 2054]
    assert len(reads) <= 2 * 2 * 5 + 1  # of 512 chunks in five levels


def test_the_fixture_of_the_query(spark, tmp_path):
    (tmp_path / "q.h5").write_bytes(_hdf5({"b": LINE[:7], "a": GRID}))
    assert rows_of(hdf5.read_hdf5(spark, f"file://{tmp_path}/q.h5", ["b"])[0]) == list(enumerate(LINE[:7].tolist()))
    assert len(rows_of(hdf5.read_hdf5(spark, f"file://{tmp_path}/q.h5", ["a"])[0])) == 50


def test_files_and_slabs_that_do_not_fit(spark, tmp_path):
    f = File(True)
    path = f.write(tmp_path / "t.h5", f.group({"a": f.data(LINE, "contiguous"), "g": f.group({"a": f.data(LINE, "contiguous"), "z": f.data(CUBE, "compact")})}))
    for names, slabs, volume in ((["none"], None, False), (["a", "g/a"], None, False), (["g"], None, False), (["a"], {"a": ([1000], [1])}, False), (["a"], {"a": ([0, 0], [1, 1])}, False), (["a"], {"a": ([0], [0])}, False), (["a"], None, True), (["g/z", "a"], None, True)):
        with pytest.raises(ValueError):
            hdf5.read_hdf5(spark, path, names, slabs, volume)
    (tmp_path / "no.h5").write_bytes(b"text" * 300)
    with pytest.raises(ValueError, match="not an HDF5"):
        hdf5.read_hdf5(spark, f"file://{tmp_path}/no.h5", ["a"])
    cut = (tmp_path / "t.h5").read_bytes()[:3000]
    (tmp_path / "cut.h5").write_bytes(cut)
    with pytest.raises(Exception):
        hdf5.read_hdf5(spark, f"file://{tmp_path}/cut.h5", ["a"])[0].collect()
