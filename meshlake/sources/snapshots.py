"""Snapshots of particle simulations: two block formats with a table for each species, interleaved triples, and mesh-code particles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from .fields import Field, beside, opened, read_fields

#: Fixed values of the block formats: the species, the blocks, those with three values a particle, and the order of blocks without tags.
SPECIES = ("GAS", "HALO", "DISK", "BULGE", "STARS", "BNDRY")
BLOCKS = ("POS", "VEL", "ID", "MASS", "U", "RHO", "HSML", "POT", "ACCE", "ENDT", "TSTP")
VECTORS = ("POS", "VEL", "ACCE")
UNTAGGED = BLOCKS[:7]
HEADER_BYTES = 256


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A table for each species that has particles, of both formats and byte orders, which the first number tells.

    A block holds the species in turn.  One that is too short for all of them holds gas
    only, or (masses) the species that have no common mass in the header; a common mass
    comes as a constant column.  Unknown blocks are left out.
    """
    with opened(path) as f:
        end = f.size()
        mark = f.read(4)
        order = next((o for o in "<>" if int(np.frombuffer(mark, f"{o}i4")[0]) in (8, HEADER_BYTES)), None)
        if order is None:
            raise ValueError("not a snapshot")
        tagged = int(np.frombuffer(mark, f"{order}i4")[0]) == 8
        number = lambda raw: int(np.frombuffer(raw, f"{order}u4")[0])
        f.seek(16 if tagged else 0)
        if number(f.read(4)) != HEADER_BYTES:
            raise ValueError("a snapshot without its header")
        head_at, head = f.tell(), f.read(HEADER_BYTES)
        n = np.frombuffer(head, f"{order}u4", 6).astype(np.int64)
        mass = np.frombuffer(head, f"{order}f8", 6, 24)
        at = f.tell() + 4
        found: list[tuple[str, int, int]] = []
        while at + 4 <= end:
            f.seek(at)
            if tagged:
                f.seek(at + 4)
                name = f.read(4).decode("ascii", "replace").strip()
                at += 16
            else:
                name = UNTAGGED[len(found)] if len(found) < len(UNTAGGED) else ""
                if name == "MASS" and not np.any((mass == 0) & (n > 0)):
                    found.append(("MASS", at, 0))  # no such block where all masses are common
                    continue
            f.seek(at)
            size = number(f.read(4))
            found.append((name, at + 4, size))
            at += size + 8
    if all(name != "MASS" for name, _, _ in found):
        found.append(("MASS", 0, 0))
    return {s: read_fields(spark, path, int(n[k]), _fields(found, n, mass, k, order, head_at)) for k, s in enumerate(SPECIES) if n[k]}


def _fields(found: list[tuple[str, int, int]], n: np.ndarray, mass: np.ndarray, k: int, order: str, head_at: int) -> list[Field]:
    """Where the values of species ``k`` are, in blocks of (name, first byte, bytes); a common mass is read from the header."""
    fields = []
    for name, at, size in found:
        if name not in BLOCKS:
            continue
        width = 3 if name in VECTORS else 1
        own = mass == 0
        for has in (np.ones(6, bool), own & (name == "MASS"), np.arange(6) == 0):
            total = int(n[has].sum()) * width
            if has[k] and total and size in (4 * total, 8 * total):
                bytes_ = size // total
                kind = f"{order}{'u' if name == 'ID' else 'f'}{bytes_}"
                first = at + int((n * has)[:k].sum()) * width * bytes_
                names = [f"{name}_{c}" for c in "XYZ"] if width == 3 else [name]
                fields += [Field(c, first + j * bytes_, width * bytes_, kind) for j, c in enumerate(names)]
                break
        else:
            if name == "MASS" and mass[k]:
                fields.append(Field("MASS", head_at + 24 + 8 * k, 0, f"{order}f8"))
    return fields


def read_triples(spark: SparkSession, path: str, n_points: int | None = None, double: bool = False, big_endian: bool = False) -> dict[float, DataFrame]:
    """``X Y Z Vx Vy Vz`` of a file with all positions and then all velocities, interleaved, by time.

    ``path`` is the data file, with ``n_points``; or without it a descriptor: its kind
    (flyDesc), a name, the element type, the kind of time, the points, three dimensions,
    the byte order, and a time and a file each.
    """
    if n_points is not None:
        return {0.0: _triples(spark, path, n_points, double, big_endian)}
    with opened(path) as f:
        words = f.read().decode().split()
    if words[0] != "flyDesc":
        raise ValueError("not a descriptor of interleaved particles")
    double, n, big = words[2].lower() not in ("float", "f"), int(words[4]), words[8].lower().startswith("b")
    return {float(t): _triples(spark, beside(path, name), n, double, big) for t, name in zip(words[9::2], words[10::2])}


def _triples(spark: SparkSession, path: str, n: int, double: bool, big: bool) -> DataFrame:
    size, kind = (8, "f8") if double else (4, "f4")
    kind = (">" if big else "<") + kind
    fields = [Field(c, (3 * n * block + j) * size, 3 * size, kind) for block, names in enumerate((("X", "Y", "Z"), ("Vx", "Vy", "Vz"))) for j, c in enumerate(names)]
    return read_fields(spark, path, n, fields)


def read_mesh_particles(spark: SparkSession, folder: str, pattern: str = "part_") -> DataFrame:
    """``X Y Z`` of the particles of a mesh code: the files of all processors in name order, of records between their sizes.

    The records are the number of processors, that of dimensions, that of particles, five
    of no use here, and the positions along each axis as doubles; an axis that is not
    there is missing.
    """
    fs, at = pafs.FileSystem.from_uri(folder)
    names = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(at)) if x.base_name.startswith(pattern))
    scheme = folder[: len(folder) - len(at)]
    parts, first = [], 0
    for name in names:
        with fs.open_input_file(name) as f:
            place, records = 0, []
            while len(records) < 11 and place + 4 <= f.size():
                f.seek(place)
                size = int(np.frombuffer(f.read(4), "<i4")[0])
                records.append((place + 4, size))
                place += size + 8
            f.seek(records[1][0])
            n_axes = int(np.frombuffer(f.read(4), "<i4")[0])
            f.seek(records[2][0])
            n = int(np.frombuffer(f.read(4), "<i4")[0])
        fields = [Field(c, records[8 + k][0], 8, "<f8") if k < n_axes else Field(c, 0, 0, None) for k, c in enumerate("XYZ")]
        parts.append(read_fields(spark, scheme + name, n, fields, first))
        first += n
    if not parts:
        raise ValueError(f"no file of the name {pattern}* in {folder}")
    return reduce(DataFrame.unionByName, parts)
