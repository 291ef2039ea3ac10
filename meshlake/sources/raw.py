"""Raw points and grids with a text descriptor, and tables whose columns an XML descriptor tells."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..model import Geometry
from .fields import Field, beside, opened, read_fields

#: Element types that an XML descriptor names, with their kinds.
KINDS = {"float": "f", "double": "f", "long double": "f", "int": "i", "long int": "i", "long long int": "i"}


def _words(path: str, kind: str) -> list[str]:
    with opened(path) as f:
        words = f.read().decode().split()
    if not words or words[0] != kind:
        raise ValueError(f"not a descriptor of the kind {kind}")
    return words


def _number(word: str) -> str:
    return "f8" if word.lower() in ("double", "d") else "f4"


def _order(word: str) -> str:
    return ">" if word.lower().startswith("b") else "<"


def read_points(spark: SparkSession, path: str) -> dict[float, DataFrame]:
    """Interleaved triples as ``X Y Z``, a table for each time.

    The descriptor has its kind (rawPointsDesc), a name, the element type, the kind of
    time, the points, three dimensions, the byte order, and a time and a file each.
    """
    words = _words(path, "rawPointsDesc")
    kind, n = _order(words[8]) + _number(words[2]), int(words[4])
    size = np.dtype(kind).itemsize
    fields = [Field(c, k * size, 3 * size, kind) for k, c in enumerate("XYZ")]
    return {float(t): read_fields(spark, beside(path, name), n, fields) for t, name in zip(words[9::2], words[10::2])}


def read_grids(spark: SparkSession, path: str) -> tuple[dict[float, DataFrame], Geometry]:
    """Volumes of one field, by time, and their geometry; fewer than three axes are filled up with one cell.

    The descriptor has its kind (rawGridsDesc), the field's name, the axes, the element
    type, the cells along each axis, the kind of time, the byte order, and a time and a
    file each.
    """
    words = _words(path, "rawGridsDesc")
    name, axes = words[1], int(words[2])
    cells = [int(x) for x in words[4 : 4 + axes]]
    kind = _order(words[5 + axes]) + _number(words[3])
    geometry = Geometry(tuple([*cells, 1, 1][:3]))
    fields = [Field(name, 0, np.dtype(kind).itemsize, kind)]
    rest = words[6 + axes :]
    return {float(t): read_fields(spark, beside(path, file), geometry.cells, fields) for t, file in zip(rest[::2], rest[1::2])}, geometry


def read_described(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A table for each species of an XML descriptor.

    Each TR row tells one field by the columns that the FIELD elements name: Species,
    Field, Type, Precision (bytes of an element), Offset, Href, Stride (bytes between the
    end of an element and the next row's), Endianism, Rank (values in a row, side by side,
    named ``<field>__1`` and so on) and Arraysize (rows).  Fields of unknown types, or of a size that is not their type's,
    are left out.  A species has as many rows as its longest field.
    """
    with opened(path) as f:
        root = ElementTree.fromstring(re.sub(r'\sxmlns="[^"]*"', "", f.read().decode(), count=1))
    names = [x.get("name") for x in root.iter("FIELD")]
    fields: dict[str, dict[str, list[Field]]] = {}
    rows: dict[str, int] = {}
    for tr in root.iter("TR"):
        cell = dict(zip(names, ((td.text or "").strip() for td in tr.iter("TD"))))
        kind, size, rank = KINDS.get(cell["Type"].lower()), int(cell["Precision"]), int(cell["Rank"] or 1)
        if kind is None or size not in (4, 8, 16) or (cell["Type"].lower(), size) in (("float", 8), ("double", 4), ("int", 8)):
            continue
        dtype = (_order(cell["Endianism"]) if "b" in cell["Endianism"].lower() else "<") + f"{kind}{size}"
        gap = size + int(cell.get("Stride") or 0)
        own = [Field(cell["Field"] if rank == 1 else f"{cell['Field']}__{k + 1}", int(cell["Offset"] or 0) + k * size, gap, dtype) for k in range(rank)]
        species = cell["Species"]
        fields.setdefault(species, {}).setdefault(beside(path, cell["Href"]), []).extend(own)
        rows[species] = max(rows.get(species, 0), int(cell["Arraysize"]))
    out = {}
    for species, files in fields.items():
        table = None
        for file, own in files.items():
            part = read_fields(spark, file, rows[species], own)
            table = part if table is None else table.join(part, "__row", "full")
        out[species] = table
    return out
