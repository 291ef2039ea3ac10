"""FITS binary tables and images, read by ranges of rows or pixels."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..model import Geometry
from .fields import Field, opened, read_fields

#: Fixed values of the format: bytes of a block and of a card, and element types by letter and by bits of a pixel.
BLOCK, CARD = 2880, 80
LETTERS = {"L": ("bool", 1), "X": (None, 0), "B": (">u1", 1), "I": (">i2", 2), "J": (">i4", 4), "K": (">i8", 8), "A": (None, 1), "E": (">f4", 4), "D": (">f8", 8), "C": (">f4", 8), "M": (">f8", 16), "P": (None, 8), "Q": (None, 16)}
PIXELS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


@dataclass(frozen=True)
class Unit:
    """A header and where its data begin."""

    cards: dict[str, object]
    data: int

    def axes(self) -> list[int]:
        return [int(self.cards[f"NAXIS{k + 1}"]) for k in range(int(self.cards.get("NAXIS", 0)))]

    def data_bytes(self) -> int:
        n = 1 if self.axes() else 0
        for x in self.axes():
            n *= x
        return abs(int(self.cards["BITPIX"])) // 8 * int(self.cards.get("GCOUNT", 1)) * (int(self.cards.get("PCOUNT", 0)) + n)


def _value(card: str) -> object:
    text = card[10:].strip()
    if text.startswith("'"):
        return re.match(r"'((?:[^']|'')*)'", text)[1].replace("''", "'").rstrip() if re.match(r"'((?:[^']|'')*)'", text) else ""
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text


def units(path: str) -> list[Unit]:
    """All headers of a file, in turn; only headers are read."""
    out, at = [], 0
    with opened(path) as f:
        size = f.size()
        while at + BLOCK <= size:
            cards: dict[str, object] = {}
            ended = False
            while not ended and at + BLOCK <= size:
                f.seek(at)
                raw = f.read(BLOCK).decode("ascii", "replace")
                at += BLOCK
                for k in range(0, BLOCK, CARD):
                    card = raw[k : k + CARD]
                    if card[:8].strip() == "END":
                        ended = True
                        break
                    if card[8:10] == "= ":
                        cards.setdefault(card[:8].strip(), _value(card))
            if not out and "SIMPLE" not in cards:
                raise ValueError("not a FITS file")
            out.append(Unit(cards, at))
            at += -(-out[-1].data_bytes() // BLOCK) * BLOCK
    return out


def read_fits_table(spark: SparkSession, path: str, unit: int = 1) -> DataFrame:
    """``__row`` and the columns of a binary table as doubles.

    A column with several values in a row comes as ``<name>_0``, ``<name>_1`` and so on, a
    complex one with its parts in turn.  Values are scaled by the header; those that it
    names as missing, NaN, text, bits and arrays of variable length come as NULL.
    """
    found = units(path)
    if unit >= len(found) or found[unit].cards.get("XTENSION") != "BINTABLE":
        raise ValueError("not a binary table")
    u = found[unit]
    width, n_rows = u.axes()
    fields, at = [], u.data
    for k in range(1, int(u.cards["TFIELDS"]) + 1):
        repeat, letter = re.match(r"(\d*)([A-Z])", str(u.cards[f"TFORM{k}"])).groups()
        repeat = int(repeat) if repeat else 1
        dtype, size = LETTERS[letter]
        name = str(u.cards.get(f"TTYPE{k}", f"col{k}"))
        n_bytes = -(-repeat // 8) if letter == "X" else repeat * size
        each = 2 * repeat if letter in "CM" else 1 if letter in "AXPQ" and repeat else repeat
        step = size // 2 if letter in "CM" else size
        null = u.cards.get(f"TNULL{k}")
        for j in range(each):
            own = name if each == 1 else f"{name}_{j}"
            fields.append(Field(own, at + j * step, width, dtype, null, float(u.cards.get(f"TSCAL{k}", 1.0)), float(u.cards.get(f"TZERO{k}", 0.0))))
        at += n_bytes
    return read_fields(spark, path, n_rows, fields)


def read_fits_image(spark: SparkSession, path: str, unit: int = 0, volume: bool = False, name: str | None = None) -> tuple[DataFrame, Geometry]:
    """An image's planes, or with ``volume`` its cubes, each as a column, and the geometry; x runs fastest.

    Several of them are named ``<name>_0`` and so on; ``name`` is the file's by default.
    Pixels are scaled by the header, its blank value and NaN come as NULL.
    """
    u = units(path)[unit]
    axes, taken = u.axes(), 3 if volume else 2
    if len(axes) < taken:
        raise ValueError(f"an image of {len(axes)} axes")
    cells = 1
    for x in axes[:taken]:
        cells *= x
    n = 1
    for x in axes[taken:]:
        n *= x
    dtype = PIXELS[int(u.cards["BITPIX"])]
    size = abs(int(u.cards["BITPIX"])) // 8
    name = name or path.rpartition("/")[2].rpartition(".")[0]
    scale, zero = float(u.cards.get("BSCALE", 1.0)), float(u.cards.get("BZERO", 0.0))
    fields = [Field(name if len(axes) == taken else f"{name}_{k}", u.data + k * cells * size, size, dtype, u.cards.get("BLANK"), scale, zero) for k in range(n)]
    return read_fields(spark, path, cells, fields), Geometry(tuple([*axes[:taken], 1][:3]))
