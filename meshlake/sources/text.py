"""Text tables: white-space separated, comma separated, and VOTable; and listings of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ROW, data_columns

#: Columns of a muon event table, as the format fixes them.
MUON_COLUMNS = ("id_Ev", "X_A", "Y_B", "X_C", "Y_D", "X_E", "Y_F", "X_G", "Y_H", "energy")


def unique_names(names: Sequence[str]) -> list[str]:
    """Later ones of equal names get ``_1``, ``_2``, ..."""
    seen: Counter[str] = Counter()
    out = []
    for name in names:
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return out


#: What the formats take for a number: a sign, digits with one point, an exponent.  All else is text.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


#: Behind a column's name, the name of the column that says why a value is NULL.
REASON = "__reason"


def reason(text: Column) -> Column:
    """``missing`` where there is nothing, ``text`` where there is no number, else NULL."""
    return F.when(text.isNull() | (F.trim(text) == ""), "missing").when(number(text).isNull(), "text")


def told(cells: Sequence[tuple[Column, str]], reasons: bool) -> list[Column]:
    """Numbers by name; with ``reasons``, a column of reasons beside each."""
    return [x for c, name in cells for x in (number(c).alias(name), *([reason(c).alias(name + REASON)] if reasons else []))]


def _numbers(lines: DataFrame, parts: Column, names: Sequence[str], reasons: bool = False) -> DataFrame:
    return lines.select(parts.alias("p")).select(*told([(F.try_element_at("p", F.lit(k)), c) for k, c in enumerate(names, 1)], reasons))


def read_ascii(spark: SparkSession, path: str, names: Sequence[str] | None = None, reasons: bool = False) -> DataFrame:
    """The first line that is no ``#`` comment has the names; short rows and text come as NULL (``reasons``: see ``told``).  Rows have no position yet (``model.with_row``)."""
    # the header is told by its place, as a row may have the same text
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    lines = lines.where(~F.col("value").startswith("#") & (F.trim(F.regexp_replace("value", "\t", " ")) != ""))
    parts = F.split(F.trim(F.regexp_replace("value", "\t", " ")), " +")
    if names is None:
        first = lines.orderBy("at").first()
        names = unique_names(first["value"].replace("\t", " ").split()) if first else []
        lines = lines.where(F.col("at") != first["at"]) if first else lines
    return _numbers(lines, parts, names, reasons)


def read_muons(spark: SparkSession, path: str) -> DataFrame:
    return read_ascii(spark, path, MUON_COLUMNS)


def read_csv(spark: SparkSession, path: str, reasons: bool = False) -> DataFrame:
    """Names from the first line, trimmed and without ``#``; empty cells and text come as NULL (``reasons``: see ``told``)."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = unique_names([c.strip().lstrip("#").strip() for c in raw.columns])
    return raw.toDF(*names).select(*told([(F.col(f"`{c}`"), c) for c in names], reasons))


def read_votable(spark: SparkSession, path: str, reasons: bool = False) -> DataFrame:
    """The cells of all TR rows, named by the FIELD elements; what is no number comes as NULL (``reasons``: see ``told``)."""
    lines = spark.read.option("lineSep", "</TR>").text(path)
    head = spark.read.option("lineSep", "<DATA>").text(path).first()
    names = unique_names(_attribute(head["value"] if head else "", "FIELD", "name"))
    cells = F.regexp_extract_all("value", F.lit(r"(?s)<TD[^>]*>(.*?)</TD>|<TD\s*(/)>"), 1)
    return _numbers(lines.where(F.col("value").contains("<TD")), F.transform(cells, lambda x: F.trim(x)), names, reasons)


def _attribute(text: str, tag: str, name: str) -> list[str]:
    out = []
    for part in text.split(f"<{tag} ")[1:]:
        value = part.split(">", 1)[0].split(f'{name}="', 1)
        out.append(value[1].split('"', 1)[0] if len(value) > 1 else "")
    return out


def write_votable(df: DataFrame, path: str, force: bool = False, most: int = 1_000_000) -> None:
    """VOTable XML in float fields, in row order: part files that make one document when put end to end.  More than ``most`` rows need ``force``."""
    if not force and df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows need force")
    names = data_columns(df)
    fields = "".join(f'<FIELD name="{c}" datatype="float"/>' for c in names)
    head = f'<?xml version="1.0"?><VOTABLE version="1.2"><RESOURCE><TABLE>{fields}<DATA><TABLEDATA>'
    cells = F.concat(F.lit("<TR>"), *[F.concat(F.lit("<TD>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</TD>")) for c in names], F.lit("</TR>"))
    body = df.select(F.lit(1).alias("k"), F.col(ROW), cells.alias("value"))
    ends = df.sparkSession.createDataFrame([(0, 0, head), (2, 0, "</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>")], f"k int, {ROW} long, value string")
    body.union(ends).orderBy("k", ROW).select("value").write.text(path)


def show_table(df: DataFrame, fields: Sequence[str] | None = None, rows: tuple[int, int] | None = None, n_rows: int | None = None, width: int = 10, precision: int = 8) -> DataFrame:
    """``__row`` and a fixed-width ``line`` of chosen columns, for positions between two (both included) or the first ``n_rows``."""
    low, high = rows if rows else (0, n_rows - 1 if n_rows is not None else None)
    found = df.where(F.col(ROW) >= low)
    found = found.where(F.col(ROW) <= high) if high is not None else found
    short = lambda c: F.regexp_replace(F.round(F.col(c).cast("double"), precision).cast("string"), r"\.0$", "")
    cells = [F.lpad(F.coalesce(short(c), F.lit("")), width, " ") for c in fields or data_columns(df)]
    return found.select(ROW, F.concat_ws(" ", *cells).alias("line")).orderBy(ROW)
