"""A query for each source: it writes a test table in the source's format, to the shared folder, and reads it back."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import flows, registry
from ..model import ROW, Geometry, declared, dense, new_folder, with_row
from ..operators import combine, grid, rows, stats
from ..sources import binary, fits, hdf5, multilist, raw, snapshots, tables, text
from .queries import ORD, PRT, PTS, XYZ, query, rounded
from .tables import orders, parts, points, table

#: Rows of a file, and of one where many are wanted even of a small table.
FILE_ROWS, PART_ROWS = 1 << 20, 1 << 16

Encode = Callable[[pa.Table, str], dict[str, bytes]]


def files(df: DataFrame, encode: Encode) -> list[tuple[str, int]]:
    """Write ranges of positions as files, in tasks; the first file of each range, with its first position.

    ``encode`` gives the files of a range from its rows, in order, and the range's name.
    """
    folder = new_folder(df.sparkSession)

    def write(group: pa.Table) -> pa.Table:
        group = group.sort_by(ROW)
        first = group[ROW][0].as_py()
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        made = encode(group.drop_columns("__part"), f"part-{first:012d}")
        for name, data in made.items():
            with fs.open_output_stream(posixpath.join(at, name)) as f:
                f.write(data)
        return pa.table({"file": [f"{folder}/{next(iter(made))}"], "first": pa.array([first], pa.int64())})

    dealt = df.withColumn("__part", F.floor(F.col(ROW) / FILE_ROWS))
    return sorted(map(tuple, dealt.groupBy("__part").applyInArrow(write, "file string, first long").collect()), key=lambda x: x[1])


def together(found: list[tuple[str, int]], read: Callable[[str], DataFrame]) -> DataFrame:
    """The files' rows; positions within a file, where it has them, become those of the whole."""
    frames = [read(f).withColumn(ROW, F.col(ROW) + F.lit(first)) if ROW in read(f).columns else read(f) for f, first in found]
    return reduce(DataFrame.unionByName, frames)


def array(group: pa.Table, names: tuple[str, ...] | list[str], kind: str) -> bytes:
    """Rows of interleaved numbers."""
    return np.stack([group[c].to_numpy() for c in names], 1).astype(kind).tobytes()


# text


def _text(sign: str, head: str) -> Encode:
    def encode(group: pa.Table, name: str) -> dict[str, bytes]:
        body = "".join(f"{int(r)}{sign}{p!r}{sign}{c!r}\n" for r, p, c in zip(*(group[x].to_pylist() for x in (ROW, "price", "cust"))))
        return {name + ".txt": (head + body).encode()}

    return encode


def _orders_back(df: DataFrame) -> DataFrame:
    return df.select(F.col("row").cast("long").alias(ROW), "price", "cust")


@query("source_ascii", f"WITH {ORD} SELECT __row, price, cust FROM ord")
def _(spark, d):
    found = files(orders(spark, d), _text("\t ", "# a comment\nrow price  cust\n"))
    return _orders_back(together(found, lambda f: text.read_ascii(spark, f)))


@query("source_csv", f"WITH {ORD} SELECT __row, price, cust FROM ord")
def _(spark, d):
    found = files(orders(spark, d), _text(",", "#row, price ,cust\n"))
    return _orders_back(together(found, lambda f: text.read_csv(spark, f)))


@query("source_votable", f"WITH {ORD} SELECT __row, price, cust FROM ord")
def _(spark, d):
    def encode(group: pa.Table, name: str) -> dict[str, bytes]:
        fields = "".join(f'<FIELD name="{c}" datatype="double"/>' for c in ("row", "price", "cust"))
        body = "".join(f"<TR><TD>{int(r)}</TD><TD> {p!r} </TD><TD>{c!r}</TD></TR>\n" for r, p, c in zip(*(group[x].to_pylist() for x in (ROW, "price", "cust"))))
        return {name + ".xml": f'<?xml version="1.0"?><VOTABLE version="1.2"><RESOURCE><TABLE>{fields}<DATA><TABLEDATA>\n{body}</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>'.encode()}

    return _orders_back(together(files(orders(spark, d), encode), lambda f: text.read_votable(spark, f)))


@query("source_muons", f'WITH {PTS} SELECT CAST(__row AS DOUBLE) AS "id_Ev", X AS "X_A", Y AS "Y_B", Z AS "X_C", X AS "Y_D", Y AS "X_E", Z AS "Y_F", X AS "X_G", Y AS "Y_H", mass AS energy FROM pts')
def _(spark, d):
    def encode(group: pa.Table, name: str) -> dict[str, bytes]:
        columns = [group[c].to_pylist() for c in (ROW, "X", "Y", "Z", "X", "Y", "Z", "X", "Y", "mass")]
        return {name + ".txt": "".join(" ".join(repr(x) for x in r) + "\n" for r in zip(*columns)).encode()}

    return together(files(points(spark, d), encode), lambda f: text.read_muons(spark, f))


# binary tables and lists


@query("source_binary", f"WITH {ORD} SELECT __row, price, cust FROM ord")
def _(spark, d):
    folder = new_folder(spark)
    binary.write_parts(orders(spark, d), folder, "big", kind="long double", rows_per_file=PART_ROWS).collect()
    return tables.read_tables(spark, folder)


@query("source_table_file", f"WITH {ORD} SELECT __row, price, cust FROM ord")
def _(spark, d):
    """One file from all tasks."""
    path = f"{new_folder(spark)}/orders.bin"
    tables.write_table(orders(spark, d), path, "double")
    return tables.read_tables(spark, path, rows_per_task=PART_ROWS)


@query("source_table_rows", f"WITH {ORD} SELECT __row, cust FROM ord WHERE __row BETWEEN (SELECT count(*) // 3 FROM ord) AND (SELECT count(*) // 2 FROM ord)")
def _(spark, d):
    """A range of rows and one column of many files."""
    o, folder = orders(spark, d), new_folder(spark)
    n = o.count()
    binary.write_parts(o, folder, kind="double", rows_per_file=PART_ROWS).collect()
    return tables.read_tables(spark, folder, ["cust"], (n // 3, n // 2))


def cube_side(n: int) -> int:
    """Of the smallest cube with ``n`` cells."""
    return next(s for s in range(max(0, round(n ** (1 / 3)) - 1), n + 1) if s**3 >= n)


@query("source_volume", f"WITH {ORD}, side AS (SELECT min(s) AS s FROM range(1, 1000000) t(s) WHERE s * s * s >= (SELECT count(*) FROM ord)) SELECT c AS __row, price FROM (SELECT unnest(range(s * s * s)) AS c FROM side) LEFT JOIN ord ON __row = c")
def _(spark, d):
    """The smallest cube that holds all orders, as a volume with its header; cells beyond the orders are missing ones."""
    o = orders(spark, d).select(ROW, "price")
    side = cube_side(o.count())
    geometry = declared(side**3)
    folder = new_folder(spark)
    made = binary.write_parts(dense(spark, geometry).join(o, ROW, "left"), folder, geometry=geometry, kind="double", rows_per_file=PART_ROWS).collect()
    plane = geometry.n[0] * geometry.n[1]
    heads = {r["uri"]: binary.read_header(r["uri"] + ".head").geometry for r in made}
    if any(g.n[:2] != geometry.n[:2] or g.n[2] * plane != r["n_rows"] for g, r in zip(heads.values(), made)):
        raise ValueError("a header does not tell its volume")
    return tables.read_tables(spark, folder)


@query("source_swap", f"WITH {ORD} SELECT __row, CAST(CAST(price AS FLOAT) AS DOUBLE) AS price, cust FROM ord")
def _(spark, d):
    little, big = new_folder(spark), new_folder(spark)
    made = binary.write_parts(orders(spark, d), little, "little", rows_per_file=PART_ROWS).collect()
    order = binary.swap_order(binary.read_header(made[0]["uri"] + ".head")).order
    binary.write_parts(tables.read_tables(spark, little), big, order, rows_per_file=PART_ROWS).collect()
    return tables.read_tables(spark, big)


@query("source_row_list", f"WITH {ORD} SELECT row_number() OVER (ORDER BY __row) - 1 AS pos, __row AS row_id FROM ord WHERE price BETWEEN 50000 AND 150000")
def _(spark, d):
    chosen = rows.row_ids(orders(spark, d), {"price": (50000.0, 150000.0)})
    made = sorted(map(tuple, binary.write_rows(chosen, new_folder(spark), "i4").collect()))
    before, out = 0, []
    for file, n in made:
        out.append(binary.read_rows(spark, file, "i4").withColumn("pos", F.col("pos") + F.lit(before)))
        before += n
    return reduce(DataFrame.unionByName, out)


# lists of all orders, one for each customer; customers without orders have empty ones

_ORDER_LISTS = "SELECT o_custkey + 1 AS list_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey AS row_id FROM orders"


def _order_lists(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") + 1).cast("long").alias("list_id"), F.col("o_orderkey").cast("long").alias("pos"), F.col("o_orderkey").cast("long").alias("row_id"))


@query("source_multilist", f"SELECT CAST(list_id AS BIGINT) AS list_id, pos, CAST(row_id AS BIGINT) AS row_id FROM ({_ORDER_LISTS})")
def _(spark, d):
    path = f"{new_folder(spark)}/orders.lst"
    multilist.write_multilist(_order_lists(spark, d), path)
    return multilist.read_multilist(spark, path, task_words=PART_ROWS)


@query("source_multilist_text", f"SELECT CAST(list_id AS BIGINT) AS list_id, pos, CAST(row_id AS BIGINT) AS row_id FROM ({_ORDER_LISTS})")
def _(spark, d):
    """As text, without the number of lists."""
    folder = new_folder(spark)
    n, _ = multilist.write_multilist_text(_order_lists(spark, d), folder, counted=False)
    return multilist.read_multilist(spark, folder, "ascii", n_lists=n, task_words=PART_ROWS)


@query("source_row_list_rows", f"WITH {ORD} SELECT CAST(1 AS BIGINT) AS list_id, CAST(n - 1 - __row AS BIGINT) AS pos, __row AS row_id, price, cust FROM ord, (SELECT count(*) AS n FROM ord)")
def _(spark, d):
    """All rows backwards, from one list without counts."""
    o, path = orders(spark, d), f"{new_folder(spark)}/back.lst"
    multilist.write_multilist(o.select(F.lit(1).alias("list_id"), (-F.col(ROW)).alias("pos"), F.col(ROW).alias("row_id")), path, "i4", counted=False, sized=False)
    return rows.extract_list(o, multilist.read_multilist(spark, path, "i4", one=True, task_words=PART_ROWS))


@query("ahfhalogalaxyext_lists", f"""WITH lists AS ({_ORDER_LISTS}), halos AS (SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 1 WHEN c_nationkey >= 12 THEN 2 WHEN c_acctbal <= 0 THEN 3 END AS route FROM customer),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY c_custkey) AS k FROM halos WHERE route IS NOT NULL)
    SELECT CAST(route AS INTEGER) AS route, CAST(k AS BIGINT) AS list_id, CAST(list_id AS BIGINT) AS old_id, pos, CAST(row_id AS BIGINT) AS row_id FROM lists JOIN numbered ON list_id = c_custkey + 1""")  # fmt: skip
def _(spark, d):
    """From the file of all lists to the ids of each route."""
    path = f"{new_folder(spark)}/halos.lst"
    multilist.write_multilist(_order_lists(spark, d), path)
    c = table(spark, d, "customer")
    balance = F.col("c_acctbal").cast("double")
    halos = c.select(F.col("c_custkey").cast("long").alias(ROW), (balance / 5000).alias("a"), (F.col("c_nationkey") / 12).alias("b"), F.when(balance <= 0, 1.0).otherwise(0.0).alias("c"))
    return rows.halo_routed_lists(multilist.read_multilist(spark, path), halos, ["a", "b", "c"])


# raw files


@query("source_raw_points", f"WITH {PTS} SELECT __row, X, Y, Z FROM pts")
def _(spark, d):
    def encode(group: pa.Table, name: str) -> dict[str, bytes]:
        head = f"rawPointsDesc\nname\nfloat\nlog\n{group.num_rows} 1 1 1\nbig\n0.5 {name}.dat\n"
        return {name + ".desc": head.encode(), name + ".dat": array(group, list(XYZ), ">f4")}

    return together(files(points(spark, d), encode), lambda f: raw.read_points(spark, f)[0.5])


@query("source_raw_grids", f"WITH {PRT} SELECT __row, price FROM prt")
def _(spark, d):
    def encode(group: pa.Table, name: str) -> dict[str, bytes]:
        head = f"rawGridsDesc\nprice\n2\ndouble\n{group.num_rows} 1\nlog\nlittle\n1.0 {name}.dat\n"
        return {name + ".desc": head.encode(), name + ".dat": array(group, ["price"], "<f8")}

    return together(files(parts(spark, d), encode), lambda f: raw.read_grids(spark, f)[0][1.0])


@query("source_triples", f'WITH {PTS} SELECT __row, X, Y, Z, Z AS "Vx", mass AS "Vy", X AS "Vz" FROM pts')
def _(spark, d):
    def encode(group: pa.Table, name: str) -> dict[str, bytes]:
        head = f"flyDesc\nname\ndouble\nlog\n{group.num_rows} 1 1 1\nb\n0 {name}.dat\n"
        return {name + ".desc": head.encode(), name + ".dat": array(group, list(XYZ), ">f8") + array(group, ["Z", "mass", "X"], ">f8")}

    return together(files(points(spark, d), encode), lambda f: snapshots.read_triples(spark, f)[0.0])


@query("source_described", f'WITH {PTS} SELECT __row, X AS "P__1", Y AS "P__2", mass AS "M" FROM pts')
def _(spark, d):
    names = ("Species", "Field", "Type", "Precision", "Offset", "Href", "Stride", "Endianism", "Rank", "Arraysize")

    def encode(group: pa.Table, name: str) -> dict[str, bytes]:
        table = [("gas", "P", "double", 8, 0, f"{name}.dat", 8 + 8, "big", 2, group.num_rows), ("gas", "M", "double", 8, 16, f"{name}.dat", 16, "big", 1, group.num_rows)]
        body = "".join("<TR>" + "".join(f"<TD>{x}</TD>" for x in r) + "</TR>" for r in table)
        fields = "".join(f'<FIELD name="{c}"/>' for c in names)
        return {name + ".xml": f"<VOTABLE><RESOURCE><TABLE>{fields}<DATA><TABLEDATA>{body}</TABLEDATA></DATA></TABLE></RESOURCE></VOTABLE>".encode(), name + ".dat": array(group, ["X", "Y", "mass"], ">f8")}

    return together(files(points(spark, d), encode), lambda f: raw.read_described(spark, f)["gas"])


# snapshots


def _record(data: bytes, order: str, tag: str | None) -> bytes:
    size = lambda n: np.array([n], f"{order}u4").tobytes()
    lead = size(8) + tag.ljust(4).encode() + size(len(data) + 8) + size(8) if tag else b""
    return lead + size(len(data)) + data + size(len(data))


def _snapshot(order: str, tagged: bool, common: bool) -> Encode:
    """Species by the mass; with ``common``, the second one has its mass in the header."""

    def encode(group: pa.Table, name: str) -> dict[str, bytes]:
        kind = group["mass"].to_numpy().astype(int) % 6
        group = group.append_column("kind", pa.array(kind)).sort_by([("kind", "ascending"), (ROW, "ascending")])
        n = np.bincount(kind, minlength=6)
        mass = np.array([0, 2.5 * common, 0, 0, 0, 0])
        head = n.astype(f"{order}u4").tobytes() + mass.astype(f"{order}f8").tobytes()
        gas = group.slice(0, n[0])
        weighed = pa.concat_tables([gas, group.slice(n[0] + n[1])]) if common else group
        blocks = [
            (head + bytes(256 - len(head)), "HEAD"), (array(group, list(XYZ), f"{order}f4"), "POS"), (array(group, ["Z", "Y", "X"], f"{order}f4"), "VEL"), (array(group, [ROW], f"{order}u4"), "ID"),
            (array(weighed, ["mass"], f"{order}f4"), "MASS"), (array(gas, ["X"], f"{order}f4"), "U"), (array(gas, ["Y"], f"{order}f4"), "RHO"), (array(gas, ["Z"], f"{order}f4"), "HSML"),
        ]
        return {name + ".snap": b"".join(_record(b, order, t if tagged else None) for b, t in blocks)}

    return encode


_SPECIES_SQL = "CASE CAST(mass AS INTEGER) % 6 WHEN 0 THEN 'GAS' WHEN 1 THEN 'HALO' WHEN 2 THEN 'DISK' WHEN 3 THEN 'BULGE' WHEN 4 THEN 'STARS' ELSE 'BNDRY' END AS species"


def _snapshot_sql(mass: str) -> str:
    gas = ", ".join(f"CASE WHEN mass % 6 = 0 THEN {a} END AS {b}" for a, b in (("X", '"U"'), ("Y", '"RHO"'), ("Z", '"HSML"')))
    return f'WITH {PTS} SELECT {_SPECIES_SQL}, X AS "POS_X", Y AS "POS_Y", Z AS "POS_Z", Z AS "VEL_X", Y AS "VEL_Y", X AS "VEL_Z", CAST(__row AS DOUBLE) AS "ID", {mass} AS "MASS", {gas} FROM pts'


def _species(spark, file: str) -> DataFrame:
    tables = [t.drop(ROW).withColumn("species", F.lit(s)) for s, t in snapshots.read_snapshot(spark, file).items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


@query("source_snapshot_untagged", _snapshot_sql("mass"))
def _(spark, d):
    return together(files(points(spark, d), _snapshot("<", False, False)), lambda f: _species(spark, f))


@query("source_snapshot_tagged", _snapshot_sql("CASE WHEN mass % 6 = 1 THEN 2.5 ELSE mass END"))
def _(spark, d):
    return together(files(points(spark, d), _snapshot(">", True, True)), lambda f: _species(spark, f))


@query("source_mesh_particles", f"WITH {PTS} SELECT __row, X, Y, Z FROM pts")
def _(spark, d):
    def encode(group: pa.Table, name: str) -> dict[str, bytes]:
        numbers = [np.array([x], "<i4").tobytes() for x in (1, 3, group.num_rows, 0, 0, 0, 0, 0)]
        return {name.replace("part-", "part_"): b"".join(_record(b, "<", None) for b in [*numbers, *(array(group, [c], "<f8") for c in XYZ)])}

    found = files(points(spark, d), encode)
    return snapshots.read_mesh_particles(spark, found[0][0].rpartition("/")[0])


# FITS


def _cards(pairs: list[tuple[str, object]]) -> bytes:
    shown = lambda x: ("T" if x else "F").rjust(20) if isinstance(x, bool) else f"'{x:<8}'" if isinstance(x, str) else str(x).rjust(20)
    raw_cards = "".join(f"{k:<8}= {shown(v)}".ljust(80) for k, v in pairs) + "END".ljust(80)
    return raw_cards.ljust(-(-len(raw_cards) // fits.BLOCK) * fits.BLOCK).encode()


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % fits.BLOCK)


@query("source_fits_table", f'WITH {PTS} SELECT __row, CAST(__row AS DOUBLE) AS "ID", X AS "POS_0", Y AS "POS_1", Z AS "POS_2", CASE WHEN mass <> 3 THEN mass * 2 + 1 END AS "M", CAST(mass > 5 AS INTEGER)::DOUBLE AS "FLAG" FROM pts')
def _(spark, d):
    def encode(group: pa.Table, name: str) -> dict[str, bytes]:
        kinds = np.dtype([("ID", ">i8"), ("NAME", "S5"), ("POS", ">f8", 3), ("M", ">i2"), ("FLAG", "S1")])
        table = np.zeros(group.num_rows, kinds)
        table["ID"], table["NAME"], table["M"] = group[ROW].to_numpy(), b"text", group["mass"].to_numpy()
        table["POS"] = np.stack([group[c].to_numpy() for c in XYZ], 1)
        table["FLAG"] = np.where(group["mass"].to_numpy() > 5, b"T", b"F")
        first = _cards([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)])
        head = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", kinds.itemsize), ("NAXIS2", len(table)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 5)]
        head += [(f"T{a}{k}", x) for k, (f, t) in enumerate((("1K", "ID"), ("5A", "NAME"), ("3D", "POS"), ("I", "M"), ("L", "FLAG")), 1) for a, x in (("FORM", f), ("TYPE", t))]
        head += [("TNULL4", 3), ("TSCAL4", 2.0), ("TZERO4", 1.0)]
        return {name + ".fits": first + _cards(head) + _padded(table.tobytes())}

    return together(files(points(spark, d), encode), lambda f: fits.read_fits_table(spark, f)).drop("NAME")


@query("source_fits_image", f'WITH {PRT} SELECT __row, price AS "img_0", size * 2 - 1 AS "img_1" FROM prt')
def _(spark, d):
    """Two planes of one row of pixels each."""

    def encode(group: pa.Table, name: str) -> dict[str, bytes]:
        head = [("SIMPLE", True), ("BITPIX", -64), ("NAXIS", 3), ("NAXIS1", group.num_rows), ("NAXIS2", 1), ("NAXIS3", 2), ("BSCALE", 2.0), ("BZERO", -1.0)]
        planes = np.stack([(group["price"].to_numpy() + 1) / 2, group["size"].to_numpy()]).astype(">f8")
        return {name + ".fits": _cards(head) + _padded(planes.tobytes())}

    return rounded(together(files(parts(spark, d), encode), lambda f: fits.read_fits_image(spark, f, name="img")[0]), 9)


# HDF5


def _hdf5(arrays: dict[str, np.ndarray]) -> bytes:
    """A file with a root group of contiguous data sets: superblock, headers, one leaf of names, the data."""
    names, n = sorted(arrays), len(arrays)
    number = lambda x, width=8: int(x).to_bytes(width, "little")
    message = lambda kind, raw: number(kind, 2) + number(-(-len(raw) // 8) * 8, 2) + bytes(4) + raw.ljust(-(-len(raw) // 8) * 8, b"\0")
    header = lambda *parts: bytes([1, 0]) + number(len(parts), 2) + number(1, 4) + number(sum(map(len, parts)), 4) + bytes(4) + b"".join(parts)
    text, starts = b"\0" * 8, []
    for name in names:
        starts.append(len(text))
        text += name.encode().ljust(-(-(len(name) + 1) // 8) * 8, b"\0")
    group_at = 96
    tree_at = group_at + len(header(message(0x11, bytes(16))))
    leaf_at, heap_at = tree_at + 24 + 8 + 16, tree_at + 24 + 8 + 16 + 8 + 40 * n
    text_at = heap_at + 32
    at, headers, body = text_at + len(text), {}, b""
    for name in names:
        x = arrays[name]
        kind = bytes([0x11, 0x20 | (x.dtype.byteorder == ">"), 63, 0]) if x.dtype.kind == "f" else bytes([0x10, 8 | (x.dtype.byteorder == ">"), 0, 0])
        kind += number(x.dtype.itemsize, 4) + bytes(12)
        space = bytes([1, x.ndim, 0, 0, 0, 0, 0, 0]) + b"".join(map(number, x.shape))
        size = len(header(message(1, space), message(3, kind), message(8, bytes(18))))
        headers[name] = at
        body += header(message(1, space), message(3, kind), message(8, bytes([3, 1]) + number(at + size) + number(x.nbytes))) + x.tobytes()
        at += size + x.nbytes
    first = b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + number(4, 2) + number(16, 2) + bytes(4) + number(0) + b"\xff" * 8 + number(at) + b"\xff" * 8
    group = header(message(0x11, number(tree_at) + number(heap_at)))
    tree = b"TREE" + bytes([0, 0]) + number(1, 2) + b"\xff" * 16 + number(0) + number(leaf_at) + number(starts[-1])
    leaf = b"SNOD" + bytes([1, 0]) + number(n, 2) + b"".join(number(s) + number(headers[x]) + bytes(24) for s, x in zip(starts, names))
    heap = b"HEAP" + bytes(4) + number(len(text)) + number((1 << 64) - 1) + number(text_at)
    return first + number(0) + number(group_at) + bytes(24) + group + tree + leaf + heap + text + body


@query("source_hdf5", f'WITH {PTS} SELECT __row, mass, X AS "place_0", Y AS "place_1", Z AS "place_2" FROM pts')
def _(spark, d):
    """A data set of one axis and one of two."""

    def encode(group: pa.Table, name: str) -> dict[str, bytes]:
        place = np.stack([group[c].to_numpy() for c in XYZ]).astype(">f8")
        return {name + ".h5": _hdf5({"mass": group["mass"].to_numpy().astype("<i4"), "place": place})}

    return together(files(points(spark, d), encode), lambda f: hdf5.read_hdf5(spark, f, ["mass", "place"])[0])


# what the operators have besides


@query("flow_density", f"""WITH {PTS}, b AS (SELECT min(X) AS x0, (max(X) - min(X)) / 32 AS dx, min(Y) AS y0, (max(Y) - min(Y)) / 32 AS dy, min(Z) AS z0, (max(Z) - min(Z)) / 32 AS dz FROM pts),
    p AS (SELECT __row, (X - x0) / dx AS px, (Y - y0) / dy AS py, (Z - z0) / dz AS pz FROM pts, b),
    c AS (SELECT __row, floor(px) + i AS cx, floor(py) + j AS cy, floor(pz) + k AS cz, abs(1 - i - (px - floor(px))) * abs(1 - j - (py - floor(py))) * abs(1 - k - (pz - floor(pz))) AS w FROM p, range(2) a(i), range(2) bb(j), range(2) cc(k)),
    m AS (SELECT cx, cy, cz, sum(w) AS v FROM c WHERE cx < 32 AND cy < 32 AND cz < 32 GROUP BY ALL), s AS (SELECT __row, sum(w * v) AS s FROM c JOIN m USING (cx, cy, cz) GROUP BY __row)
    SELECT __row, X, Y, Z, round(1e-7 + coalesce(s, 0) / (dx * dy * dz), 3) + 0 AS density FROM pts LEFT JOIN s USING (__row), b""")  # fmt: skip
def _(spark, d):
    """Text import, then the density at each point from a parameter file, as one flow."""

    def encode(group: pa.Table, name: str) -> dict[str, bytes]:
        body = "".join(" ".join(map(repr, r)) + "\n" for r in zip(*(group[c].to_pylist() for c in (ROW, *XYZ))))
        return {name + ".ascii": ("row X Y Z\n" + body).encode()}

    found = files(points(spark, d), encode)
    table = together(found, lambda f: text.read_ascii(spark, f)).select(F.col("row").cast("long").alias(ROW), *XYZ)
    path = f"{new_folder(spark)}/density.par"
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(posixpath.dirname(at), recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(b"# density\nop=pointproperty\npoints=X Y Z\nresolution=32 32 32\nname=density\nfield=unknown\n")
    return registry.run_file(path, table).withColumn("density", F.round("density", 3) + 0.0)


def _flow(spark, files: dict[str, str], frames: dict[str, DataFrame]) -> DataFrame:
    """Run ``run.par`` of the files in a new folder with the tables."""
    folder = new_folder(spark)
    for name, df in frames.items():
        tables.write_table(df, f"{folder}/{name}", "double")
    fs, at = pafs.FileSystem.from_uri(folder)
    for name, content in files.items():
        with fs.open_output_stream(f"{at}/{name}") as f:
            f.write(content.encode())
    return flows.run_flow(spark, f"{folder}/run.par")


@query("flow_selfield", f"WITH {ORD} SELECT row_number() OVER (ORDER BY __row) - 1 AS __row, CAST(CAST(price AS FLOAT) AS DOUBLE) AS price, cust FROM ord WHERE price BETWEEN 50000 AND 150000 AND cust <= 800")
def _(spark, d):
    """A limits file, and the result as a table file, of floats as all results are."""
    files = {"limits.txt": "price 50000 150000\ncust unlimited 800\n", "run.par": "op=selfield\nlimits=limits.txt\noperator=AND\nout=selected.bin\nfile=orders.bin\n"}
    return _flow(spark, files, {"orders.bin": orders(spark, d)})


@query("flow_extraction", f"WITH {PTS} SELECT row_number() OVER (ORDER BY __row) - 1 AS __row, CAST(CAST(X AS FLOAT) AS DOUBLE) AS X, CAST(CAST(Y AS FLOAT) AS DOUBLE) AS Y, CAST(CAST(Z AS FLOAT) AS DOUBLE) AS Z FROM pts WHERE sqrt(X * X + Y * Y + Z * Z) <= 0.15")
def _(spark, d):
    """A geometry file."""
    files = {"ball.txt": "X 0\nY 0\nZ 0\nRADIUS 0.15\n", "run.par": "op=extraction\ngeometry=ball.txt\nout=ball.bin\nfile=points.bin\n"}
    return _flow(spark, files, {"points.bin": points(spark, d).select(ROW, *XYZ)})


@query("flow_merge", f"WITH {ORD}, {PRT} SELECT __row, CAST(CAST(coalesce(ord.price, -1) AS FLOAT) AS DOUBLE) AS price_tab_1, CAST(CAST(coalesce(prt.price, -1) AS FLOAT) AS DOUBLE) AS price_tab_2, coalesce(size, -1) AS size_tab_2 FROM ord FULL JOIN prt USING (__row)")
def _(spark, d):
    """A list of tables and columns."""
    files = {"list.txt": "orders.bin price\nparts *\n", "run.par": "op=merge\nsize=HUGE\npad=-1\nout=merged.bin\nfile=list.txt\n"}
    return _flow(spark, files, {"orders.bin": orders(spark, d), "parts.bin": parts(spark, d).select(ROW, "price", "size")})


@query("mres_defaults", f"""WITH {PTS}, e AS (SELECT (min(X) + max(X)) / 2 AS cx, (min(Y) + max(Y)) / 2 AS cy, (min(Z) + max(Z)) / 2 AS cz, greatest(max(X) - min(X), max(Y) - min(Y), max(Z) - min(Z)) * 0.01 AS w FROM pts),
    l AS (SELECT __row, sqrt((X - cx) * (X - cx) + (Y - cy) * (Y - cy) + (Z - cz) * (Z - cz)) / w AS q FROM pts, e),
    r AS (SELECT __row, CASE WHEN q <= 1 THEN 0 WHEN q <= 10 THEN 1 WHEN q <= 100 THEN 2 ELSE 3 END AS l, CASE WHEN q <= 1 THEN __row WHEN q <= 10 THEN __row // 10 WHEN q <= 100 THEN __row // 100 ELSE __row // greatest(1, CAST(floor((SELECT count(*) FROM pts) / 100000.0 + 0.5) AS BIGINT)) END AS run FROM l)
    SELECT __row FROM r QUALIFY row_number() OVER (PARTITION BY l, run ORDER BY md5('0-' || __row)) = 1""")  # fmt: skip
def _(spark, d):
    return registry.run("mres", points(spark, d), fields=list(XYZ)).select(ROW)


@query("splittable_size", f"WITH {ORD}, n AS (SELECT count(*) AS n, CAST(ceil(count(*) * 2 * 4 / 1048576.0 / 0.01) AS BIGINT) AS k FROM ord) SELECT __row, CAST(CASE WHEN __row < n % k * (n // k + 1) THEN __row // (n // k + 1) ELSE n % k + (__row - n % k * (n // k + 1)) // (n // k) END AS INTEGER) AS part FROM ord, n")
def _(spark, d):
    o = orders(spark, d)
    n = o.count()
    return combine.split_rows(o, combine.split_count(n, 2, 0.01, huge=True), n).select(ROW, "part")


@query("normalise_asinh", f"WITH {PTS}, a AS (SELECT __row, mass, asinh(X) AS v FROM pts), r AS (SELECT mass, min(v) AS lo FROM a GROUP BY mass) SELECT __row, round(CASE WHEN lo = 0.1 THEN 0 ELSE (greatest(lo, least(0.1, v)) - lo) / (0.1 - lo) END, 6) + 0 AS X FROM a JOIN r USING (mass)")
def _(spark, d):
    return rounded(stats.normalize(points(spark, d), ["X"], "mass", asinh=True, high=0.1).select(ROW, "X"))


_DRIFT = combine.drift(0.4, 0.5)


@query("interpolate_velocity", f"""WITH {PTS}, q AS (SELECT __row, X + 0.01 * Y AS x1, X + 0.01 * Y + 0.3 * Z AS x2, Y * {_DRIFT!r} AS v FROM pts),
    s AS (SELECT *, CASE WHEN abs(x2 - x1) > 0.1 THEN x2 - sign(x2 - x1) * 0.2 ELSE x2 END AS e FROM q)
    SELECT CAST(step AS INTEGER) AS step, __row, round(x1 * (1 - (step / 4.0) ** 2) + v * (step / 4.0 - (step / 4.0) ** 2) + e * (step / 4.0) ** 2, 5) + 0 AS X FROM s, range(1, 4) t(step)""")  # fmt: skip
def _(spark, d):
    p = points(spark, d)
    first = p.select(ROW, (F.col("X") + 0.01 * F.col("Y")).alias("X"), F.col("Y").alias("V"))
    second = p.select(ROW, (F.col("X") + 0.01 * F.col("Y") + 0.3 * F.col("Z")).alias("X"))
    return rounded(combine.snapshots_by_velocity(first, second, ["X"], ["V"], 4, _DRIFT, 0.2), 5)


@query("interpolate_by_id", "SELECT p_partkey AS id, CAST(step AS INTEGER) AS step, round(p_retailprice * (1 + 0.5 * (0.2 + 0.4 * step / 3.0)), 6) + 0 AS price FROM part, range(1, 3) t(step)")
def _(spark, d):
    p = parts(spark, d).select((F.col(ROW) * 1).alias("id"), "price")
    return rounded(combine.snapshots(p, p.withColumn("price", F.col("price") * 1.5), ["price"], 3, interval=(0.2, 0.6), on="id"))


@query("axis_slice", f"WITH {ORD}, side AS (SELECT min(s) AS s FROM range(1, 1000000) t(s) WHERE s * s * s >= (SELECT count(*) FROM ord)) SELECT __row, price FROM ord, side WHERE __row // s % s = 2")
def _(spark, d):
    """A plane of the smallest cube that holds all orders."""
    o = orders(spark, d).select(ROW, "price")
    side = cube_side(o.count())
    return grid.axis_slice(o, Geometry((side, side, side)), 2, 2)


@query("plane_cut", f"""WITH {PTS}, m AS (SELECT i AS c, coalesce(sum(mass), 0) AS v FROM range(512) t(i) LEFT JOIN pts ON CAST(mass AS BIGINT) * 51 % 512 = i GROUP BY i),
    g AS (SELECT id % 5 AS iu, id // 5 AS iv, 0.25 + 1.5 * (id % 5) AS x, 0.5 + 1.25 * (id % 5) AS y, 1.0 + 1.3 * (id // 5) AS z FROM range(20) t(id)),
    w AS (SELECT iu, iv, x, y, z, floor(x) + i + 8 * (floor(y) + j + 8 * (floor(z) + k)) AS c, abs(1 - i - (x - floor(x))) * abs(1 - j - (y - floor(y))) * abs(1 - k - (z - floor(z))) AS w FROM g, range(2) a(i), range(2) b(j), range(2) d(k))
    SELECT iu + 5 * iv AS __row, CAST(iu AS INTEGER) AS iu, CAST(iv AS INTEGER) AS iv, CAST(x AS DOUBLE) AS X, CAST(y AS DOUBLE) AS Y, CAST(z AS DOUBLE) AS Z, round(sum(w * v), 6) + 0 AS field FROM w JOIN m USING (c) GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    mesh = points(spark, d).groupBy((F.col("mass").cast("long") * 51 % 512).alias(ROW)).agg(F.sum("mass").alias("field"))
    return rounded(grid.plane_cut(mesh, "field", Geometry((8, 8, 8)), (0.25, 0.5, 1.0), (1.5, 1.25, 0.0), (0.0, 0.0, 1.3), (5, 4)))


@query("hyperbolic", f"WITH {PTS} SELECT __row, CASE WHEN mass >= 1 THEN round(acosh(mass), 6) + 0 END AS a, CASE WHEN abs(X * 3) < 1 THEN round(atanh(X * 3), 6) + 0 END AS b, CASE WHEN abs(Y * 3) <= 1 THEN round(acos(Y * 3), 6) + 0 END AS c, round(1 / cos(X), 6) + 0 AS d, CASE WHEN mass > 0 THEN round(log10(mass), 6) + 0 END AS e, round(asinh(Z), 6) + 0 AS f, round(1 / sin(mass), 5) + 0 AS g, round(exp(greatest(X, Y)) + least(X, Z), 6) + 0 AS h FROM pts")
def _(spark, d):
    from ..functions import scalar as s

    c = F.col
    p = points(spark, d).select(
        ROW, s.hyperbolic_arc_cosine(c("mass")).alias("a"), s.hyperbolic_arc_tangent(c("X") * 3).alias("b"), s.arc_cosine(c("Y") * 3).alias("c"), s.secant(c("X")).alias("d"),
        s.decimal_log(c("mass")).alias("e"), F.asinh("Z").alias("f"), F.round(s.cosecant(c("mass")), 5).alias("g"), (F.exp(F.greatest("X", "Y")) + F.least("X", "Z")).alias("h"),
    )
    return rounded(p)


@query("row_numbers", f"WITH {ORD} SELECT price, cust, row_number() OVER (ORDER BY price, __row) - 1 AS __row FROM ord")
def _(spark, d):
    o = orders(spark, d).withColumnRenamed(ROW, "key")
    return with_row(o, "price", "key").select("price", "cust", ROW)
