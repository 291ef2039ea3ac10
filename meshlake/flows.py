"""Parameter files with table files: a file names an operator, its input and where the result goes.

``run_flow(spark, path)`` reads ``key=value`` lines (``op``, ``file``, ``out`` and what the
operator takes), the tables that they name, and limits, geometry, layer and list files
beside them; it runs the operator and writes its tables.  Files are told by their own path
or URI, or relative to the parameter file's folder.  A key that the operator does not know
is an error; an empty value, ``unknown``, and a flag that is ``false`` leave it at its
default.  What is read by a few lines is read by the driver; tables, lists of ids and
results are read and written by tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import ROW, Geometry, data_columns, with_row
from .operators import columns, combine, grid, rows, sample, stats
from .registry import parameters
from .sources import binary, halo, multilist, tables, text
from .sources.fields import beside, opened

#: Keys that all operators take, and flags and names that change nothing here.
COMMON = {"op", "file", "out", "history", "historyfile", "help", "memsizelimit", "lfnout", "VO", "se"}

Limits = dict[str, tuple[float | None, float | None]]


@dataclass
class Flow:
    """A run: the parameters by name, and what they name."""

    spark: SparkSession
    path: str
    given: dict[str, str]
    used: set[str] = field(default_factory=lambda: set(COMMON))

    def get(self, key: str, default: str | None = None) -> str | None:
        self.used.add(key)
        value = self.given.get(key, "").strip()
        return default if value in ("", "unknown") else value

    def needed(self, key: str) -> str:
        value = self.get(key)
        if value is None:
            raise ValueError(f"{self.given['op']} needs {key}")
        return value

    def flag(self, key: str) -> bool:
        return (self.get(key, "false") or "false").lower() != "false"

    def words(self, *keys: str) -> list[str] | None:
        """The words of the first of the keys that is given."""
        found = [w for w in (self.get(k) for k in keys) if w is not None]
        return found[0].split() if found else None

    def numbers(self, key: str) -> list[float] | None:
        got = self.get(key)
        return None if got is None else [float(x) for x in got.split()]

    def lines(self, name: str) -> list[list[str]]:
        with opened(beside(self.path, name)) as f:
            return [x.split() for x in f.read().decode().splitlines() if x.strip() and not x.lstrip().startswith("#")]

    def uri(self, name: str) -> str:
        return beside(self.path, name)

    def table(self, name: str | None = None) -> DataFrame:
        return tables.read_tables(self.spark, self.uri(name or self.needed("file")))

    def geometry(self, name: str | None = None) -> Geometry:
        at = self.uri(name or self.needed("file"))
        found = binary.read_header(f"{at}.head").geometry
        if found is None:
            raise ValueError(f"{at} is no volume")
        return found

    def limits(self) -> Limits:
        """Lines of a column and its two ends, ``unlimited`` for an open one; lines of unknown columns, or with less, count nothing."""
        end = lambda x: None if x == "unlimited" else float(x)
        return {x[0]: (end(x[1]), end(x[2])) for x in self.lines(self.needed("limits")) if len(x) >= 3}

    def listed(self) -> list[tuple[DataFrame, list[str]]]:
        """Lines of a table and one of its columns, or ``*``; lines of one table come together."""
        found: dict[str, list[str]] = {}
        for line in self.lines(self.needed("file")):
            name = line[0] if line[0].endswith(".bin") else line[0] + ".bin"
            found.setdefault(name, []).extend(line[1:2])
        out = []
        for name, wanted in found.items():
            df = self.table(name)
            every = data_columns(df)
            picked = every if "*" in wanted else [c for c in dict.fromkeys(wanted) if c in every]
            out.append((df, picked))
        if not any(c for _, c in out):
            raise ValueError("no column of a table is listed")
        return [x for x in out if x[1]]

    def multilist(self) -> DataFrame:
        kind = "ascii" if self.flag("asciilist") else "i4" if self.flag("binaryint") else "u8"
        n = self.get("numberlists")
        each = self.get("listelements") if n else None
        one = self.flag("onelist")
        return multilist.read_multilist(self.spark, self.uri(self.needed("multilist")), kind, int(n) if n and not one else None, int(each) if each and not one else None, one)

    def mesh(self) -> Geometry | None:
        """The cells' number, sizes and place, where the parameters tell them."""
        n = [int(x) for x in self.words("resolution") or [32, 32, 32]]
        origin, spacing, box = self.numbers("gridOrigin"), self.numbers("gridSpacing"), self.get("box")
        if origin is None and spacing is None and box is None:
            return None
        size = [float(box) / x for x in n] if box is not None else spacing or [1.0] * 3
        return Geometry(tuple(n), tuple(size), tuple(origin or [0.0] * 3))

    def scheme(self) -> str:
        return "NGP" if self.flag("ngp") else "TSC" if self.flag("tsc") else "CIC"

    def added(self, df: DataFrame, made: DataFrame, names: list[str]) -> DataFrame:
        """With ``append`` the whole table with the new columns, else the new columns alone."""
        return made if self.flag("append") else made.select(ROW, *[f"`{c}`" for c in names])

    def done(self) -> None:
        unknown = set(self.given) - self.used
        if unknown:
            raise ValueError(f"{self.given['op']} has no parameter {', '.join(sorted(unknown))}")

    def write(self, df: DataFrame, geometry: Geometry | None = None, suffix: str = "", renumber: bool = False) -> DataFrame:
        """``df`` as the table ``out``, read back; without ``out``, ``df`` itself with its rows counted from 0 on."""
        self.done()
        df = df if not renumber else numbered(df)
        out = self.get("out")
        if out is None:
            return df
        at = self.uri(out if not suffix else out.removesuffix(".bin") + suffix)
        at = at if at.endswith(".bin") else at + ".bin"
        tables.write_table(df, at, geometry=geometry, overwrite=True)
        return tables.read_tables(self.spark, at)


def numbered(df: DataFrame) -> DataFrame:
    """Rows from 0 on without gaps, in the order of the old numbers."""
    return with_row(df.withColumnRenamed(ROW, "__old"), "__old").drop("__old").select(ROW, *data_columns(df))


def _extraction(f: Flow) -> DataFrame:
    df, center, size = f.table(), {}, {}
    for line in f.lines(f.needed("geometry")):
        if line[0] in ("RADIUS", "BOX", "CORNER"):
            size = {line[0].lower(): float(line[1])}
        elif line[0] in df.columns and len(line) > 1:
            center[line[0]] = float(line[1])
    if len(center) != 3 or not size:
        raise ValueError("a geometry is three columns with a place each, and RADIUS, BOX or CORNER")
    return f.write(rows.extract(df, center, **size), renumber=True)


def _extract_list(f: Flow) -> DataFrame:
    """The rows in the order of the lists, one after the other."""
    found = rows.extract_list(f.table(), f.multilist())
    ranked = with_row(found, "list_id", "pos")
    return f.write(ranked.select(ROW, *[c for c in found.columns if c not in ("list_id", "pos", "row_id")]))


def _halo_lists(f: Flow) -> DataFrame:
    lists = multilist.read_multilist(f.spark, f.uri(f.needed("multilist")), "ascii")
    kept = rows.halo_lists(lists, f.table(), (f.words("field") or ["Id"])[0])
    f.done()
    ranks = with_row(kept.select("list_id").distinct(), "list_id").withColumnRenamed("list_id", "old_id")
    kept = kept.withColumnRenamed("list_id", "old_id").join(ranks, "old_id").select((F.col(ROW) + 1).alias("list_id"), "pos", "row_id")
    if f.get("out"):
        multilist.write_multilist_text(kept, f.uri(f.needed("out")))
    return kept


def _halo_routes(f: Flow) -> DataFrame:
    fields = (f.words("field") or [])[:3]
    lists = multilist.read_multilist(f.spark, f.uri(f.needed("multilist")), "ascii")
    routed = rows.halo_routed_lists(lists, f.table(), fields, float(f.get("threshold", "1.0")))
    f.done()
    for k, name in enumerate(fields, 1) if f.get("out") else []:
        multilist.write_multilist_text(routed.where(F.col("route") == k), f.uri(f"{f.needed('out')}_{name}_particles"))
    return routed


def _coarse(f: Flow) -> DataFrame:
    df, geometry = f.table(), f.geometry()
    fields = f.words("field") or data_columns(df)
    wanted = f.words("newres")
    n = tuple(map(int, wanted)) if wanted else sample.coarse_resolution(geometry.n, float(f.get("perc", "10.0")))
    return f.write(*sample.coarsen(df.select(ROW, *fields), geometry, n))


def _subvolume(f: Flow) -> DataFrame:
    df, geometry = f.table(), f.geometry()
    fields = f.words("field") or data_columns(df)
    start, n = ([int(x) for x in f.needed(k).split()] for k in ("startingcell", "resolution"))
    return f.write(*rows.extract_subvolume(df.select(ROW, *fields), geometry, start, n))


def _scatter(f: Flow) -> DataFrame:
    df, points, fields = f.table(), f.needed("points").split(), f.words("field") or []
    n = [int(x) for x in f.words("resolution") or [32, 32, 32]]
    mesh = grid.scatter(df, points, fields, n, f.scheme(), f.mesh(), f.flag("periodic"), not f.flag("nodensity"), f.flag("avg"), float(f.get("constant", "1.0")))
    return f.write(*mesh)


def _gather(f: Flow) -> DataFrame:
    df, volume = f.table(), f.needed("volume")
    mesh, geometry = f.table(volume), f.geometry(volume)
    told, box = f.mesh(), f.get("box")
    if told is not None:
        size = tuple(float(box) / n for n in geometry.n) if box is not None else told.size if f.get("gridSpacing") else geometry.size
        geometry = Geometry(geometry.n, size, told.origin)
    name = f.get("outcol", "__Grid2Point_")
    made = grid.gather(df, f.needed("points").split(), mesh, f.needed("field"), geometry, f.scheme(), f.flag("density"), f.flag("periodic"), name=name)
    return f.write(f.added(df, made, [name]))


def _point_property(f: Flow) -> DataFrame:
    df, name = f.table(), f.get("outcol", "__PointProperty_")
    n = [int(x) for x in f.words("resolution") or [32, 32, 32]]
    made = grid.point_property(df, f.needed("points").split(), (f.words("field") or [None])[0], n, f.flag("periodic"), name)
    return f.write(f.added(df, made, [name]))


def _interpolate(f: Flow) -> list[DataFrame]:
    names = f.needed("infiles").split()
    first, second = (f.table(x if x.endswith(".bin") else x + ".bin") for x in names)
    fields = f.words("field", "list") or data_columns(first)
    steps, interval = int(f.get("numbin", "10")), tuple(f.numbers("interval") or (0.0, 1.0))
    made = combine.snapshots(first, second, fields, steps, f.flag("periodic"), interval)
    return [f.write(made.where(F.col("step") == k).drop("step"), suffix=f"_{k}.bin") for k in range(1, steps)]


def _layers(f: Flow) -> DataFrame:
    position = f.numbers("pos")
    layers = sorted((float(a), float(b)) for a, b, *_ in f.lines(f.needed("geometry"))) if f.get("geometry") else None
    background = f.get("background")
    return f.write(sample.multi_resolution(f.table(), f.needed("points").split(), position, layers, None if background is None else float(background)), renumber=True)


def _split(f: Flow) -> list[DataFrame]:
    df, field_, axis = f.table(), f.words("field"), f.get("volumesplit")
    n = df.count()
    size = f.get("maxsizetable")
    parts = combine.split_count(n, len(data_columns(df)), float(size), f.flag("hugesplit")) if size else int(f.get("numoftables", "2"))
    f.flag("hugesplit")
    if axis is not None:
        geometry = f.geometry()
        found = combine.split_volume(df, geometry, int(axis), parts)
    else:
        found = combine.split_by_value(df, field_[0], parts) if field_ else combine.split_rows(df, parts, n)
    return [f.write(found.where(F.col("part") == k).drop("part"), suffix=f"_split_{k}.bin", renumber=True) for k in range(parts)]


def _statistic(f: Flow) -> DataFrame | tuple[DataFrame, DataFrame]:
    df, bounds = f.table(), f.numbers("range")
    fields = f.words("list", "field") or data_columns(df)
    bins = f.get("histogram")
    f.flag("silent")
    f.done()
    found = stats.statistic(df, fields, tuple(bounds) if bounds else None)
    if bins is None:
        return found
    counts = stats.histogram(df, fields, None if bins == "true" else int(bins), tuple(bounds) if bounds else None)
    if f.get("out"):
        stats.write_histogram(counts, fields, f.uri(f.needed("out")))
    return found, counts


def _swap(f: Flow) -> DataFrame:
    """The same table in the other byte order, beside the old one: ``override`` changes no bytes in place but writes anew."""
    at = f.uri(f.needed("file"))
    head = binary.read_header(f"{at}.head")
    over = f.flag("override")
    f.done()
    out = at if over else f.uri(f.get("out", f.needed("file").removesuffix(".bin") + "_swap.bin"))
    tables.write_table(f.table(), out, head.kind, binary.swap_order(head).order, head.geometry, overwrite=True)
    return tables.read_tables(f.spark, out)


def _show(f: Flow) -> DataFrame:
    between, n = f.words("rangerows"), f.get("numrows")
    shown = text.show_table(f.table(), f.words("field"), tuple(map(int, between)) if between else None, int(n) if n else None, int(f.get("width", "10")), int(f.get("precision", "8")))
    f.done()
    if f.get("out"):
        shown.orderBy(ROW).select("line").write.mode("overwrite").text(f.uri(f.needed("out")))
    return shown


def _show_volume(f: Flow) -> DataFrame:
    df, n = f.table(), f.get("numcells")
    fields = f.words("field") or data_columns(df)
    shown = rows.show_volume(df, f.geometry(), f.limits(), f.get("operator", "AND"), int(n) if n else None)
    f.done()
    return shown.select("X", "Y", "Z", *fields)


def _volume_cells(f: Flow) -> DataFrame:
    return f.write(rows.select_volume(f.table(), f.limits(), f.get("operator", "AND")), f.geometry())


def _columns(f: Flow) -> DataFrame:
    """Keeps the listed columns; with ``delete``, unless ``extract`` says otherwise, all but them."""
    extract, delete = f.flag("extract"), f.flag("delete")
    return f.write(columns.select_columns(f.table(), f.words("field", "list") or [], delete and not extract))


def _column(make: Callable[[Flow, DataFrame, str], DataFrame], default: str) -> Callable[[Flow], DataFrame]:
    def run(f: Flow) -> DataFrame:
        df, name = f.table(), f.get("outcol", default)
        return f.write(f.added(df, make(f, df, name), [name]))

    return run


def _math(f: Flow, df: DataFrame, name: str) -> DataFrame:
    """``compute``, or the first line of the file ``expression``, as Spark SQL."""
    told = f.get("compute")
    if told is None:
        with opened(f.uri(f.needed("expression"))) as file:
            told = file.read().decode().strip()
    return columns.math_column(df, told, name)


def _polar(f: Flow) -> DataFrame:
    df, names = f.table(), f.words("outcol") or ["rho", "theta", "phi"]
    return f.write(f.added(df, columns.cartesian_to_polar(df, f.needed("field").split(), names), names))


def _include(f: Flow, df: DataFrame, name: str) -> DataFrame:
    inside, outside = (float(f.get(k, x)) for k, x in (("invalue", "1.0"), ("outvalue", "0.0")))
    return columns.include(df, float(f.needed("radius")), f.numbers("center"), f.words("field"), inside, outside, name)


def _particles(f: Flow) -> DataFrame:
    """``par``: lines of a name and a number, of which ``box``, ``velocity``, ``scale`` and ``hubble`` count."""
    told = {x[0]: float(x[1]) for x in f.lines(f.needed("par")) if len(x) > 1 and x[0] in ("box", "velocity", "scale", "hubble")}
    made = halo.scaled(f.table(), f.needed("field").split(), **told)
    f.done()
    if f.get("out") is None:
        return made
    written = halo.write_particles(made, f.uri(f.needed("out"))).collect()  # a row for each file
    return f.spark.createDataFrame(written, "file string, n long")


def _votable(f: Flow) -> DataFrame:
    df = f.table()
    made = df.select(ROW, *(f.words("field") or data_columns(df)))
    force = f.flag("force")
    f.done()
    text.write_votable(made, f.uri(f.needed("out")), force)
    return made


FLOWS: dict[str, Callable[[Flow], object]] = {
    "addId": lambda f: f.write(columns.add_id(f.table(), f.get("outcol", "Id"), int(f.get("start", "0")))),
    "ahfhalogalaxyext": _halo_routes, "ahfhalolist": _halo_lists,
    "append": lambda f: f.write(combine.append([f.table(x[0] if x[0].endswith(".bin") else x[0] + ".bin") for x in f.lines(f.needed("file"))])),
    "cartesian2polar": _polar,
    "changecolname": lambda f: f.write(columns.rename_columns(f.table(), f.needed("field").split(), f.needed("newnames").split())),
    "coarsevolume": _coarse,
    "cut": lambda f: f.write(columns.cut(f.table(), f.limits(), f.words("field"), float(f.get("threshold", "0.0")), f.get("operator", "AND"))),
    "decimator": lambda f: f.write(sample.decimate(f.table(), int(f.get("skip", "1"))), renumber=True),
    "extractlist": _extract_list, "extraction": _extraction, "extractsubvolume": _subvolume, "grid2point": _gather,
    "include": _column(_include, "IncludeOp"), "interpolate": _interpolate, "mathop": _column(_math, "__Mathop_"),
    "merge": lambda f: f.write(combine.merge(f.listed(), f.get("size", "SMALLEST"), float(f.get("pad", "0.0")))),
    "module": _column(lambda f, df, name: columns.module(df, f.needed("field").split(), name), "ModuleOp"),
    "mres": _layers, "pointdistribute": _scatter, "pointproperty": _point_property,
    "randomizer": lambda f: f.write(sample.randomize(f.table().select(ROW, *(f.words("list", "field") or data_columns(f.table()))), float(f.needed("perc")), int(f.get("iseed", "0"))), renumber=True),
    "selcolumns": _columns,
    "selfield": lambda f: f.write(rows.select_rows(f.table(), f.limits(), f.get("operator", "AND")), renumber=True),
    "selvol": _volume_cells, "showtable": _show, "showvol": _show_volume,
    "sigmacontours": lambda f: f.write(rows.sigma_contours(f.table(), f.needed("field").split(), float(f.get("nsigma", "1.0")), f.flag("exclude"), f.flag("allcolumns")), renumber=True),
    "splittable": _split, "statistic": _statistic, "swap": _swap, "vbt2ahf": _particles,
    "visualop": lambda f: f.write(sample.visual_sample(f.listed(), int(f.get("size", "8000000"))), renumber=True),
    "wrvotable": _votable,
}


def run_flow(spark: SparkSession, path: str) -> object:
    """Run the parameter file; the result as a frame, or a list of them where the operator makes several tables."""
    with opened(path) as f:
        given = parameters(f.read().decode())
    if given.get("op") not in FLOWS:
        raise ValueError(f"no operator {given.get('op')}")
    return FLOWS[given["op"]](Flow(spark, path, given))


