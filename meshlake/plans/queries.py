"""One query for each operator over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, sequences
from ..model import ROW, Geometry, dense, with_row
from ..operators import columns, combine, grid, groups, projection, rows, sample, stats, surface
from ..sources import halo, text
from .tables import cloud, orders, parts, points, table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

PTS = "pts AS (SELECT vec_id AS __row, CAST(embedding[1] AS DOUBLE) AS X, CAST(embedding[2] AS DOUBLE) AS Y, CAST(embedding[3] AS DOUBLE) AS Z, CAST(label + 1 AS DOUBLE) AS mass FROM embeddings)"
CLOUD = "cloud AS (SELECT l_quantity AS X, l_extendedprice / 1000 AS Y, l_discount * 100 AS Z, l_tax AS mass FROM lineitem)"
ORD = "ord AS (SELECT o_orderkey AS __row, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS cust FROM orders)"
PRT = "prt AS (SELECT p_partkey AS __row, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size FROM part)"
XYZ = ("X", "Y", "Z")
N = 8


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, since sums in another order differ in the last ones."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# columns


@query("selcolumns", f"WITH {PTS} SELECT __row, X, Z FROM pts")
def _(spark, d):
    return columns.select_columns(points(spark, d), ["Z", "X", "none"])


@query("changecolname", f"WITH {PTS} SELECT __row, X AS a, Y AS b, Z, mass FROM pts")
def _(spark, d):
    return columns.rename_columns(points(spark, d), ["X", "Y"], ["a", "b", "c"])


@query("add_id", f"WITH {PTS} SELECT *, __row + 5 AS Id FROM pts")
def _(spark, d):
    return columns.add_id(points(spark, d), start=5)


@query("module", f"WITH {PTS} SELECT __row, round(sqrt(X * X + Y * Y + Z * Z), 6) + 0 AS m FROM pts")
def _(spark, d):
    return rounded(columns.module(points(spark, d), XYZ, "m").select(ROW, "m"))


@query("cartesian2polar", f"WITH {PTS} SELECT __row, round(sqrt(X * X + Y * Y + Z * Z), 6) + 0 AS rho, round(acos(Z / sqrt(X * X + Y * Y + Z * Z)), 6) + 0 AS theta, round(atan(Y / X), 6) + 0 AS phi FROM pts")
def _(spark, d):
    return rounded(columns.cartesian_to_polar(points(spark, d), XYZ).select(ROW, "rho", "theta", "phi"))


@query("include", f"WITH {PTS} SELECT __row, CAST(CASE WHEN sqrt((X - 0.1) ** 2 + Y * Y + Z * Z) < 0.2 THEN 2 ELSE 0 END AS DOUBLE) AS IncludeOp FROM pts")
def _(spark, d):
    return columns.include(points(spark, d), 0.2, (0.1, 0.0, 0.0), XYZ, inside=2.0).select(ROW, "IncludeOp")


@query("cut", f"WITH {PTS} SELECT __row, CASE WHEN X >= 0 AND Y <= 0.1 THEN 9.0 ELSE X END AS X, Y, CASE WHEN X >= 0 AND Y <= 0.1 THEN 9.0 ELSE Z END AS Z, mass FROM pts")
def _(spark, d):
    return columns.cut(points(spark, d), {"X": (0.0, None), "Y": (None, 0.1)}, ["X", "Z"], 9.0)


@query("mathop", f"WITH {PRT} SELECT __row, round(sqrt(price) + size ** 2 - price % 7, 6) + 0 AS __Mathop_ FROM prt")
def _(spark, d):
    return rounded(columns.math_column(parts(spark, d), "sqrt(price) + power(size, 2) - price % 7").select(ROW, "__Mathop_"))


@query(
    "mathop_functions",
    f"""WITH {PRT} SELECT __row, floor(price + 0.5) AS nearest, CAST(abs(size - 7) <= 1e-14 AS DOUBLE) AS equal, CAST(size < 10 AS DOUBLE) AS less,
    CAST(size <= 10 AS DOUBLE) AS less_equal, CAST(size <> 7 AS DOUBLE) AS unequal, CASE WHEN size <> 5 THEN price / (size - 5) END AS ratio, CASE WHEN size <> 5 THEN price % (size - 5) END AS rest,
    CASE WHEN size > 20 THEN round(ln(size - 20), 6) + 0 END AS log_part, CASE WHEN size >= 20 THEN round(sqrt(size - 20), 6) + 0 END AS root_part,
    CASE WHEN size <= 1 THEN round(asin(size), 6) + 0 END AS arc, CAST(size < 10 AND price > 1000 AS DOUBLE) AS both, CAST(size < 10 OR price > 1000 AS DOUBLE) AS any_of, CAST(NOT size < 10 AS DOUBLE) AS no,
    CASE WHEN size < 10 THEN price ELSE -size END AS chosen, round(1 / tan(size), 6) + 0 AS cotan FROM prt""",
)
def _(spark, d):
    p, s = F.col("price"), F.col("size")
    small, dear = scalar.less(s, F.lit(10.0)), scalar.less(F.lit(1000.0), p)
    out = {
        "nearest": scalar.nearest(p), "equal": scalar.equal(s, F.lit(7.0)), "less": small, "less_equal": scalar.less_equal(s, F.lit(10.0)), "unequal": scalar.unequal(s, F.lit(7.0)),
        "ratio": scalar.divide(p, s - 5), "rest": scalar.modulus(p, s - 5), "log_part": F.round(scalar.natural_log(s - 20), 6) + 0.0, "root_part": F.round(scalar.root(s - 20), 6) + 0.0,
        "arc": F.round(scalar.arc_sine(s), 6) + 0.0, "both": scalar.both(small, dear), "any_of": scalar.either(small, dear), "no": scalar.negate(small), "chosen": scalar.choose(small, p, -s), "cotan": F.round(scalar.cotangent(s), 6) + 0.0,
    }
    return parts(spark, d).select(ROW, *[c.alias(k) for k, c in out.items()])


# rows


@query("selfield", f"WITH {PTS} SELECT * FROM pts WHERE X >= -0.1 AND X <= 0.1 AND Y >= 0")
def _(spark, d):
    return rows.select_rows(points(spark, d), {"X": (-0.1, 0.1), "Y": (0.0, None)})


@query("selfield_or", f"WITH {PTS} SELECT __row FROM pts WHERE X <= -0.1 OR Y >= 0.2")
def _(spark, d):
    return rows.row_ids(points(spark, d), {"X": (None, -0.1), "Y": (0.2, None), "none": (0.0, 1.0)}, "OR")


@query("extraction_sphere", f"WITH {PTS} SELECT * FROM pts WHERE sqrt((X - 0.05) ** 2 + Y * Y + Z * Z) <= 0.15")
def _(spark, d):
    return rows.extract(points(spark, d), {"X": 0.05, "Y": 0.0, "Z": 0.0}, radius=0.15)


@query("extraction_box", f"WITH {PTS} SELECT * FROM pts WHERE X BETWEEN 0.05 - 0.1 AND 0.05 + 0.1 AND Y BETWEEN -0.1 AND 0.1 AND Z BETWEEN -0.1 AND 0.1")
def _(spark, d):
    return rows.extract(points(spark, d), {"X": 0.05, "Y": 0.0, "Z": 0.0}, box=0.1)


@query("extraction_corner", f"WITH {PTS} SELECT * FROM pts WHERE X BETWEEN 0 AND 0.2 AND Y BETWEEN 0 AND 0.2 AND Z BETWEEN 0 AND 0.2")
def _(spark, d):
    return rows.extract(points(spark, d), {"X": 0.0, "Y": 0.0, "Z": 0.0}, corner=0.2)


_SIGMA = "s AS (SELECT avg(price) AS m, stddev_samp(price) AS s, avg(cust) AS mc, stddev_samp(cust) AS sc FROM ord)"


@query("sigmacontours", f"WITH {ORD}, {_SIGMA} SELECT __row, price, cust FROM ord, s WHERE abs(price - m) <= s.s AND abs(cust - mc) <= sc")
def _(spark, d):
    return rows.sigma_contours(orders(spark, d), ["price", "cust"])


@query("sigmacontours_exclude", f"WITH {ORD}, {_SIGMA} SELECT __row, price, cust FROM ord, s WHERE abs(price - m) > 1.5 * s.s")
def _(spark, d):
    return rows.sigma_contours(orders(spark, d), ["price"], 1.5, exclude=True, all_columns=True)


def _lists(spark, d):
    """Lists of all orders, by customers that share a remainder; every row is in one."""
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).cast("long").alias("list_id"), F.col("o_orderkey").cast("long").alias("pos"), F.col("o_orderkey").cast("long").alias("row_id"))


_LISTS = "lists AS (SELECT o_custkey % 50 AS list_id, o_orderkey AS pos, o_orderkey AS row_id FROM orders)"


@query("extractlist", f"WITH {ORD}, {_LISTS} SELECT list_id, pos, row_id, price, cust FROM lists JOIN ord ON row_id = __row")
def _(spark, d):
    return rows.extract_list(orders(spark, d), _lists(spark, d))


@query("ahfhalolist", f"WITH {_LISTS} SELECT list_id, pos, row_id FROM lists WHERE list_id IN (SELECT n_nationkey FROM nation)")
def _(spark, d):
    return rows.halo_lists(_lists(spark, d), table(spark, d, "nation"), "n_nationkey")


# the same operators on lists that hold every order: a list for each customer, row ids a permutation of all positions


def _all_lists(spark, d):
    o = table(spark, d, "orders")
    n = o.agg(F.count("*").cast("long").alias("n"))
    return o.join(F.broadcast(n)).select(F.col("o_custkey").cast("long").alias("list_id"), F.col("o_orderkey").cast("long").alias("pos"), (F.col("o_orderkey").cast("long") * 1_000_003 % F.col("n")).alias("row_id"))


_ALL_LISTS = "lists AS (SELECT o_custkey AS list_id, o_orderkey AS pos, o_orderkey * 1000003 % (SELECT count(*) FROM orders) AS row_id FROM orders)"


@query("extractlist_whole", f"WITH {ORD}, {_ALL_LISTS} SELECT list_id, pos, row_id, price, cust FROM lists JOIN ord ON row_id = __row")
def _(spark, d):
    return rows.extract_list(orders(spark, d), _all_lists(spark, d))


@query("ahfhalolist_whole", f"WITH {_ALL_LISTS} SELECT list_id, pos, row_id FROM lists WHERE list_id IN (SELECT s_suppkey FROM supplier)")
def _(spark, d):
    return rows.halo_lists(_all_lists(spark, d), table(spark, d, "supplier"), "s_suppkey")


@query("ahfhalogalaxyext", f"WITH {PRT} SELECT __row, CASE WHEN size >= 40 THEN 1 WHEN price >= 1500 THEN 2 END AS route FROM (SELECT __row, size * 40 AS size0, price AS price, size FROM prt) WHERE size >= 40 OR price >= 1500")
def _(spark, d):
    p = parts(spark, d).withColumn("size0", F.col("size") * 37.5)
    return rows.halo_routes(p, ["size0", "price"], 1500.0).select(ROW, "route")


# smoothing and surfaces of how many line items have each whole quantity, thousand of price and hundredth of discount

_BOX = """q AS (SELECT CAST(floor(l_quantity) AS BIGINT) AS x, CAST(floor(l_extendedprice / 1000.0) AS BIGINT) AS y, CAST(round(l_discount * 100) AS BIGINT) AS z, count(*) AS c FROM lineitem GROUP BY ALL),
    n AS (SELECT max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM q),
    box AS (SELECT x, y, z, CAST(coalesce(c, 0) AS DOUBLE) AS v FROM (SELECT unnest(range(nx)) AS x FROM n) JOIN (SELECT unnest(range(ny)) AS y FROM n) ON true JOIN (SELECT unnest(range(nz)) AS z FROM n) ON true LEFT JOIN q USING (x, y, z))"""


def _box(spark, d) -> tuple[DataFrame, Geometry]:
    item = table(spark, d, "lineitem")
    x, y, z = F.floor(F.col("l_quantity").cast("double")), F.floor(F.col("l_extendedprice").cast("double") / 1000), F.round(F.col("l_discount").cast("double") * 100)
    counts = item.select(*[c.cast("long").alias(k) for k, c in zip("xyz", (x, y, z))]).groupBy("x", "y", "z").count()
    most = counts.agg(*[F.max(c) for c in "xyz"]).first()
    geometry = Geometry(tuple((m or 0) + 1 for m in most))
    return counts.select(geometry.row(*[F.col(c) for c in "xyz"]).alias(ROW), F.col("count").cast("double").alias("v")), geometry


@query("smooth_medium", f"""WITH {_BOX}, w AS (SELECT a.i AS i, b.i AS j, c.i AS k, exp(-0.5 * (a.i * a.i + b.i * b.i + c.i * c.i) / 2.56) AS w FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)),
    pushed AS (SELECT x + i AS x, y + j AS y, z + k AS z, w, w * v AS wv FROM box, w)
    SELECT CAST(x + nx * (y + ny * z) AS BIGINT) AS __row, round(sum(wv) / sum(w), 6) + 0 AS v FROM pushed JOIN n ON x BETWEEN 0 AND nx - 1 AND y BETWEEN 0 AND ny - 1 AND z BETWEEN 0 AND nz - 1 GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    counts, geometry = _box(spark, d)
    mesh = dense(spark, geometry).join(counts, ROW, "left").fillna(0.0, ["v"])
    return rounded(surface.smooth(mesh, "v", geometry))


def _inside(tetrahedron: list[int]) -> str:
    return " + ".join(f"CAST(v{c} > 1.5 AS INTEGER)" for c in tetrahedron)


@query("isosurface_cells", f"""WITH {_BOX}, cubes AS (SELECT x - (k & 1) AS x, y - ((k >> 1) & 1) AS y, z - (k >> 2) AS z, {", ".join(f"max(CASE WHEN k = {k} THEN v END) AS v{k}" for k in range(8))}
    FROM box, (SELECT CAST(k AS INTEGER) AS k FROM range(8) t(k)) GROUP BY 1, 2, 3 HAVING count(*) = 8),
    counts AS (SELECT x, y, z, {" + ".join(f"CASE {_inside(t)} WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END" for t in surface.TETRAHEDRA)} AS t FROM cubes)
    SELECT CAST(x + nx * (y + ny * z) AS BIGINT) AS __row, CAST(t AS BIGINT) AS triangles FROM counts, n WHERE t > 0""")  # fmt: skip
def _(spark, d):
    counts, geometry = _box(spark, d)
    return surface.isosurface(counts, "v", geometry, 1.5, fill=0.0).groupBy(ROW).agg(F.count("*").alias("triangles"))


@query("isosurface_points", f"""WITH {_BOX}, e AS (SELECT k & 1 AS i, (k >> 1) & 1 AS j, k >> 2 AS k FROM (SELECT CAST(k AS INTEGER) AS k FROM range(1, 8) t(k)))
    SELECT round(a.x + i * (1.5 - a.v) / (b.v - a.v), 6) AS x, round(a.y + j * (1.5 - a.v) / (b.v - a.v), 6) AS y, round(a.z + k * (1.5 - a.v) / (b.v - a.v), 6) AS z
    FROM box a JOIN e ON true JOIN box b ON b.x = a.x + i AND b.y = a.y + j AND b.z = a.z + k WHERE (a.v > 1.5) <> (b.v > 1.5)""")  # fmt: skip
def _(spark, d):
    """All points of the surface's triangles, each once."""
    counts, geometry = _box(spark, d)
    found = surface.isosurface(counts, "v", geometry, 1.5, fill=0.0)
    corner = F.explode(F.array(*[F.struct(*[F.round(f"{c}{k}", 6).alias(c) for c in "xyz"]) for k in (1, 2, 3)]))
    return found.select(corner.alias("p")).select("p.*").distinct()


# samples


def _drawn(seed: int) -> str:
    return f"md5('{seed}-' || __row)"


@query("randomizer", f"WITH {ORD} SELECT * FROM ord ORDER BY {_drawn(7)}, __row LIMIT (SELECT CAST(floor(count(*) * 30.0 / 100) AS BIGINT) FROM ord)")
def _(spark, d):
    return sample.randomize(orders(spark, d), 30.0, 7)


@query("decimator", f"WITH {ORD} SELECT * FROM ord WHERE __row % 4 = 0")
def _(spark, d):
    return sample.decimate(orders(spark, d), 3)


@query(
    "visualop",
    f"WITH {ORD}, n AS (SELECT max(__row) + 1 AS n FROM ord), j AS (SELECT __row, price, cust, CAST(floor(__row * 100.0 / n) AS BIGINT) AS s FROM ord, n) "
    f"SELECT __row, price AS price_visual_1, cust AS cust_visual_2, CAST(0 AS DOUBLE) AS NONE FROM j QUALIFY row_number() OVER (PARTITION BY s ORDER BY {_drawn(0)}) = 1",
)
def _(spark, d):
    o = orders(spark, d)
    return sample.visual_sample([(o, ["price"]), (o, ["cust"])], 100)


@query(
    "mres",
    f"WITH {PTS}, l AS (SELECT *, CASE WHEN sqrt(X * X + Y * Y + Z * Z) <= 0.1 THEN 0 WHEN sqrt(X * X + Y * Y + Z * Z) <= 0.2 THEN 1 ELSE 2 END AS l FROM pts), "
    f"r AS (SELECT *, CASE l WHEN 0 THEN __row WHEN 1 THEN __row // 4 ELSE __row // 10 END AS run FROM l) SELECT __row, X, Y, Z, mass FROM r QUALIFY row_number() OVER (PARTITION BY l, run ORDER BY {_drawn(0)}) = 1",
)
def _(spark, d):
    return sample.multi_resolution(points(spark, d), XYZ, (0.0, 0.0, 0.0), [(0.1, 1.0), (0.2, 0.25)], 0.1)


# tables together and apart


@query("merge_smallest", f"WITH {ORD}, {PRT} SELECT __row, o.price AS price_tab_1, p.size AS size_tab_2 FROM ord o JOIN prt p USING (__row)")
def _(spark, d):
    return combine.merge([(orders(spark, d), ["price"]), (parts(spark, d), ["size"])])


@query("merge_huge", f"WITH {ORD}, {PRT} SELECT __row, coalesce(o.price, -1) AS price_tab_1, coalesce(p.size, -1) AS size_tab_2 FROM ord o FULL JOIN prt p USING (__row)")
def _(spark, d):
    return combine.merge([(orders(spark, d), ["price"]), (parts(spark, d), ["size"])], "HUGE", -1.0)


@query("append", f"WITH {ORD}, {PRT} SELECT * FROM ord UNION ALL SELECT __row + (SELECT count(*) FROM ord), price, size FROM prt")
def _(spark, d):
    return combine.append([orders(spark, d), parts(spark, d)])


@query("splittable", f"WITH {ORD}, n AS (SELECT count(*) // 7 AS s, count(*) % 7 AS m FROM ord) SELECT __row, CAST(CASE WHEN __row < m * (s + 1) THEN __row // (s + 1) ELSE m + (__row - m * (s + 1)) // s END AS INTEGER) AS part FROM ord, n")
def _(spark, d):
    return combine.split_rows(orders(spark, d), 7).select(ROW, "part")


_BOUNDS = f"""WITH {ORD}, r AS (SELECT CAST(min(price) AS DOUBLE) AS lo, (CAST(max(price) AS DOUBLE) - CAST(min(price) AS DOUBLE)) / 10000 AS w, count(*) AS n FROM ord),
    h AS (SELECT CAST(least(floor((CAST(price AS DOUBLE) - lo) / w), 9999) AS BIGINT) AS b, count(*) AS c FROM ord, r GROUP BY 1), s AS (SELECT b, c, sum(c) OVER (ORDER BY b) - c AS seen FROM h),
    x AS (SELECT lo + w * (b + (n * j / 4 - seen) / c) AS bound FROM s, r, range(1, 4) t(j) WHERE seen < n * j / 4 AND seen + c >= n * j / 4),
    parts AS (SELECT __row, price, CAST(count(bound) AS INTEGER) AS part FROM ord LEFT JOIN x ON CAST(price AS DOUBLE) > bound GROUP BY __row, price)"""


@query("splittable_field", f"{_BOUNDS} SELECT part, count(*) AS n, min(price) AS low, max(price) AS high FROM parts GROUP BY part")
def _(spark, d):
    split = combine.split_by_value(orders(spark, d), "price", 4)
    return split.groupBy("part").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))


@query("splittable_field_rows", f"{_BOUNDS} SELECT __row, part FROM parts")
def _(spark, d):
    return combine.split_by_value(orders(spark, d), "price", 4).select(ROW, "part")


_STEPS = "SELECT a.__row, CAST(step AS INTEGER) AS step, round(a.price + step / 4.0 * (b.price - a.price), 6) + 0 AS price FROM prt a JOIN p2 b USING (__row), range(1, 4) t(step)"


def _second(spark, d):
    return parts(spark, d).withColumn("price", F.col("price") * 1.5 - F.col("size"))


@query("interpolate", f"WITH {PRT}, p2 AS (SELECT __row, price * 1.5 - size AS price FROM prt) {_STEPS}")
def _(spark, d):
    return rounded(combine.snapshots(parts(spark, d), _second(spark, d), ["price"], 4))


@query(
    "interpolate_periodic",
    f"""WITH {PRT}, p2 AS (SELECT __row, price * 1.5 - size AS price FROM prt), r AS (SELECT min(price) AS lo, max(price) AS hi FROM (SELECT price FROM prt UNION ALL SELECT price FROM p2)),
    m AS (SELECT __row, CAST(step AS INTEGER) AS step, lo, hi, a.price + step / 4.0 * CASE WHEN abs(b.price - a.price) > (hi - lo) / 2 THEN b.price - a.price - sign(b.price - a.price) * (hi - lo) ELSE b.price - a.price END AS v
    FROM prt a JOIN p2 b USING (__row), r, range(1, 4) t(step)) SELECT __row, step, round(CASE WHEN v < lo THEN v + (hi - lo) WHEN v > hi THEN v - (hi - lo) ELSE v END, 6) + 0 AS price FROM m""",
)
def _(spark, d):
    return rounded(combine.snapshots(parts(spark, d), _second(spark, d), ["price"], 4, periodic=True))


# statistics


@query("statistic", f"""WITH {PTS} SELECT 'X' AS "column", min(X) AS minimum, max(X) AS maximum, round(avg(X), 6) + 0 AS average, round(sum(X), 6) + 0 AS total FROM pts UNION ALL SELECT 'mass', min(mass), max(mass), round(avg(mass), 6), round(sum(mass), 6) FROM pts""")
def _(spark, d):
    found = stats.statistic(points(spark, d), ["mass", "X"])
    return found.withColumns({c: F.round(c, 6) + 0.0 for c in ("average", "total")})


@query("statistic_range", f"""WITH {ORD} SELECT 'price' AS "column", min(price) AS minimum, max(price) AS maximum, round(avg(price), 4) AS average, round(sum(price), 2) AS total FROM ord WHERE price BETWEEN 1000 AND 50000""")
def _(spark, d):
    found = stats.statistic(orders(spark, d), ["price"], (1000.0, 50000.0))
    return found.withColumns({"average": F.round("average", 4), "total": F.round("total", 2)})


@query(
    "histogram",
    f"""WITH {PTS}, v AS (SELECT X AS v, 0 AS c FROM pts UNION ALL SELECT Y, 1 FROM pts), b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20 AS w FROM v),
    h AS (SELECT CAST(least(floor((v - lo) / w), 19) AS INTEGER) AS bin, count(*) FILTER (c = 0) AS X, count(*) FILTER (c = 1) AS Y FROM v, b GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 6) + 0 AS bin_start, coalesce(X, 0) AS X, coalesce(Y, 0) AS Y FROM range(20) t(i) JOIN b ON true LEFT JOIN h ON bin = i""",
)
def _(spark, d):
    return rounded(stats.histogram(points(spark, d), ["X", "Y"], 20))


@query("normalise", f"WITH {PTS} SELECT __row, round((X - min(X) OVER w) / (max(X) OVER w - min(X) OVER w), 6) + 0 AS X FROM pts WINDOW w AS (PARTITION BY mass)")
def _(spark, d):
    return rounded(stats.normalize(points(spark, d), ["X"], "mass").select(ROW, "X"))


# meshes


def _axis(c: str, scheme: str, n: int, periodic: bool) -> tuple[str, str, str]:
    """Offsets, cell and weight of one axis in SQL."""
    p = f"p{c}"
    offsets = {"NGP": (0,), "CIC": (0, 1), "TSC": (-1, 0, 1, 2)}[scheme]
    cell = f"ceil({p} - 0.5)" if scheme == "NGP" else f"floor({p}) + o{c}"
    d = f"abs({p} - (floor({p}) + o{c}))"
    weight = {"NGP": "1.0", "CIC": f"CASE o{c} WHEN 0 THEN 1 - ({p} - floor({p})) ELSE {p} - floor({p}) END", "TSC": f"CASE WHEN {d} <= 0.5 THEN 0.75 - {d} * {d} WHEN {d} <= 1.5 THEN 0.5 * (1.5 - {d}) * (1.5 - {d}) ELSE 0 END"}[scheme]
    cell = f"((({cell}) % {n}) + {n}) % {n}" if periodic else cell
    return ", ".join(f"({o})" for o in offsets), cell, weight


def touched_sql(scheme: str, periodic: bool = False, n: int = N) -> str:
    """CTEs ``b`` (bounds), ``p`` (places) and ``t`` (point, cell, weight) over ``pts``."""
    axes = {c: _axis(c, scheme, n, periodic) for c in XYZ}
    bounds = ", ".join(f"min({c}) AS {c}0, (max({c}) - min({c})) / {n} AS d{c}" for c in XYZ)
    places = ", ".join(f"({c} - {c}0) / d{c} AS p{c}" for c in XYZ)
    cells = ", ".join(f"CAST({axes[c][1]} AS BIGINT) AS i{c}, {axes[c][2]} AS w{c}" for c in XYZ)
    offsets = ", ".join(f"(VALUES {axes[c][0]}) AS a{c}(o{c})" for c in XYZ)
    inside = " AND ".join(f"i{c} BETWEEN 0 AND {n - 1}" for c in XYZ)
    return (
        f"b AS (SELECT {bounds} FROM pts), p AS (SELECT __row, mass, {places} FROM pts, b), t0 AS (SELECT __row, mass, {cells} FROM p, {offsets}), "
        f"t AS (SELECT __row, mass, iX + {n} * (iY + {n} * iZ) AS cell, wX * wY * wZ AS w FROM t0 WHERE {inside})"
    )


def _mesh_sql(scheme: str, periodic: bool = False) -> str:
    return (
        f"WITH {PTS}, {touched_sql(scheme, periodic)}, m AS (SELECT cell, sum(w * mass) AS s FROM t GROUP BY cell) "
        f"SELECT i AS __row, round(coalesce(s, 0) / (dX * dY * dZ), 4) + 0 AS mass FROM range({N**3}) r(i) JOIN b ON true LEFT JOIN m ON cell = i"
    )


def _scattered(scheme: str, periodic: bool = False) -> Query:
    return lambda spark, d: rounded(grid.scatter(points(spark, d), XYZ, ["mass"], (N, N, N), scheme, periodic=periodic)[0], 4)


for _scheme in ("NGP", "CIC", "TSC"):
    query(f"pointdistribute_{_scheme.lower()}", _mesh_sql(_scheme))(_scattered(_scheme))
query("pointdistribute_periodic", _mesh_sql("CIC", True))(_scattered("CIC", True))


@query(
    "pointdistribute_avg",
    f"WITH {PTS}, {touched_sql('NGP')}, m AS (SELECT cell, count(*) AS c, sum(mass) AS s FROM t GROUP BY cell) SELECT i AS __row, CAST(coalesce(c, 0) AS DOUBLE) AS NumberOfElements, round(coalesce(s, 0), 4) + 0 AS massSum, round(coalesce(s / c, 0), 4) + 0 AS massAvg FROM range({N**3}) r(i) LEFT JOIN m ON cell = i",
)
def _(spark, d):
    return rounded(grid.scatter(points(spark, d), XYZ, ["mass"], (N, N, N), average=True)[0], 4)


def _gather_sql(scheme: str, by: str, value: str, mesh: str) -> str:
    return (
        f"WITH {PTS}, {touched_sql(scheme)}, {mesh}, g AS (SELECT __row, sum(w * s) AS g FROM t JOIN m USING (cell) GROUP BY __row) "
        f"SELECT __row, round(1e-7 + coalesce(g, 0) * {by}, 4) + 0 AS {value} FROM pts JOIN b ON true LEFT JOIN g USING (__row)"
    )


_FIELD = f"m AS (SELECT i AS cell, CAST(i % 13 AS DOUBLE) AS s FROM range({N**3}) r(i))"
for _scheme in ("NGP", "CIC", "TSC"):

    def _gathered(spark: SparkSession, d: str, scheme: str = _scheme) -> DataFrame:
        pts = points(spark, d)
        geometry = grid.bounds_geometry(pts, XYZ, (N, N, N))
        mesh = spark.range(geometry.cells).select(F.col("id").alias(ROW), (F.col("id") % 13).cast("double").alias("f"))
        return rounded(grid.gather(pts, XYZ, mesh, "f", geometry, scheme, density=scheme != "NGP", name="value").select(ROW, "value"), 4)

    query(f"grid2point_{_scheme.lower()}", _gather_sql(_scheme, "(dX * dY * dZ)" if _scheme == "NGP" else "1", "value", _FIELD))(_gathered)


@query("pointproperty", _gather_sql("CIC", "1", "density", "m AS (SELECT cell, sum(w) / (SELECT dX * dY * dZ FROM b) AS s FROM t GROUP BY cell)"))
def point_property(spark, d):
    return rounded(grid.point_property(points(spark, d), XYZ, resolution=(N, N, N), name="density").select(ROW, "density"), 4)


# volumes; the fixture is 8 x 8 x 8 counts of points

_VOLUME = f"{PTS}, {touched_sql('NGP')}, m AS (SELECT cell, count(*) AS c FROM t GROUP BY cell), vol AS (SELECT i AS __row, i % 8 AS ix, i // 8 % 8 AS iy, i // 64 AS iz, CAST(coalesce(c, 0) AS DOUBLE) AS f FROM range(512) r(i) LEFT JOIN m ON cell = i)"


def _volume(spark, d):
    mesh, geometry = grid.scatter(points(spark, d), XYZ, (), (N, N, N), "NGP", density=False)
    return mesh.withColumnRenamed("Constant", "f"), geometry


@query("extractsubvolume", f"WITH {_VOLUME} SELECT (ix - 2) + 4 * ((iy - 1) + 3 * (iz - 3)) AS __row, f FROM vol WHERE ix BETWEEN 2 AND 5 AND iy BETWEEN 1 AND 3 AND iz BETWEEN 3 AND 7")
def _(spark, d):
    return rows.extract_subvolume(*_volume(spark, d), (2, 1, 3), (4, 3, 5))[0]


@query(
    "coarsevolume",
    f"WITH {_VOLUME}, gone AS (SELECT CAST(floor(8 / 5.0 * j) AS BIGINT) AS g FROM range(1, 5) t(j)), kept AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS k FROM range(8) t(i) WHERE i NOT IN (SELECT g FROM gone)) "
    "SELECT x.k + 4 * (y.k + 4 * z.k) AS __row, f FROM vol JOIN kept x ON x.i = ix JOIN kept y ON y.i = iy JOIN kept z ON z.i = iz",
)
def _(spark, d):
    return sample.coarsen(*_volume(spark, d), (4, 4, 4))[0]


@query("showvol", f"WITH {_VOLUME} SELECT CAST(ix + 1 AS INTEGER) AS X, CAST(iy + 1 AS INTEGER) AS Y, CAST(iz + 1 AS INTEGER) AS Z, f FROM vol WHERE f >= 2 ORDER BY __row LIMIT 20")
def _(spark, d):
    return rows.show_volume(*_volume(spark, d), {"f": (2.0, None)}, n_cells=20)


@query("selvol", f"WITH {_VOLUME} SELECT __row, CASE WHEN f BETWEEN 1 AND 3 THEN f ELSE 0 END AS f FROM vol")
def _(spark, d):
    return rows.select_volume(_volume(spark, d)[0], {"f": (1.0, 3.0)})


@query("splittable_volume", f"WITH {_VOLUME} SELECT __row, f, CAST(least(iz // 2, 2) AS INTEGER) AS part FROM vol")
def _(spark, d):
    return combine.split_volume(*_volume(spark, d), axis=3, parts=3)


@query(
    "poca",
    f"""WITH {PTS}, e AS (SELECT *, 0.5 AS ux, 1.0 AS uy, 2.0 AS uz, mass / 10 AS vx, 1.0 AS vy, 2.5 AS vz, Y AS qx, Z AS qy, X AS qz FROM pts),
    k AS (SELECT *, ux*ux+uy*uy+uz*uz AS a, ux*vx+uy*vy+uz*vz AS b, vx*vx+vy*vy+vz*vz AS c, ux*(X-qx)+uy*(Y-qy)+uz*(Z-qz) AS d, vx*(X-qx)+vy*(Y-qy)+vz*(Z-qz) AS e FROM e),
    s AS (SELECT *, (b*e-c*d)/(a*c-b*b) AS s, (a*e-b*d)/(a*c-b*b) AS t FROM k)
    SELECT __row, round((X+s*ux+qx+t*vx)/2, 6) + 0 AS px, round((Y+s*uy+qy+t*vy)/2, 6) + 0 AS py, round((Z+s*uz+qz+t*vz)/2, 6) + 0 AS pz, round(acos(b / sqrt(a * c)), 6) + 0 AS theta FROM s""",
)
def _(spark, d):
    fixed = {"ux": 0.5, "uy": 1.0, "uz": 2.0, "vy": 1.0, "vz": 2.5}
    events = points(spark, d).withColumns({k: F.lit(x) for k, x in fixed.items()}).withColumn("vx", F.col("mass") / 10).withColumns({"qx": F.col("Y"), "qy": F.col("Z"), "qz": F.col("X")})
    return rounded(grid.closest_approach(events, ["X", "Y", "Z", "ux", "uy", "uz"], ["qx", "qy", "qz", "vx", "vy", "vz"]).select(ROW, "px", "py", "pz", "theta"))


@query(
    "poca_voxels",
    f"""WITH {PTS} SELECT CAST(floor((X + 0.5) / 0.25) + 4 * (floor((Y + 0.5) / 0.25) + 4 * floor((Z + 0.5) / 0.25)) AS BIGINT) AS __row, count(*) AS n, round(sum(mass), 4) AS sum_theta, round(avg(mass), 4) AS mean_theta,
    round(sum(mass * mass), 4) AS sum_theta2, round(avg(mass * mass), 4) AS mean_theta2, round(stddev_pop(mass), 4) + 0 AS sigma_theta, CASE WHEN count(*) > 1 THEN round(1 / sqrt(2 * (count(*) - 1)), 4) END AS error
    FROM pts WHERE X BETWEEN -0.5 AND 0.4999 AND Y BETWEEN -0.5 AND 0.4999 AND Z BETWEEN -0.5 AND 0.4999 GROUP BY 1""",
)
def _(spark, d):
    return rounded(grid.voxel_statistics(points(spark, d), Geometry((4, 4, 4), (0.25, 0.25, 0.25), (-0.5, -0.5, -0.5)), XYZ, "mass"), 4)


# listings and positions


@query("showtable", f"WITH {ORD} SELECT __row, lpad(printf('%d', CAST(cust AS BIGINT)), 8, ' ') AS line FROM ord WHERE __row BETWEEN 10 AND 29")
def _(spark, d):
    return text.show_table(orders(spark, d), ["cust"], (10, 29), width=8)


@query("row_positions", f"WITH {CLOUD} SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS __row, l_quantity AS X FROM lineitem")
def _(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return with_row(table(spark, d, "lineitem").select(*order), *order).select(ROW, F.col("l_quantity").alias("X"))


@query("cloud_density", f"WITH {CLOUD}, c AS (SELECT CAST(ceil(X / 5 - 0.5) AS BIGINT) AS i, CAST(ceil(Y / 10 - 0.5) AS BIGINT) AS j, CAST(ceil(Z - 0.5) AS BIGINT) AS k, mass FROM cloud) SELECT i + 11 * (j + 11 * k) AS __row, CAST(count(*) AS DOUBLE) AS NumberOfElements, round(sum(mass), 4) AS massSum, round(avg(mass), 6) AS massAvg FROM c WHERE i BETWEEN 0 AND 10 AND j BETWEEN 0 AND 10 AND k BETWEEN 0 AND 10 GROUP BY 1")
def _(spark, d):
    mesh, _ = grid.scatter(cloud(spark, d), XYZ, ["mass"], geometry=Geometry((11, 11, 11), (5.0, 10.0, 1.0)), average=True, sparse=True)
    return mesh.withColumns({"massSum": F.round("massSum", 4), "massAvg": F.round("massAvg", 6)})


@query("vbt2ahf", f"WITH {PTS} SELECT __row, round((X / 2 + 1) % 1, 6) + 0 AS x, round((Y / 2 + 1) % 1, 6) + 0 AS y, round((Z / 2 + 1) % 1, 6) + 0 AS z, round(mass / 200, 6) AS vx, round(mass / 200, 6) AS vy, round(X / 200, 6) + 0 AS vz FROM pts")
def _(spark, d):
    return rounded(halo.scaled(points(spark, d), ["X", "Y", "Z", "mass", "mass", "X"], 2.0))


# dense groups of the line items as points, a cell being dense from a three hundredth of all on

_GROUPS = f"""{CLOUD}, e AS (SELECT min(X) AS x0, (max(X) - min(X)) / 4 AS dx, min(Y) AS y0, (max(Y) - min(Y)) / 4 AS dy, min(Z) AS z0, (max(Z) - min(Z)) / 4 AS dz, count(*) // 300 AS k FROM cloud),
    f AS (SELECT least(CAST(floor((X - x0) / (dx / 4)) AS BIGINT), 15) AS x, least(CAST(floor((Y - y0) / (dy / 4)) AS BIGINT), 15) AS y, least(CAST(floor((Z - z0) / (dz / 4)) AS BIGINT), 15) AS z, count(*) AS n FROM cloud, e GROUP BY ALL),
    c AS (SELECT l, x >> (2 - l) AS x, y >> (2 - l) AS y, z >> (2 - l) AS z, CAST(sum(n) AS BIGINT) AS n FROM f, (SELECT CAST(l AS BIGINT) AS l FROM range(3) t(l)) GROUP BY ALL HAVING sum(n) >= (SELECT greatest(1, k) FROM e)),
    cells AS (SELECT *, CASE l WHEN 0 THEN 0 WHEN 1 THEN 64 ELSE 576 END + x + (4 << l) * (y + (4 << l) * z) AS id FROM c),
    reach AS (SELECT id AS a, id AS b, l, x, y, z FROM cells UNION SELECT r.a, t.id, t.l, t.x, t.y, t.z FROM reach r JOIN cells t ON t.l = r.l AND abs(t.x - r.x) + abs(t.y - r.y) + abs(t.z - r.z) = 1),
    own AS (SELECT b AS id, min(a) AS g FROM reach GROUP BY b)"""


@query("dense_groups", f"WITH RECURSIVE {_GROUPS}, m AS (SELECT cells.*, g FROM cells JOIN own USING (id)) SELECT CAST(m.l AS INTEGER) AS level, m.g AS \"group\", min(p.g) AS parent, count(*) AS n_cells, CAST(sum(m.n) AS BIGINT) AS n FROM m LEFT JOIN m p ON p.l = m.l - 1 AND p.x = m.x >> 1 AND p.y = m.y >> 1 AND p.z = m.z >> 1 GROUP BY m.l, m.g")
def _(spark, d):
    c = cloud(spark, d)
    return groups.dense_groups(c, XYZ, (4, 4, 4), max(1, c.count() // 300), 3).select("level", "group", "parent", "n_cells", "n")


# camera values and slices over the range of a table's points


def _ends(spark, d) -> tuple[list[float], list[float]]:
    found = points(spark, d).agg(*[f(c) for c in XYZ for f in (F.min, F.max)]).first()
    return [x or 0.0 for x in found[::2]], [x or 0.0 for x in found[1::2]]


_ENDS = "r AS (SELECT min(X) AS x0, max(X) AS x1, min(Y) AS y0, max(Y) AS y1, min(Z) AS z0, max(Z) AS z1 FROM pts)"


@query("createpath", f"WITH {PTS}, {_ENDS} SELECT i AS frame, round(x0 + i * (x1 - x0) / 40, 6) + 0 AS azimuth, round(y0 + i * (y1 - y0) / 40, 6) + 0 AS elevation, round(z0 + i * (z1 - z0) / 40, 6) + 0 AS zoom FROM r, range(41) t(i)")
def _(spark, d):
    return rounded(sequences.camera_path(spark, *_ends(spark, d), 4, 10))


@query("orthoslices", "WITH n AS (SELECT CAST(max(l_quantity) AS INTEGER) AS n FROM lineitem) SELECT DISTINCT CAST(s AS INTEGER) AS slice FROM (SELECT unnest(range(0, n + 1, 7)) AS s FROM n UNION ALL SELECT n FROM n)")
def _(spark, d):
    """Every seventh plane of the whole quantities, and the last one."""
    return sequences.ortho_slices(spark, 0, int(cloud(spark, d).agg(F.max("X")).first()[0] or 0), 7)


@query("genericslices", f"WITH {PTS}, {_ENDS} SELECT i AS slice, round(x0 + i * (x1 - x0) * 0.125, 6) + 0 AS x, round(y0 + i * (y1 - y0) * 0.125, 6) + 0 AS y, round(z0 + i * (z1 - z0) * 0.125, 6) + 0 AS z FROM r, range(9) t(i)")
def _(spark, d):
    return rounded(sequences.plane_slices(spark, *_ends(spark, d), 0.125, 9))


# points as blobs in a picture

_CAMERA = projection.Camera((0.2, -1.5, 0.4), (0.0, 0.0, 0.0), pixels=(48, 36))


def _blobs_sql() -> str:
    right, up, into = ([repr(float(x)) for x in axis] for axis in _CAMERA.axes())
    x, y, z = _CAMERA.position
    nx, ny = _CAMERA.pixels
    dot = lambda a: f"(X - {x}) * {a[0]} + (Y - {y}) * {a[1]} + (Z - {z}) * {a[2]}"
    return f"""{PTS}, v AS (SELECT __row, mass, 0.01 + 0.002 * mass AS r, {dot(right)} AS vx, {dot(up)} AS vy, {dot(into)} AS z FROM pts),
    s AS (SELECT *, {nx / 2} / (tan(radians(22.5)) * z) AS scale FROM v WHERE z > 0),
    b AS (SELECT __row, z, {nx / 2} + vx * scale AS px, {ny / 2} + vy * scale AS py, sqrt(r * r * scale * scale + 1) AS pr,
      mass * 1e-5 * {8 * projection.WIDTH / 3.141592653589793**0.5!r} / (r * r) * (r * r * scale * scale) / (r * r * scale * scale + 1) AS e FROM s),
    hits AS (SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, __row, z, e, e * exp(-((ix - px) ** 2 + (iy - py) ** 2) / ({projection.WIDTH!r} * pr) ** 2) AS a
      FROM b, range({nx}) g(ix), range({ny}) h(iy) WHERE iy - py > -sqrt(greatest(0, pr * pr - (ix - px) ** 2)) AND iy - py <= sqrt(greatest(0, pr * pr - (ix - px) ** 2)))"""


def _blobs(spark, d) -> DataFrame:
    p = points(spark, d).withColumns({"r": 0.01 + 0.002 * F.col("mass"), "light": F.col("mass") * 1e-5})
    return projection.project(p, XYZ, "r", ["light"], _CAMERA)


@query("project_points", f"WITH {_blobs_sql()} SELECT __row, round(px, 6) + 0 AS px, round(py, 6) + 0 AS py, round(z, 6) + 0 AS depth, round(pr, 6) + 0 AS pr, round(e, 6) + 0 AS light FROM b WHERE floor(px + pr) >= 0 AND floor(px - pr) + 1 < 48 AND floor(py + pr) >= 0 AND floor(py - pr) + 1 < 36")
def _(spark, d):
    return rounded(_blobs(spark, d).select(ROW, "px", "py", "depth", "pr", "light"))


@query("picture", f"WITH {_blobs_sql()} SELECT ix, iy, round(1 - exp(-sum(a)), 6) + 0 AS light FROM hits GROUP BY ALL")
def _(spark, d):
    return rounded(projection.picture(_blobs(spark, d), ["light"], _CAMERA))


@query("picture_absorbed", f"WITH {_blobs_sql()}, f AS (SELECT *, sum(a) OVER (PARTITION BY ix, iy ORDER BY z, __row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearer FROM hits) SELECT ix, iy, round(sum(e / (e + 0.2) * (1 - exp(-a)) * exp(-coalesce(nearer, 0))), 6) + 0 AS light FROM f GROUP BY ALL")
def _(spark, d):
    return rounded(projection.picture(_blobs(spark, d), ["light"], _CAMERA, 0.2, [ROW]))


__all__ = ["oracle_sql", "point_property", "queries"]
