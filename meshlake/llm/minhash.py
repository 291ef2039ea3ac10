"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct 5-word shingles, each hashed once.

1. Its sketch keeps the SKETCH least hashes.  Documents with the same words in the same
   order are one class and go on as one.
2. Inverted lists of all retained values bring classes together.  Step 3 keeps a pair only
   if it shares half of its values, so it surely meets in the lists of each side's rarest
   values, one more than half of them: only these lists are walked.
3. The union's sketch, which follows from both sketches, estimates the similarity.  Pairs
   below half are out: at 0.85, 64 values lie there with a probability below 1e-11.
4. The exact similarity of the full sets, as words and not as hashes, confirms a link.
5. Links are joined to components.

Lists of at most SHORT classes are written out in pairs.  Longer ones are taken together
by a pivot that they share, so that near copies, which have many lists in common, meet
once; all classes of such a list are first compared with two of its classes, and those
that are then in one component need no more.  Only lists that still hold several
components are laid in blocks: the classes outside the largest one meet all others, a task
for each pair of blocks, by the overlaps of the full sets.  A task gives only links that
join what is not joined yet, so no list is ever written out in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST, fresh, identity, keep, small
from ._words import Words, coded, exact_shingles, normal, shingle_hashes, signed, slices
from .components import components

WIDTH = 5
#: Least similarity, per cent.
SIMILARITY = 85
SKETCH = 64
#: Longest list that is written out in pairs.
SHORT = 16
#: Most classes, and shingles of classes, of a block (on average).
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Lists with this share of all entries are set apart by a broadcast; so there are at most 1 / HUGE such lists.
HUGE = 1e-4
#: Pairs of one class from which on they are dealt over several tasks.
HOT_PAIRS = 256


def set_of(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: the distinct shingles of each text, ascending."""
    hashes, first = shingle_hashes(words.hashes(), words.first, width)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(first)))


def parts(hashes: np.ndarray, first: np.ndarray, most: int | None = None) -> pa.Array:
    """A list column with the (first ``most``) values of each set."""
    size = np.diff(first) if most is None else np.minimum(np.diff(first), most)
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(first[:-1] - ends[:-1], size)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(hashes[at])))


def union_estimate(a: pa.Array, b: pa.Array, sketch: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    """``(shared, size)`` for pairs of sketches: how many of the union's least values both have, and how many the union's sketch has."""

    def rows(column: pa.Array) -> np.ndarray:
        out = np.full((len(column), sketch), np.uint64(2**64 - 1))
        size = np.diff(column.offsets.to_numpy())
        out[np.arange(sketch) < size[:, None]] = column.flatten().to_numpy().view(np.uint64)
        return out

    return union_shares(rows(a), rows(b))


def union_shares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``union_estimate`` of rows of ascending values, filled up with the greatest."""
    sketch = a.shape[1]
    both = np.sort(np.concatenate([a, b], 1), axis=1)
    real = both != np.uint64(2**64 - 1)
    twin = np.zeros(both.shape, bool)
    twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & real[:, 1:]
    inside = np.cumsum(real & ~twin, axis=1) <= sketch
    return (twin & inside).sum(1), np.minimum(sketch, (real & ~twin).sum(1))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: ``row`` (names its id and text), ``n`` shingles, ``name`` (of its words in lower case, null without any), ``sketch``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), identity(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "text")):
            words = Words(b.column("text"), lower=True)
            hashes, first = set_of(words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(np.diff(first)), normal(words), parts(hashes, first, SKETCH)], names=["doc_id", "row", "n", "name", "sketch"])

    return rows.mapInArrow(made, "doc_id long, row binary, n long, name binary, sketch array<long>")


def texts_of(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(node, text)`` for the rows of ``wanted``, which has ``row`` and ``node``."""
    texts = docs.select(identity(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    return texts.join(small(wanted), "row").groupBy("node").agg(F.first("text").alias("text"))


def prefixes(classes: DataFrame) -> DataFrame:
    """``(node, n, keys)``: the values in whose lists a class is to be looked up, if another class has any of them."""
    entries = classes.select("node", "n", F.explode("sketch").alias("v"))
    counts = keep(entries.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"))
    total = classes.agg(F.sum(F.size("sketch"))).first()[0] or 0
    huge = F.broadcast(counts.where(F.col("c") >= HUGE * total))
    shared = entries.join(huge, "v").unionByName(entries.join(huge, "v", "left_anti").join(counts, "v"))
    found = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("s"))
    size = F.least(F.col("n"), F.lit(SKETCH)).cast("int")
    # values that no other class has are the rarest: they stand in front and bring nobody
    first = F.floor(size / 2).cast("int") + 1 - (size - F.size("s"))
    return found.where(first > 0).select("node", "n", F.transform(F.slice("s", 1, first), lambda x: x["v"]).alias("keys"))


def _short_pairs(lists: DataFrame, sizes: DataFrame, similarity: int) -> DataFrame:
    """Pairs of classes from lists of at most SHORT; pairs whose sizes rule the similarity out are none."""
    short = lists.select("v", "node", "n").join(sizes.where(F.col("c") <= SHORT).select("v"), "v")
    found = short.groupBy("v").agg(F.collect_list(F.struct("node", "n")).alias("l"))
    like = lambda x, y: (x["node"] < y["node"]) & (100 * F.least(x["n"], y["n"]) >= similarity * F.greatest(x["n"], y["n"]))
    pairs = F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: like(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    return found.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _gathered(long: DataFrame) -> DataFrame:
    """``(v, node, n, keys)``: long lists taken together if they have one pivot, the class of theirs that stands in most long lists.

    Near copies share many lists, and so their pivot; they meet once instead of in every
    list.  ``v`` is the pivot, which has SKETCH values and so stands for SKETCH lists at
    most; ``keys`` are all the pivots of a class.
    """
    central = F.struct(F.size("keys"), -F.col("node"))
    pivots = keep(long.groupBy("v").agg(F.max_by("node", central).alias("pivot")))
    members = long.select("v", "node", "n").join(small(pivots), "v").select("pivot", "node", "n").distinct()
    keys = members.groupBy("node", "n").agg(F.sort_array(F.collect_list("pivot")).alias("keys"))
    return keys.select(F.explode("keys").alias("v"), "node", "n", "keys")


def _pivot_pairs(lists: DataFrame, similarity: int) -> DataFrame:
    """Every class of a list with two of the list: its pivot and its least."""
    first = keep(lists.groupBy("v").agg(F.min(F.struct("node", "n")).alias("two"), F.max(F.when(F.col("node") == F.col("v"), F.struct("node", "n"))).alias("one")))
    pairs = lists.select("v", "node", "n").join(small(first), "v").select("node", "n", F.explode(F.array("one", "two")).alias("p"))
    like = 100 * F.least("n", "p.n") >= similarity * F.greatest("n", "p.n")
    return pairs.where((F.col("node") != F.col("p.node")) & like).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))


def _with_both(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """``(a, b, left, right)``: pairs with the second column of ``values`` by its ``node``; pairs of one class go to several tasks."""
    out, value = pairs, values.columns[1]
    ends = pairs.select(F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("a").alias("node")), F.struct(F.lit(1).alias("end"), F.col("b").alias("node")))).alias("e"))
    hot = ends.groupBy("e.end", "e.node").agg(F.ceil(F.count("*") / HOT_PAIRS).cast("int").alias("__deal")).where("__deal > 1")
    hot = keep(hot)
    some = hot.count()
    for end, side, other, name in ((0, "a", "b", "left"), (1, "b", "a", "right")):
        of = values.select(F.col("node").alias(side), F.col(value).alias(name))
        if not some:
            out = out.join(of, side)
            continue
        deal = hot.where(F.col("end") == end).select(F.col("node").alias(side), "__deal")
        deal = F.broadcast(deal) if some <= BROADCAST else deal
        dealt = out.join(deal, side, "left").withColumn("__salt", F.pmod(F.xxhash64(other), F.coalesce("__deal", F.lit(1))).cast("int")).drop("__deal")
        of = of.join(deal, side, "left").select(side, name, F.explode(F.sequence(F.lit(0), F.coalesce("__deal", F.lit(1)) - 1)).alias("__salt"))
        out = dealt.join(of, [side, "__salt"]).drop("__salt")
    return out.select("a", "b", "left", "right")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose union sketch does not rule the similarity out."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared, size = union_estimate(b.column("left"), b.column("right"))
            ok = pa.array(2 * shared >= size)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return _with_both(pairs, classes.select("node", "sketch")).mapInArrow(kept, "a long, b long")


def similar(left: pa.Array, right: pa.Array, similarity: int, width: int = WIDTH) -> np.ndarray:
    """True for each pair of texts whose sets of shingles, compared as words, reach the similarity."""
    n = len(left)
    words = Words(pa.concat_arrays([left, right]), lower=True)
    value, text = exact_shingles(coded(words.data, words.start, words.end)[0], words.first, width)
    sizes = np.bincount(text, minlength=2 * n)
    order = np.lexsort((value, text % n))
    pair, value = (text % n)[order], value[order]
    twin = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
    both = np.bincount(pair[1:][twin], minlength=n)
    return (100 * both >= similarity * (sizes[:n] + sizes[n:] - both)) & (sizes[:n] > 0)


def _confirmed(pairs: DataFrame, texts: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "left", 1 << 20)):
            for b in slices(b, "right", 1 << 20):
                ok = pa.array(similar(b.column("left"), b.column("right"), similarity))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return _with_both(pairs, texts).mapInArrow(kept, "a long, b long")


def overlaps(a: np.ndarray, rows_a: np.ndarray, n_a: int, b: np.ndarray, rows_b: np.ndarray, n_b: int, columns: int = 2048) -> np.ndarray:
    """``[i, j]``: how many values row i of one side and row j of the other share; values are distinct in a row."""
    common = np.intersect1d(a, b)
    out = np.zeros((n_a, n_b), np.float32)
    place = [np.searchsorted(common, x) for x in (a, b)]
    found = [p < len(common) for p in place]
    found = [f & (common[np.minimum(p, len(common) - 1)] == x) if len(common) else f for f, p, x in zip(found, place, (a, b))]
    for c in range(0, len(common), columns):
        sides = []
        for p, f, rows, n in zip(place, found, (rows_a, rows_b), (n_a, n_b)):
            here = f & (p >= c) & (p < c + columns)
            m = np.zeros((n, min(columns, len(common) - c)), np.float32)
            m[rows[here], p[here] - c] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def block_links(v: int, nodes: np.ndarray, side: np.ndarray, component: np.ndarray, keys: list[np.ndarray], sets: list[np.ndarray], similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links between the two sides that join components not joined yet; pairs that share a lesser list than ``v`` are looked at there."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    n = np.fromiter(map(len, sets), np.int64, len(sets))

    def flat(rows: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        return np.concatenate([values[r] for r in rows]), np.repeat(np.arange(len(rows)), [len(values[r]) for r in rows]), len(rows)

    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    earlier = [x[x < v] for x in keys]
    able = (overlaps(*flat(left, earlier), *flat(right, earlier)) == 0) & (component[left][:, None] != component[right])
    common = overlaps(*flat(left, sets), *flat(right, sets))
    able &= 100 * common >= similarity * (n[left][:, None] + n[right] - common)
    i, j = np.nonzero(able)
    # one link between two components is enough
    _, name = np.unique(component, return_inverse=True)
    _, once = np.unique(name[left[i]] * len(nodes) + name[right[j]], return_index=True)
    root = list(range(len(nodes)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a_out, b_out = [], []
    for x, y in zip(left[i[once]].tolist(), right[j[once]].tolist()):
        a, b = top(int(name[x])), top(int(name[y]))
        if a != b:
            root[a] = b
            a_out.append(nodes[x])
            b_out.append(nodes[y])
    return np.array(a_out, np.int64), np.array(b_out, np.int64)


def _compared(group: pa.Table, similarity: int) -> pa.Table:
    group = group.combine_chunks()
    keys, sets = ([x.values.to_numpy() for x in group[c]] for c in ("keys", "shingles"))
    sides = [group[c].to_numpy() for c in ("node", "side", "component")]
    a, b = block_links(group["v"][0].as_py(), *sides, keys, [x.view(np.uint64) for x in sets], similarity)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _mixed(long: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of long lists that hold several components, with ``component`` and whether it is the list's largest (``main``)."""
    of = long.join(roots.withColumnRenamed("root", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    lists = of.groupBy("v", "component").agg(F.count("*").alias("c")).groupBy("v").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.count("*").alias("k"))
    lists = keep(lists.where("k > 1").select("v", "largest"))
    return of.join(small(lists), "v").withColumn("main", F.col("component") == F.col("largest")).drop("largest")


def _in_blocks(mixed: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links between the components of each list, by pairs of a block of classes outside the largest one and a block of all."""
    minor = F.when(~F.col("main"), 1).otherwise(0)
    blocks = lambda c, s: F.greatest(F.lit(1), F.ceil(c / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    sizes = mixed.groupBy("v").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.sum(minor).alias("mc"), F.sum(minor * F.col("n")).alias("ms"))
    sizes = keep(sizes.select("v", blocks(F.col("c"), F.col("s")).alias("all"), blocks(F.col("mc"), F.col("ms")).alias("few")))
    dealt = mixed.join(small(sizes), "v").withColumn("hash", F.xxhash64("node", "v"))
    columns = ["v", "node", "component", "keys"]
    one = dealt.where("not main").select(*columns, F.pmod("hash", "few").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"), F.lit(0).alias("side"))
    two = dealt.select(*columns, F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), F.pmod("hash", "all").cast("int").alias("j"), F.lit(1).alias("side"))
    return one.unionByName(two).join(sets, "node").groupBy("v", "i", "j").applyInArrow(lambda group: _compared(group, similarity), "a long, b long")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more links, which are drawn between the roots only."""
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    every = roots.unionByName(ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    of = links.join(every.toDF("a", "one"), "a").join(every.toDF("b", "two"), "b")
    tops = components(of.select(F.col("one").alias("a"), F.col("two").alias("b"))).toDF("root", "top")
    return every.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def full_sets(texts: DataFrame) -> DataFrame:
    """``(node, shingles)``: the hashes of each text's set, ascending."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "text")):
            yield pa.RecordBatch.from_arrays([b.column("node"), parts(*set_of(Words(b.column("text"), lower=True)))], names=["node", "shingles"])

    return texts.mapInArrow(made, "node long, shingles array<long>")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``.

    Documents are linked from a similarity of ``similarity`` per cent on (80 at least, for
    the stated chances to hold).  ``component_id`` is the least id that the row reaches
    over links, its own included; ``kept`` marks the rows whose id that is.  Words are
    lower-cased in A-Z; a text of fewer than five words has its whole sequence as its only
    shingle.  A null, empty or blank text has an empty set and is linked with nothing.
    Rows with a null id take part, but give no component its name: where all ids are null,
    ``component_id`` is null and ``kept`` true.  Repeated rows come out alike.  Other
    columns are not read.
    """
    return _judged(docs, similarity, id_col, text_col).drop("row")


def _judged(docs: DataFrame, similarity: int, id_col: str, text_col: str) -> DataFrame:
    made = keep(sketches(docs, id_col, text_col))
    grouped = made.where("name is not null").groupBy("name")
    classes = grouped.agg(F.min("doc_id").alias("least_id"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()))

    lists = keep(prefixes(classes))
    entries = lists.select("node", "n", "keys", F.explode("keys").alias("v"))
    sizes = keep(entries.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"))
    longest = sizes.where(F.col("c") > SHORT).select("v")
    long = keep(_gathered(keep(entries.join(small(keep(longest)), "v"))))
    pairs = _short_pairs(entries, sizes, similarity).union(_pivot_pairs(long, similarity)).distinct()
    pairs = keep(_estimated(keep(pairs), classes))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(long.select("node")).distinct()
    texts = keep(texts_of(docs, keep(classes.select("row", "node").join(nodes, "node", "left_semi")), id_col, text_col))
    links = keep(_confirmed(pairs, texts, similarity))
    roots = keep(components(links))
    mixed = keep(_mixed(long, roots))
    if not mixed.isEmpty():
        sets = keep(full_sets(texts.join(mixed.select("node").distinct(), "node", "left_semi")))
        more = keep(_confirmed(keep(_in_blocks(mixed, sets, similarity).distinct()), texts, similarity))
        roots = roots if more.isEmpty() else keep(_joined(roots, more))

    named = classes.select("node", "least_id").join(roots, "node")
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = roots.join(names, "root").select("node", "component_id")
    of_class = classes.select("node", "name", "least_id").join(linked, "node", "left").select("name", F.coalesce("component_id", "least_id").alias("component_id"))
    found = made.where("name is not null").select("doc_id", "n", "name", "row").join(of_class, "name").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "row")
    empty = made.where("name is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "row")
    return found.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the least id; of rows with that id, the one with the least hash of its text.

    Rows without words are in no group and stay.  Of rows equal in id and text that have
    words, one stays, whichever it is.  All columns come through, whatever their names.
    """
    found = keep(_judged(docs, similarity, id_col, text_col).where("n_shingles > 0"))
    first = found.groupBy("component_id").agg(F.min(F.when(F.col("kept"), F.col("row"))).alias("first"))
    rows = found.groupBy("row", "component_id").agg(F.count("*").alias("c"))
    # all rows without any non-null id in their group are named by null
    judged = rows.join(first, rows["component_id"].eqNullSafe(first["component_id"]))
    row = fresh(docs, "__row")
    gone = keep(judged.where("row <> first").select(F.col("row").alias(row)))
    twice = keep(judged.where("row = first and c > 1").select(F.col("row").alias(row)))
    keyed = docs.withColumn(row, identity(F.col(id_col), F.col(text_col)))
    left = keyed.join(small(keep(gone.union(twice))), row, "left_anti")
    if not twice.isEmpty():
        left = left.unionByName(keyed.join(small(twice), row, "left_semi").dropDuplicates([row]))
    return left.drop(row)
