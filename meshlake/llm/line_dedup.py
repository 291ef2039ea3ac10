"""Line dedup: lines that equal, or nearly equal, an earlier line go.

A segment-partition edit join.  If two lines differ by at most ``threshold`` edits and one
is cut into ``threshold + 1`` segments, one segment stands unchanged in the other, near
the same place.  So each line indexes its segments by (length, number, segment), and
probes the indexes of all lengths it could match with those of its substrings whose place
allows it.  Both sides are rows that meet in one Spark join on a hash of the three.
Candidates are verified by a banded bit-parallel edit distance.

A segment that more than SHORT lines have would give too many pairs.  Its lines are laid
in blocks instead, each pair of blocks is compared in a task, and the task gives only the
lines that are near an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST, bucketed, fresh, keep, quoted, small
from ._words import mix64, signed, slices

#: Most edits (of code points) between near-equal lines.
THRESHOLD = 2
#: Code points of the shorter line for each edit: edits of at most a tenth of it.  Lines of fewer are compared for equality.
PER_EDIT = 10

#: Most lines with one segment whose pairs are written out, and lines of a block for segments that more have.
SHORT, BLOCK = 16, 256

_SPACE = " \t\n\x0b\x0c\r"

#: Code points of all pairs that are compared at once, but for one pair that has more; pairs of lines of LONG lose their common ends first.
CELLS, LONG = 1 << 20, 512


def edits(length: np.ndarray, threshold: int, per_edit: int) -> np.ndarray:
    """Edits that lines of ``length`` code points may be apart, if none of the two is shorter."""
    return np.minimum(threshold, length // per_edit)


def has_word(line: F.Column) -> F.Column:
    return F.ltrim(line, F.lit(_SPACE)) != ""


def segments(length: np.ndarray, number: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment ``number`` of ``parts``; the last ones are longer by one where it does not come out even."""
    short = length // parts
    longer = length - short * parts
    start = number * short + np.maximum(0, number - (parts - longer))
    return start, short + (number >= parts - longer)


def substring_starts(own: int, other: int, number: int, threshold: int) -> tuple[int, int]:
    """Shifts, from the segment's place in a line ``own - other`` = delta shorter, at which it can stand in the longer one.

    Of all alignments with at most ``threshold`` edits, one has this segment as the first
    unchanged one: at most ``number`` edits are before it (from the left) and at most
    ``threshold - number`` behind it (from the right).
    """
    delta = own - other
    left = max(-number, delta - (threshold - number))
    right = min(number, delta + (threshold - number))
    return left, right


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, offsets)`` of a string column."""
    texts = column.fill_null("").to_pylist()
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(size)])


class Substrings:
    """Hashes of any substrings of some text, from one prefix sum.

    They only bring lines together that are then compared, so a hash that two substrings
    share costs time and nothing else.
    """

    #: Values of the characters of the basic plane; others are mixed as they come.
    TABLE = mix64(np.arange(1, 1 << 16, dtype=np.uint64))
    #: An odd base, so that it can be divided out, and the powers that are kept for all calls.
    BASE, SIZE = 0x9E3779B97F4A7C15, 1 << 17
    _kept: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """At least ``n`` powers of the base and of its inverse; only SIZE of them outlive the call."""

        def made(size: int) -> tuple[np.ndarray, np.ndarray]:
            first = [np.full(size, x, np.uint64) for x in (cls.BASE, pow(cls.BASE, -1, 2**64))]
            for x in first:
                x[0] = 1
            return tuple(np.cumprod(x) for x in first)

        if n > cls.SIZE:
            return made(n)
        if cls._kept is None:
            cls._kept = made(cls.SIZE)
        return cls._kept

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        powers, self.inverse = self.powers(n + 1)
        value = self.TABLE[np.minimum(codes, len(self.TABLE) - 1)]
        rare = codes >= len(self.TABLE)
        if rare.any():
            value[rare] = mix64(codes[rare].astype(np.uint64) + np.uint64(1))
        self.run = np.zeros(n + 1, np.uint64)
        np.cumsum(np.multiply(value, powers[:n], out=value), out=self.run[1:])

    def __call__(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix64((self.run[start + size] - self.run[start]) * self.inverse[start])


def join_keys(column: pa.Array, threshold: int, per_edit: int, role: str) -> tuple[np.ndarray, np.ndarray]:
    """``(line, key)`` of each line's own segments (role "index") or of its substrings (role "probe").

    The shorter of two lines is the one that is cut, and says how many edits there may be.
    """
    codes, offsets = code_points(column)
    found, a = [], 0
    while a < len(column):  # as many lines at once as the kept powers serve
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + Substrings.SIZE)) - 1)
        line, key = _keys_of(codes[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], threshold, per_edit, role)
        found.append((line + a, key))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _keys_of(codes: np.ndarray, offsets: np.ndarray, threshold: int, per_edit: int, role: str) -> tuple[np.ndarray, np.ndarray]:
    hashed, length = Substrings(codes), np.diff(offsets)
    line, keys = [], []

    def add(where: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray, number: int) -> None:
        line.append(where)
        keys.append(mix64(hashed(start, size) + mix64(other.astype(np.uint64) * np.uint64(threshold + 1) + np.uint64(number))))

    for k in range(1, threshold + 1):  # lines that allow k edits are cut into k + 1 segments
        for delta in range(1 if role == "index" else k + 1):
            other = length - delta
            every = np.flatnonzero((other > 0) & (edits(other, threshold, per_edit) == k))
            other, first = other[every], offsets[:-1][every]
            for number in range(k + 1):
                start, size = segments(other, number, k + 1)
                left, right = (0, 0) if role == "index" else substring_starts(delta, 0, number, k)
                for shift in range(left, right + 1):
                    ok = (start + shift >= 0) & (start + shift + size <= length[every])
                    add(every[ok], (first + start + shift)[ok], size[ok], other[ok], number)
    return (np.concatenate(line), np.concatenate(keys)) if line else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def without_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without the longest beginning and then the longest end that they share, which no distance needs."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])[:1]
    head = int(other[0]) if len(other) else n
    a, b, n = a[head:], b[head:], n - head
    other = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])[-1:]
    tail = n - 1 - int(other[0]) if len(other) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def banded_distance(left: list[np.ndarray], right: list[np.ndarray], threshold: int) -> np.ndarray:
    """Edit distances of pairs of code arrays, or ``threshold + 1`` where they are greater.

    Pairs of like lengths are compared together, CELLS code points at once.
    """
    n_pairs = len(left)
    out = np.full(n_pairs, threshold + 1, np.int64)
    m, n = (np.fromiter(map(len, x), np.int64, n_pairs) for x in (left, right))
    able = abs(m - n) <= threshold
    if (long := np.flatnonzero(able & (n > LONG))).size:
        left, right = list(left), list(right)
        for i in long:
            left[i], right[i] = without_ends(left[i], right[i])
            m[i], n[i] = len(left[i]), len(right[i])
    for i in np.flatnonzero(able & (m <= threshold)):
        out[i] = min(threshold + 1, _plain_distance(left[i], right[i]))
    close = np.flatnonzero(able & (m > threshold))
    close = close[np.argsort(n[close], kind="stable")]
    a = 0
    while a < len(close):
        rows = np.arange(1, len(close) - a + 1)
        b = a + max(1, int(np.searchsorted(rows * n[close[a:]], CELLS, side="right")))
        at = close[a:b]
        out[at] = _banded([left[i] for i in at], [right[i] for i in at], m[at], n[at], threshold)
        a = b
    return out


def _banded(left: list[np.ndarray], right: list[np.ndarray], m: np.ndarray, n: np.ndarray, threshold: int) -> np.ndarray:
    """Bit-parallel over a band of ``2 * threshold + 1`` diagonals, which is all that an
    alignment with that few edits can touch, for all pairs at once: one step a column.
    The band stands in the top bits of a word, so carries leave at the top.

    From a row on the band's last diagonal, ``2 * threshold`` steps up lead to any other
    one, so a pair whose count there is above ``3 * threshold`` is apart, and left out.
    """
    band = 2 * threshold + 1
    # row of pattern characters with `threshold` blanks before and after, so that every band position exists
    width = int(max(m.max(), n.max())) + 2 * threshold + 2
    pattern = np.full((len(left), width + threshold), 0xFFFFFFFF, np.uint32)
    text = np.full((len(left), int(n.max())), 0xFFFFFFFE, np.uint32)
    for row, (a, b) in enumerate(zip(left, right)):
        pattern[row, threshold : threshold + len(a)] = a
        text[row, : len(b)] = b
    one = np.uint64(1)
    low = 64 - band  # bit of the highest row of the band
    vp = np.full(len(left), ((1 << (threshold + 1)) - 1) << (63 - threshold), np.uint64)
    vn = np.zeros(len(left), np.uint64)
    dist = np.full(len(left), threshold, np.int64)
    result, rows = np.full(len(left), threshold + 1, np.int64), np.arange(len(left))
    for j in range(1, int(n.max()) + 1):
        pm = np.zeros(len(rows), np.uint64)
        for k in range(band):  # row j + k - threshold
            pm |= (pattern[:, j - 1 + k] == text[:, j - 1]).astype(np.uint64) << np.uint64(low + k)
        d0 = (((pm & vp) + vp) ^ vp) | pm | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        on_diagonal = j + threshold <= m
        dist += on_diagonal & ((d0 >> np.uint64(63)) == 0)
        bit = np.clip(63 - (j + threshold - m), 0, 63).astype(np.uint64)  # of the last row, once the band has passed it
        dist += ~on_diagonal * (((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64))
        vp = hn | ~((d0 >> one) | hp)
        vn = (d0 >> one) & hp
        done = n == j
        result[rows[done]] = dist[done]
        if j % 32 == 0:
            live = (n > j) & ~(on_diagonal & (dist > 3 * threshold))
            if not live.any():
                break
            if 2 * live.sum() <= len(rows):
                rows, m, n, vp, vn, dist, pattern, text = (x[live] for x in (rows, m, n, vp, vn, dist, pattern, text))
    return np.minimum(result, threshold + 1)


def _plain_distance(a: np.ndarray, b: np.ndarray) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def near_pairs(left: list[np.ndarray], right: list[np.ndarray], threshold: int, per_edit: int) -> np.ndarray:
    """True for each pair of lines that is no more edits apart than the shorter one allows."""
    shorter = np.fromiter((min(len(a), len(b)) for a, b in zip(left, right)), np.int64, len(left))
    return banded_distance(left, right, threshold) <= edits(shorter, threshold, per_edit)


def later_ones(order: np.ndarray, side: np.ndarray, codes: list[np.ndarray], threshold: int, per_edit: int) -> np.ndarray:
    """True for each line as near as ``near_pairs`` asks to one that is earlier by ``order``; with two sides, of the other side.

    Lines so near have like lengths, and counts of characters that differ by two at most
    for each edit.  Of what is left, every line tries its earlier ones in turn until one is near.
    """
    n = np.fromiter(map(len, codes), np.int64, len(codes))
    counts = np.zeros((len(codes), 64), np.int32)
    np.add.at(counts, (np.repeat(np.arange(len(codes)), n), np.concatenate(codes) % 64), 1)
    two_sides = side.min() != side.max()
    tries = []
    for b in range(len(codes)):
        able = (order < order[b]) & (abs(n - n[b]) <= threshold)
        if two_sides:
            able &= side != side[b]
        a = np.flatnonzero(able)
        a = a[abs(counts[a] - counts[b]).sum(1) <= 2 * threshold]
        tries.append(a[np.argsort(order[a])])
    near = np.zeros(len(codes), bool)
    turn, step, live = 0, 1, [b for b, a in enumerate(tries) if len(a)]
    while live:
        pairs = [(a, b) for b in live for a in tries[b][turn : turn + step]]
        pairs.sort(key=lambda p: n[p[1]])  # of like lengths, for little padding
        for c in range(0, len(pairs), 1024):
            part = pairs[c : c + 1024]
            found = near_pairs([codes[a] for a, _ in part], [codes[b] for _, b in part], threshold, per_edit)
            near[[b for (_, b), x in zip(part, found) if x]] = True
        turn, step = turn + step, 4 * step
        live = [b for b in live if not near[b] and len(tries[b]) > turn]
    return near


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every line with a word: its place and its text."""
    rows = [x.alias(n) for n, x in zip(("row", "row2"), _row(id_col, text_col))]
    return docs.select(F.col(id_col).alias("doc"), *rows, F.posexplode(F.split(text_col, "\n", -1)).alias("no", "line")).where(has_word(F.col("line")))


def _row(id_col: str, text_col: str) -> list[F.Column]:
    """128 bits for a row's id and text."""
    return [F.xxhash64(id_col, text_col), F.xxhash64(F.lit(1), id_col, text_col)]


def _line_id() -> F.Column:
    return F.xxhash64("line").alias("id")


def _line_ids() -> list[F.Column]:
    """128 bits for a line; the first half alone serves to bring lines together."""
    return [_line_id(), F.xxhash64(F.lit(1), "line").alias("id2")]


def _keys(lines: DataFrame, role: str, threshold: int, per_edit: int) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "line", 4 << 20)):
            ids = b.column("id").to_numpy()
            _, first = np.unique(ids, return_index=True)  # copies in a batch meet here
            line, key = join_keys(b.column("line").take(pa.array(first)), threshold, per_edit, role)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(ids[first][line])], names=["key", "id"])

    long_lines = lines.where(F.char_length("line") >= per_edit).select(_line_id(), "line")
    return long_lines.mapInArrow(made, "key long, id long")


def _near_pairs(pairs: DataFrame, texts: DataFrame, threshold: int, per_edit: int) -> DataFrame:
    """``(a, a2, b, b2)``: the pairs of lines that are near."""
    both = pairs.join(texts.toDF("a", "a2", "left"), "a").join(texts.toDF("b", "b2", "right"), "b")
    names = ("a", "a2", "b", "b2")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "left", 1 << 20)):
            sides = []
            for name in ("left", "right"):
                codes, offsets = code_points(b.column(name))
                sides.append([codes[s:e] for s, e in zip(offsets, offsets[1:])])
            near = near_pairs(*sides, threshold, per_edit)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(near)) for c in names], names=list(names))

    return both.mapInArrow(verified, "a long, a2 long, b long, b2 long")


def _near_in_blocks(members: DataFrame, texts: DataFrame, firsts: DataFrame, threshold: int, per_edit: int) -> DataFrame:
    """``id`` and ``id2`` of the lines near an earlier one that has the same key, by pairs of blocks of each key's lines."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(small(keep(sizes)), "key").withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    other = dealt.select("key", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = other.select("key", "id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    place = [F.col(f"first.{c}").alias(c) for c in ("doc", "row", "row2", "no")]
    lines = keep(texts.join(firsts.select("id", "id2", *place), ["id", "id2"]))

    def compared(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rank = pc.sort_indices(group, sort_keys=[(c, "ascending") for c in ("doc", "row", "row2", "no")], null_placement="at_start").to_numpy()
        order = np.empty(len(rank), np.int64)
        order[rank] = np.arange(len(rank))
        codes, offsets = code_points(group["line"].chunk(0))
        near = later_ones(order, group["side"].to_numpy(), [codes[s:e] for s, e in zip(offsets, offsets[1:])], threshold, per_edit)
        return group.select(["id", "id2"]).filter(pa.array(near))

    return pairs.join(lines, "id").groupBy("key", "i", "j").applyInArrow(compared, "id long, id2 long")


def near_lines(lines: DataFrame, firsts: DataFrame, threshold: int = THRESHOLD, per_edit: int = PER_EDIT) -> DataFrame:
    """``id`` and ``id2`` of the lines near a different line whose first place is earlier.

    ``lines`` has a string column ``line``, ``firsts`` the first place of each line.
    """
    index = keep(_keys(lines, "index", threshold, per_edit))
    counts = index.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("low"), F.max("id").alias("high"))
    long = keep(counts.where((F.col("c") > SHORT) & (F.col("low") < F.col("high"))).select("key"))
    short = index.join(small(long), "key", "left_anti").dropDuplicates(["key", "id"])
    # a probe of a long key meets one row, which only says so
    probed = short.select("key", F.col("id").alias("a")).union(long.select("key", F.lit(None).cast("long").alias("a")))
    met = _keys(lines, "probe", threshold, per_edit).withColumnRenamed("id", "b").join(probed, "key")
    met = keep(met.where("a is null or a <> b").select(F.when(F.col("a").isNull(), F.col("key")).alias("key"), F.least("a", "b").alias("a"), F.when(F.col("a").isNull(), F.col("b")).otherwise(F.greatest("a", "b")).alias("b")).distinct())
    pairs = met.where("key is null").select("a", "b")
    members = keep(met.where("key is not null").select("key", F.col("b").alias("id")).union(index.join(small(long), "key", "left_semi").select("key", "id")).distinct())

    wanted = keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(members.select("id")).distinct())
    texts = keep(lines.select(*_line_ids(), "line").join(small(wanted), "id", "left_semi").groupBy("id", "id2").agg(F.min("line").alias("line")))
    near = _near_pairs(pairs, texts, threshold, per_edit)
    side = lambda x: firsts.select(F.col("id").alias(x), F.col("id2").alias(f"{x}2"), F.col("first").alias(f"f{x}"))
    ends = near.join(side("a"), ["a", "a2"]).join(side("b"), ["b", "b2"])
    of = lambda suffix: F.when(F.col("fa") < F.col("fb"), F.col(f"b{suffix}")).otherwise(F.col(f"a{suffix}"))
    later = ends.select(of("").alias("id"), of("2").alias("id2"))
    return later.union(_near_in_blocks(members, texts, firsts, threshold, per_edit)).distinct()


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, per_edit: int = PER_EDIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that are left in ``text_col``, and ``n_lines`` and ``n_removed`` of lines that have a word.

    A line goes if an equal line, or one within ``threshold`` edits and no more than one
    for each ``per_edit`` code points of the shorter line, stands earlier: in a document of
    smaller id (null first), or further up in the same one.  Lines are judged as they came
    in, not by what is left.
    Lines without a word stay and are not counted.  Rows equal in id and text are at one
    place, so their lines stay or go together; of rows with one id, the order is by a hash
    of the text.  Null texts stay null and empty ones empty, with no lines.  No row goes.
    Columns of the input named ``n_lines`` or ``n_removed`` are replaced, all others come
    through, whatever their names.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    lines = _lines(docs, id_col, text_col)
    place = F.struct("doc", "row", "row2", "no")
    firsts = keep(lines.select(*_line_ids(), place.alias("at")).groupBy("id", "id2").agg(F.min("at").alias("first"), F.max("at").alias("last")))
    killed = near_lines(lines, firsts, threshold, per_edit).withColumn("killed", F.lit(True))
    # lines with anything to remove: killed ones wholly, others but for their first place
    gone = firsts.join(killed, ["id", "id2"], "left").where("killed or first < last")
    gone = keep(gone.select("id", "id2", "first", F.coalesce("killed", F.lit(False)).alias("killed")))
    removed = lines.select(*_line_ids(), "doc", "row", "row2", "no").join(small(gone), ["id", "id2"]).where(F.col("killed") | (place > F.col("first")))
    row, row2, nos = (fresh(docs, c) for c in ("__row", "__row2", "__nos"))
    by_row = keep(removed.groupBy(F.col("row").alias(row), F.col("row2").alias(row2)).agg(F.collect_set("no").alias(nos)))

    parts = F.split(F.col(text_col), "\n", -1)
    n_lines = F.size(F.filter(parts, lambda x: has_word(x)))
    # the places that stay come from a hash set, the lines from an array that is bound once: in proportion to the lines
    stay = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(nos))
    left = F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay(p), lambda k: F.element_at(p, k + 1)), "\n"))[0]
    rows = docs.select(*quoted(names), *[x.alias(c) for c, x in zip((row, row2), _row(id_col, text_col))])
    # texts stay where they are: the other side is broadcast if its size allows it, else the texts are bucketed
    n, n_bytes = by_row.agg(F.sum(F.size(nos))).first()[0] or 0, None
    if n > 4 * BROADCAST:
        n_bytes = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    joined = rows.join(F.broadcast(by_row), [row, row2], "left") if n_bytes is None else bucketed(rows, row, n_bytes).join(by_row, [row, row2], "left")
    out = [F.when(F.col(nos).isNull(), F.col(text_col)).otherwise(left).alias(c) if c == text_col else x for c, x in zip(names, quoted(names))]
    return joined.select(
        *out,
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col(nos).isNull(), 0).otherwise(F.size(nos)).cast("long").alias("n_removed"),
    )
