"""Source divergence audit: how the sources of a language differ in the terms they use.

Every (language, source) group and every language gives each kept term a smoothed share in
whole numbers.  Two things are reported of a group: its divergence from each other source
of the language, summed over all kept terms, and the terms that set it apart most from the
language.

The table of counts, one row for each term of a group, is made by one pass over the texts.
Within a group a term's share follows from its count alone, so the group's terms fall into
buckets by count:

* The k terms of most divergence are sought by upper bounds.  In a bucket the divergence is
  greatest where the language's share is least and smallest where that is most, so each
  bucket has a bound from above, and tells how many terms reach a bound from below.  The
  buckets whose bound is not strictly below what k terms reach are evaluated, no others.
* The divergence of two groups is that of two groups without any term, and what each
  group's terms change in it if the other has none of them, which its buckets tell, and
  what the terms in both change beyond that, which the terms' postings tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, keep, small
from ._words import Words, coded, positions, slices

#: A term is kept if so many documents of the language have it, and so many of a group's terms are reported.
MIN_DOCS, MOST = 10, 10
#: Pairs of postings that are worked on at once.
PAIRS = 1 << 20
#: A term is of ASCII letters and of characters beyond ASCII.
_GAP = np.ones(256, bool)
_GAP[0x80:] = False
_GAP[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def counted(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (uses) and ``n_docs``: one row for each term of a group, and one with a null term for each group."""
    bounded_batches(docs.sparkSession)
    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(x) for c, x in ((lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(*named, F.col(f"`{text_col}`").alias("text"))
    schema = "lang string, source string, term string, n long, n_docs long"

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "text", 8 << 20)):
            lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
            n_sources = max(1, len(source.dictionary))
            groups, group = np.unique(lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy(), return_inverse=True)
            words = Words(b.column("text"), lower=True, gap=_GAP)
            codes, distinct = coded(words.data, words.start, words.end)
            n_terms = max(1, len(distinct))
            found, uses = np.unique(words.text_of() * n_terms + codes, return_counts=True)  # terms of a text
            terms, at = np.unique(group[found // n_terms] * n_terms + found % n_terms, return_inverse=True)  # terms of a group
            n = np.zeros(len(terms), np.int64)
            np.add.at(n, at, uses)
            n_docs = np.bincount(at, minlength=len(terms))
            of = np.concatenate([groups[terms // n_terms], groups])
            text = distinct.take(pa.array(terms % n_terms)).cast(pa.large_string()).cast(pa.string())
            nothing = np.zeros(len(groups), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(of // n_sources)), source.dictionary.take(pa.array(of % n_sources)),
                    pa.concat_arrays([text, pa.nulls(len(groups), pa.string())]), pa.array(np.concatenate([n, nothing])), pa.array(np.concatenate([n_docs, nothing])),
                ],
                names=["lang", "source", "term", "n", "n_docs"],
            )

    return rows.mapInArrow(counts, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), exactly, as a long division by three digits at a time; all three are SQL."""
    whole = f"greatest(1L, {total} + 2 * {terms})"
    rest, out = f"({count} + 2)", f"({count} + 2) div {whole}"
    for _ in range(3):
        rest = f"(({rest}) % {whole} * 1000)"
        out = f"({out}) * 1000 + {rest} div {whole}"
    return F.expr(f"1L + {out}")


def divergence(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)) as SQL."""
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, most: int = MOST) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of every (language, source) group.

    A language keeps the terms that ``min_docs`` of its documents have.  Part ``pair``: every
    other source of the language by divergence.  Part ``term``: the ``most`` terms of the
    group with the greatest divergence among those that it uses more than the language does.
    Equal values rank by item, in the order of UTF-8 bytes.

    Null texts, languages and sources count as empty ones; a repeated row counts each time.
    A group without kept terms has pairs, all at 0 if its language keeps none.  Without rows
    the result is empty.  Other columns are not read.  No row of texts moves; a task holds
    the postings of some thousand terms, at most one for each source of a language.
    """
    term = Window.partitionBy("lang", "term")
    rows = counted(docs, text_col, lang_col, source_col).select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("all_n"), F.sum("n_docs").over(term).alias("all_docs"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("first"),
    )
    kept = keep(rows.where((F.col("all_docs") >= min_docs) | F.col("term").isNull()).drop("all_docs"))
    langs = kept.groupBy("lang").agg(F.count_if(F.col("first") & F.col("term").isNotNull()).alias("terms"), F.sum("n").alias("lang_n"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = keep(groups.join(langs, "lang").withColumn("none", share("0L", "group_n", "terms")))
    shares = kept.where("term is not null").join(small(groups), ["lang", "source"])
    shares = shares.withColumn("p", share("n", "group_n", "terms")).withColumn("q", share("all_n", "lang_n", "terms"))

    more = F.expr("p > q")
    buckets = shares.groupBy("lang", "source", "n").agg(
        F.count("*").alias("m"), F.max("p").alias("p"), F.max("none").alias("none"),
        F.count_if(more).alias("more"), F.min(F.when(more, F.col("q"))).alias("low"), F.max(F.when(more, F.col("q"))).alias("high"),
    )
    buckets = keep(buckets)
    found = _terms(shares, buckets, most).unionByName(_pairs(shares, buckets, groups))
    return found.select("lang", "source", "part", "item", "value", "rank")


def _terms(shares: DataFrame, buckets: DataFrame, most: int) -> DataFrame:
    """The terms of part ``term`` with their ranks: what the buckets promise says which of them to evaluate."""
    group = Window.partitionBy("lang", "source")
    bounds = buckets.where("more > 0").select("lang", "source", "n", "more", F.expr(divergence("p", "low")).alias("bound"), F.expr(divergence("p", "high")).alias("floor"))
    # one term reaches the bound, and all the others the floor
    reached = bounds.select("lang", "source", "n", "bound", F.explode(F.array(
        F.struct(F.col("bound").alias("value"), F.lit(1).cast("long").alias("terms")), F.struct(F.col("floor").alias("value"), (F.col("more") - 1).alias("terms")),
    )).alias("promise")).select("lang", "source", "promise.*")
    so_far = F.sum("terms").over(group.orderBy(F.desc("value")).rangeBetween(Window.unboundedPreceding, 0))
    kth = reached.select("lang", "source", "value", so_far.alias("so_far")).where(F.col("so_far") >= most)
    kth = kth.groupBy("lang", "source").agg(F.max("value").alias("kth"))
    chosen = bounds.join(kth, ["lang", "source"], "left").where("kth is null or bound >= kth").select("lang", "source", "n")
    evaluated = shares.where("p > q").join(small(keep(chosen)), ["lang", "source", "n"], "left_semi")
    evaluated = evaluated.select("lang", "source", F.col("term").alias("item"), F.expr(divergence("p", "q")).alias("value"))
    rank = F.row_number().over(group.orderBy(F.desc("value"), "item"))
    return evaluated.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("part", F.lit("term"))


def _pairs(shares: DataFrame, buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """Part ``pair``."""
    one, two = groups.alias("one"), groups.alias("two")
    # what a group's terms change if the other group has none of them
    other = small(groups.select("lang", F.col("source").alias("item"), F.col("none").alias("z")))
    changed = F.expr(f"m * ({divergence('p', 'z')} - {divergence('none', 'z')})")
    alone = buckets.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(changed).alias("alone"))
    alone = keep(alone)
    both = _both(shares)
    pairs = one.join(two, (F.col("one.lang") == F.col("two.lang")) & (F.col("one.source") != F.col("two.source"))).select(
        "one.lang", "one.source", F.col("two.source").alias("item"), F.least("one.source", "two.source").alias("a"), F.greatest("one.source", "two.source").alias("b"),
        F.expr(f"one.terms * ({divergence('one.none', 'two.none')})").alias("value"),
    )
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("back"))
    pairs = pairs.join(alone, ["lang", "source", "item"], "left").join(back, ["lang", "source", "item"], "left").join(both, ["lang", "a", "b"], "left")
    zero = F.lit(0).cast("long")
    value = F.col("value") + F.coalesce("alone", zero) + F.coalesce("back", zero) + F.coalesce("both", zero)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("lang", "source", "item", value.alias("value")).withColumn("rank", rank).withColumn("part", F.lit("pair"))


def _both(shares: DataFrame) -> DataFrame:
    """``lang``, ``a``, ``b`` and ``both``: what the terms that two sources have in common change beyond what each one's own do."""
    postings = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", F.col("none").alias("z"))).alias("posts"))
    postings = postings.where(F.size("posts") > 1).select("lang", "posts")
    schema = "lang string, a string, b string, both long"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang").dictionary_encode()
            lists = batch.column("posts")
            size = lists.value_lengths().to_numpy()
            source, p, z = lists.flatten().flatten()
            source, p, z = source.dictionary_encode(), p.to_numpy(), z.to_numpy()
            of = np.repeat(lang.indices.to_numpy().astype(np.int64), size)
            # the number of a source in the order of the names
            names = np.array(source.dictionary.to_pylist(), object)
            order = np.array(sorted(range(len(names)), key=lambda k: names[k].encode()), np.int64)
            place = np.empty(len(names), np.int64)
            place[order] = np.arange(len(names))
            number = place[source.indices.to_numpy()]
            left = np.repeat(size, size) - positions(size) - 1  # postings of the same term behind this one
            keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for step in range(1, int(size.max(initial=1))):
                at = np.flatnonzero(left >= step)
                for i in (at[k : k + PAIRS] for k in range(0, len(at), PAIRS)):
                    j = i + step
                    value = _f(p[i], p[j]) - _f(p[i], z[j]) - _f(z[i], p[j]) + _f(z[i], z[j])
                    key = (of[i] * len(names) + np.minimum(number[i], number[j])) * len(names) + np.maximum(number[i], number[j])
                    keys, inverse = np.unique(np.concatenate([keys, key]), return_inverse=True)
                    value = np.concatenate([sums, value])
                    sums = np.zeros(len(keys), np.int64)
                    np.add.at(sums, inverse, value)
            a, b = (pa.array(names[order[x]], pa.string()) for x in (keys // len(names) % len(names), keys % len(names))) if len(names) else (pa.array([], pa.string()),) * 2
            langs = lang.dictionary.take(pa.array(keys // max(1, len(names)) ** 2))
            yield pa.RecordBatch.from_arrays([langs, a, b, pa.array(sums)], names=["lang", "a", "b", "both"])

    return postings.mapInArrow(summed, schema).groupBy("lang", "a", "b").agg(F.sum("both").alias("both"))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)
