"""Quality rules: how far a document's histograms lie from those of its language.

Two histograms are compared with language references by Jensen-Shannon distance:
character classes, and the common words of the language.  The references are counted
over all documents by their language column; a document is judged by its text, against
the reference that suits it best.  Documents too short for a stable histogram are not
judged by it, nor are those of a language with too few words for a reference of its own:
the references of other languages say nothing about them.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import keep
from ._words import Words, coded, signed, slices

#: A word is common if it makes up this share of its language's words; so a language has at most 1 / COMMON such words.
COMMON = 0.002
#: A language has a reference if it has this number of words, however many the others have.
LANGUAGE_WORDS = 1000
#: References that travel with a task at once, on average; more are compared in as many passes, by blocks of languages.
BLOCK_LANGUAGES = 1024
#: Greatest distances of a document that stays, by character classes and by common words.
CLASS_DISTANCE, WORD_DISTANCE = 0.25, 0.4
#: Characters and words from which a histogram is judged.
MIN_CHARS, MIN_WORDS = 200, 100
#: Base rules: fewest words; greatest share of words in repeated 3-word windows, per cent.
BASE_WORDS, BASE_REPEATS = 50, 50

#: Classes of ASCII bytes: lower, upper, digit, white space, sentence mark, symbol, other; 255: none.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 3
_CLASS[[ord(c) for c in ".,;:?!'\"()-"]] = 4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CLASS[_SYMBOL] = 5
_CLASS[128:192] = 255
#: Of other characters: letters by runs of 128 code points, which tells scripts apart, up to LAST_RUN; ideographs and syllables
#: beyond in one class; then marks, numbers, punctuation, symbols, and the rest.
LAST_RUN = 0x2E80 >> 7
_KINDS = {"L": 7 + LAST_RUN, "M": 8 + LAST_RUN, "N": 9 + LAST_RUN, "P": 10 + LAST_RUN, "S": 11 + LAST_RUN}
N_CLASSES = 13 + LAST_RUN


@functools.cache
def _classes_of_characters() -> np.ndarray:
    """The class of every code point of the basic plane, by Unicode's categories."""
    kinds = np.array([_KINDS.get(unicodedata.category(chr(c))[0], N_CLASSES - 1) for c in range(1 << 16)], np.int16)
    code = np.arange(1 << 16)
    return np.where((kinds == _KINDS["L"]) & (code >> 7 < LAST_RUN), 7 + (code >> 7), kinds).astype(np.int16)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class References:
    """For each language, shares of character classes, and the common words' hashes (ascending) with their shares."""

    names: list[str]
    classes: np.ndarray  # languages x N_CLASSES
    words: list[np.ndarray]
    shares: list[np.ndarray]  # one more entry than words, for all others


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    run = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return run[bounds[1:]] - run[bounds[:-1]]


def class_counts(words: Words) -> np.ndarray:
    """How many characters of each class a text has; each is counted at its first byte."""
    data, n_docs = words.data, len(words.offsets) - 1
    kind = _CLASS[data].astype(np.int16)
    lead = np.flatnonzero(data >= 192)
    if len(lead):
        byte = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) for k in range(3)]
        two = (byte[0] & 31) << 6 | byte[1] & 63
        three = (byte[0] & 15) << 12 | (byte[1] & 63) << 6 | byte[2] & 63
        # beyond the basic plane: letters of rare scripts and ideographs, or signs; all in one class
        kind[lead] = np.where(byte[0] < 240, _classes_of_characters()[np.where(byte[0] < 224, two, three) & 0xFFFF], N_CLASSES - 1)
    some = np.flatnonzero(kind != 255)
    doc = np.searchsorted(words.offsets, some, side="right") - 1
    return np.bincount(doc * N_CLASSES + kind[some], minlength=n_docs * N_CLASSES).reshape(n_docs, N_CLASSES)


def measures(words: Words) -> dict[str, np.ndarray]:
    """The base counts of each text; lines and words are compared by their bytes."""
    data, offsets = words.data, words.offsets
    n_docs = len(offsets) - 1
    kind = _CLASS[data]
    chars = sums((kind != 3) & (kind != 255), offsets)
    symbols = sums(_SYMBOL[data], offsets)
    # lines: every text has one more than it has line feeds
    feeds = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    stop = np.sort(np.concatenate([feeds, offsets[1:]]), kind="stable")
    has_word = np.searchsorted(words.start, stop) > np.searchsorted(words.start, start)
    start, stop = start[has_word], stop[has_word]
    doc = np.searchsorted(offsets, start, side="right") - 1
    line = coded(data, start, stop)[0].astype(np.int64) * n_docs + doc
    _, first = np.unique(line, return_index=True)
    again = np.ones(len(line), bool)
    again[first] = False
    dup_lines = np.bincount(doc[again], minlength=n_docs)
    # words in 3-word windows that stand twice or more in their text
    of = words.text_of()
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= 3:
        at = np.flatnonzero(of[2:] == of[:-2])
        code = coded(data, words.start, words.end)[0].astype(np.int64)
        d = int(code.max()) + 1
        key, room = code[at], d
        for more, size in ((code[at + 1], d), (code[at + 2], d), (of[at], n_docs)):
            if room * size >= 1 << 63:  # smaller numbers for the same
                key = np.unique(key, return_inverse=True)[1]
                room = len(at) + 1
            key, room = key * size + more, room * size
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[inverse] > 1]
        covered[twice] += 1
        np.subtract.at(covered, twice + 3, 1)
    repeats = sums(np.cumsum(covered)[:-1] > 0, words.first)
    return dict(zip(COUNTS, (words.count, chars, symbols, dup_lines, repeats)))


def base_failures(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < BASE_WORDS) | (100 * found["n_repeat_words"] > BASE_REPEATS * found["n_words"])


@dataclass
class Counted:
    """Counts of classes and words by language, the words of each language with a reference, and the blocks these make."""

    counts: DataFrame
    totals: DataFrame
    n_blocks: int

    def block(self, k: int) -> References:
        """The references of one block of languages; only these come to the driver."""
        totals = self.totals.where(F.pmod(F.xxhash64("lang"), F.lit(self.n_blocks)) == k)
        large = [(r["lang"], r["total"]) for r in totals.orderBy("lang").collect()]
        common = self.counts.join(F.broadcast(totals), "lang").where((F.col("kind") == 1) | (F.col("n") >= COMMON * F.col("total"))).toPandas()
        of = dict(list(common.groupby("lang")))
        classes, words, shares = [], [], []
        for lang, total in large:
            own = of[lang]
            c = np.zeros(N_CLASSES)
            part = own[own["kind"] == 1]
            c[part["key"].to_numpy(int)] = part["n"].to_numpy(float)
            w = own[own["kind"] == 0]
            key, n = np.ascontiguousarray(w["key"].to_numpy(np.int64)).view(np.uint64), w["n"].to_numpy(float)
            order = np.argsort(key)
            classes.append(c / max(1, c.sum()))
            words.append(key[order])
            shares.append(np.append(n[order], total - n.sum()) / total)
        return References([lang for lang, _ in large], np.array(classes).reshape(-1, N_CLASSES), words, shares)


def language(lang_col: str) -> Column:
    """The language as it is counted: null is one of its own."""
    return F.coalesce(F.col(lang_col).cast("string"), F.lit(""))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Counted:
    """Count the references over all documents that pass the base rules, of every language with LANGUAGE_WORDS words in them.

    Null languages count as one of their own, null texts as empty.  Only words above the
    stated share come to the driver, by blocks of languages, which bounds their number.
    """
    rows = docs.select(language(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "text")):
            plain = Words(b.column("text"))
            passed = ~base_failures(measures(plain))
            words = Words(b.column("text"), lower=True)
            codes = b.column("lang").dictionary_encode()
            lang = np.where(passed, np.asarray(codes.indices), -1)
            names = codes.dictionary.to_pylist()
            hashes, of, classes = words.hashes(), lang[words.text_of()], class_counts(plain)
            for i, name in enumerate(names):
                key, n = np.unique(hashes[of == i], return_counts=True)
                total = classes[lang == i].sum(0)
                key = np.concatenate([signed(key), np.arange(N_CLASSES)])
                kind = np.repeat([0, 1], [len(n), N_CLASSES])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(key)), pa.array(kind, pa.int32()), pa.array(key), pa.array(np.concatenate([n, total]))], names=["lang", "kind", "key", "n"])

    counts = rows.mapInArrow(counted, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    counts = keep(counts)
    totals = keep(counts.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= LANGUAGE_WORDS))
    return Counted(counts, totals, max(1, -(-totals.count() // BLOCK_LANGUAGES)))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of ``p`` from ``q``."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def distances(words: Words, folded: np.ndarray, refs: References) -> tuple[np.ndarray, np.ndarray]:
    """Distances of each text (rows) from each reference (columns), by classes and by common words; ``folded``: hashes of the words in lower case."""
    of, n_docs = words.text_of(), len(words.count)
    classes = class_counts(words).astype(float)
    classes /= np.maximum(1, classes.sum(1, keepdims=True))
    by_class, by_word = np.zeros((n_docs, len(refs.words))), np.zeros((n_docs, len(refs.words)))
    for k, (known, share) in enumerate(zip(refs.words, refs.shares)):
        by_class[:, k] = js_distance(classes, refs.classes[k])
        at = np.minimum(np.searchsorted(known, folded), max(0, len(known) - 1))
        at = np.where(known[at] == folded, at, len(known)) if len(known) else np.zeros(len(folded), int)
        hist = np.bincount(of * len(share) + at, minlength=n_docs * len(share)).reshape(n_docs, len(share))
        by_word[:, k] = js_distance(hist / np.maximum(1, hist.sum(1, keepdims=True)), share)
    return by_class, by_word


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def judge(docs: DataFrame, counted: Counted, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, ``base_failed``, the distances from the best reference, and ``kept``, one row per document.

    Null and empty texts have no words, so they fail the base rules.  The distances are 0
    where the document's language has no reference.  A block of references travels with
    the task; with several blocks each is a pass of its own, and the best of each
    document's narrow rows stays.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), language(lang_col).alias("lang"))
    if counted.n_blocks == 1:
        return _judged(rows, counted.block(0)).drop("known", "key")
    rows = keep(rows.withColumn("key", F.monotonically_increasing_id()))
    found = reduce(DataFrame.union, [keep(_judged(rows, counted.block(k)).withColumn("block", F.lit(k))) for k in range(counted.n_blocks)])
    names = [c for c in found.columns if c not in ("key", "known", "block", "kept", "class_distance", "word_distance")]
    off = F.greatest(F.col("class_distance") / CLASS_DISTANCE, F.col("word_distance") / WORD_DISTANCE)
    best = F.min(F.struct(off.alias("off"), "block", "class_distance", "word_distance")).alias("best")
    found = found.groupBy("key").agg(*[F.first(c).alias(c) for c in names], F.max("known").alias("known"), best)
    far = {c: F.when(F.col("known"), F.col(f"best.{c}")).otherwise(0.0) for c in ("class_distance", "word_distance")}
    kept = ~F.col("base_failed") & (far["class_distance"] <= CLASS_DISTANCE) & (far["word_distance"] <= WORD_DISTANCE)
    return found.select(*names, kept.alias("kept"), *[x.alias(c) for c, x in far.items()])


def _judged(rows: DataFrame, refs: References) -> DataFrame:
    """Each document against one block of references; ``known``: its language is one of them.  A ``key`` stays as it is, with
    distances from the best reference of the block for all documents; without one, documents of other languages have 0."""
    alone = "key" not in rows.columns
    names = pa.array(refs.names, pa.string())

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "text")):
            words = Words(b.column("text"))
            found = measures(words)
            n, failed = found["n_words"], base_failures(found)
            known = pc.is_in(b.column("lang").cast(pa.string()), names).to_numpy(zero_copy_only=False)
            by_class, by_word = distances(words, Words(b.column("text"), lower=True).hashes(), refs)
            if by_class.shape[1]:
                by_class[found["word_chars"] < MIN_CHARS] = 0
                by_word[n < MIN_WORDS] = 0
                best = np.argmin(np.maximum(by_class / CLASS_DISTANCE, by_word / WORD_DISTANCE), 1)
                by_class, by_word = (x[np.arange(len(n)), best] for x in (by_class, by_word))
            else:  # no language of the block: nothing to compare with
                by_class = by_word = np.full(len(n), 0.0 if alone else np.inf)
            if alone:
                by_class, by_word = np.where(known, by_class, 0), np.where(known, by_word, 0)
            kept = ~failed & (by_class <= CLASS_DISTANCE) & (by_word <= WORD_DISTANCE)
            key = pa.nulls(len(n), pa.int64()) if alone else b.column("key")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(kept), pa.array(by_class), pa.array(by_word), pa.array(known), key],
                names=["doc_id", *COUNTS, "base_failed", "kept", "class_distance", "word_distance", "known", "key"],
            )

    return rows.mapInArrow(judged, _OUT + ", known boolean, key long")
