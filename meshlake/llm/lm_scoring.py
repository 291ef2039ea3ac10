"""LM scoring with a subword lattice.

The pieces come from an existing vocabulary, whose own scores are where their weights
start and what a fixed number of expectation-maximisation rounds over the training
documents goes by as a prior.  A word's probability is the sum over all its
segmentations, by a forward recursion in logarithms; a document's is the product over
its words and one end mark.

Words are the unit of work: a document's probability needs only its distinct words and
their counts.  Every distinct word of the corpus is counted and scored once, in a table
dealt by word.  Frequent words go back to the documents by a broadcast of bounded size,
the others by a join on the word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import keep
from ._words import Words, coded, mix64, slices

#: Words in the broadcast, the most frequent ones: 24 bytes each.
HEAD = 200_000
ROUNDS = 2
#: What the vocabulary's own scores weigh besides the expected counts, in tokens; so that no piece gets probability 0.
PRIOR = 3200.0
#: Characters from which on a word is long: it is learned from as so many stretches of that length, and scored in short ones, side by side.
STRETCH, SIDE = 1024, 128
MARK = "▁"


class Pieces:
    """A vocabulary with natural log probabilities: texts, 256 byte pieces for characters that are none, an end mark."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    CELLS = 1 << 19  # of a group's matrices

    def __init__(self, texts: list[str], byte_ids: list[int], end_id: int, logp: np.ndarray):
        self.texts, self.byte_ids, self.end_id, self.logp = texts, np.array(byte_ids), end_id, logp
        self._known: np.ndarray | None = None

    def __getstate__(self):
        return self.texts, self.byte_ids, self.end_id, self.logp

    def __setstate__(self, state):
        self.__init__(*state)

    def with_logp(self, logp: np.ndarray) -> "Pieces":
        return Pieces(self.texts, list(self.byte_ids), self.end_id, logp)

    def _prepare(self) -> None:
        """Once in a task: the hashes of all texts in order, and a table that most substrings fail at once."""
        if self._known is not None:
            return
        ids = np.array([i for i, t in enumerate(self.texts) if t])
        self.most = max((len(t) for t in self.texts), default=1)
        hashes = np.zeros(len(ids), np.uint64)
        for at, i in enumerate(ids):
            h = np.zeros(1, np.uint64)
            for c in self.texts[i]:
                h = h * self.BASE + mix64(np.array([ord(c) + 1], np.uint64))
            hashes[at] = mix64(h)[0]
        order = np.argsort(hashes)
        self._known, self._ids = hashes[order], ids[order].astype(np.int32)
        self._maybe = np.zeros(1 << 20, bool)
        self._maybe[(self._known >> np.uint64(44)).astype(np.int64)] = True

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, "Lattice"]]:
        """Marked words of at most STRETCH characters in groups of like length, each as one lattice of bounded size; ``(places, lattice)``."""
        self._prepare()
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        order, a = order[size[order] > 0], 0
        while a < len(order):
            # as many words as fit, none of them padded by more than a quarter
            b = min(len(order), a + max(1, self.CELLS // int(size[order[a]]) // self.most))
            b = a + int(np.searchsorted(size[order[a:b]], size[order[a]] * 5 // 4, side="right"))
            yield order[a:b], Lattice(self, [words[i] for i in order[a:b]])
            a = b

    def score(self, words: list[str]) -> np.ndarray:
        """For each word, the log of the summed probability of all its segmentations."""
        out = np.zeros(len(words))
        marked = [MARK + x if len(x) < STRETCH else "" for x in words]
        for at, lattice in self.groups(marked):
            out[at] = lattice.forward()[np.arange(len(at)), lattice.n]
        for i in [i for i, x in enumerate(marked) if not x]:
            out[i] = self.score_long(MARK + words[i])
        return out

    def score_long(self, word: str) -> float:
        """The same for one word of any length, in memory that does not grow with it.

        What a stretch does to the sums at the ``most`` places before it is a matrix; many
        stretches are worked on side by side, and their matrices applied one after the other.
        """
        self._prepare()
        m = self.most
        state = np.full(m, -np.inf)  # logs of the sums at the last m places, the latest first
        state[0] = 0.0
        n_side = max(1, self.CELLS // (SIDE * m))
        for a in range(0, len(word), n_side * SIDE):
            part = word[a : a + n_side * SIDE]
            # pieces may begin up to m - 1 characters before their stretch
            pieces = [word[max(0, a + k - m + 1) : a + min(len(part), k + SIDE)] for k in range(0, len(part), SIDE)]
            before = [min(m - 1, a + k) for k in range(0, len(part), SIDE)]
            for matrix in Lattice(self, pieces).transfers(np.array(before), m):
                state = log_sum(list(matrix + state[:, None]))
        return float(state[0])

    def expect(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in ``counts`` copies of the words."""
        into = np.zeros(len(self.texts))
        stretches, of = [], []
        for k, word in enumerate(words):
            marked = MARK + word
            for a in range(0, len(marked), STRETCH):
                stretches.append(marked[a : a + STRETCH])
                of.append(k)
        counts = counts[np.array(of, np.int64)]
        for at, lattice in self.groups(stretches):
            lattice.expect(counts[at], into)
        return into


class Lattice:
    """All segmentations of some words: ``piece[l - 1][w, i]`` is the piece of ``l`` characters from character ``i`` of word ``w``, or -1."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.pieces = pieces
        self.n = np.fromiter(map(len, words), np.int64, len(words))
        width = int(self.n.max())
        codes = np.zeros((len(words), width), np.uint32)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes[np.arange(width) < self.n[:, None]] = flat
        self.codes = codes
        value = mix64(codes.astype(np.uint64) + np.uint64(1))
        self.piece, self.lp = [], []
        h = np.zeros_like(value)
        for size in range(1, min(pieces.most, width) + 1):
            h = h[:, : width - size + 1] * pieces.BASE + value[:, size - 1 :]
            key = mix64(h)
            maybe = pieces._maybe[(key >> np.uint64(44)).astype(np.int64)] & (np.arange(width - size + 1) + size <= self.n[:, None])
            got = np.full(key.shape, -1, np.int32)
            some = key[maybe]
            at = np.minimum(np.searchsorted(pieces._known, some), len(pieces._known) - 1)
            got[maybe] = np.where(pieces._known[at] == some, pieces._ids[at], -1)
            self.piece.append(got)
            self.lp.append(np.where(got >= 0, pieces.logp[got], -np.inf))
        # characters that are no piece are spelled in bytes
        self.spelled = (self.piece[0] < 0) & (np.arange(width) < self.n[:, None])
        self.chars, back = np.unique(codes[self.spelled], return_inverse=True)
        self.spelling = [pieces.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in self.chars.tolist()]
        self.back = back
        if len(self.chars):
            self.lp[0][self.spelled] = np.array([pieces.logp[x].sum() for x in self.spelling])[back]

    def forward(self) -> np.ndarray:
        """``alpha[w, j]``: log of the summed probability of all segmentations of the first ``j`` characters."""
        alpha = np.full((len(self.n), self.codes.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, alpha.shape[1]):
            alpha[:, j] = log_sum([alpha[:, j - k] + self.lp[k - 1][:, j - k] for k in range(1, min(j, len(self.lp)) + 1)])
        return alpha

    def transfers(self, before: np.ndarray, most: int) -> np.ndarray:
        """``[w, i, j]``: log of the summed probability from the i-th last place before word ``w``'s own characters to its j-th last place.

        The first ``before`` characters of each word only begin pieces that end in its own.
        """
        n_words, own = len(self.n), self.n - before
        # states[k]: from each of the places before (rows), the sums at the k-th last place so far
        states = [np.full((n_words, most), -np.inf) for _ in range(most)]
        for k in range(most):
            states[k][:, k] = 0.0
        for j in range(1, int(own.max()) + 1):
            end, live = before + j, own >= j
            terms = []
            for k in range(1, min(most, len(self.lp)) + 1):
                start = end - k
                ok = live & (start >= 0) & (start < self.lp[k - 1].shape[1])
                lp = np.where(ok, self.lp[k - 1][np.arange(n_words), np.clip(start, 0, self.lp[k - 1].shape[1] - 1)], -np.inf)
                terms.append(states[k - 1] + lp[:, None])
            new = log_sum(terms)
            shifted = [new, *states[:-1]]
            states = [np.where(live[:, None], x, y) for x, y in zip(shifted, states)]
        return np.stack(states, axis=2)

    def expect(self, counts: np.ndarray, into: np.ndarray) -> None:
        alpha, width = self.forward(), self.codes.shape[1]
        beta = np.full(alpha.shape, -np.inf)
        beta[np.arange(len(self.n)), self.n] = 0
        for i in range(width - 1, -1, -1):
            more = log_sum([self.lp[k - 1][:, i] + beta[:, i + k] for k in range(1, min(width - i, len(self.lp)) + 1)])
            beta[:, i] = np.where(i < self.n, more, beta[:, i])
        scale = np.log(counts) - beta[:, 0]
        for k, (piece, lp) in enumerate(zip(self.piece, self.lp), 1):
            share = np.exp(alpha[:, : width - k + 1] + lp + beta[:, k:] + scale[:, None])
            real = piece >= 0
            into += np.bincount(piece[real], weights=share[real], minlength=len(into))
            if k == 1 and len(self.chars):
                for ids, x in zip(self.spelling, np.bincount(self.back, weights=share[self.spelled], minlength=len(self.chars))):
                    np.add.at(into, ids, x)


def log_sum(terms: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of exponentials; minus infinity where all terms are."""
    stack = np.stack(terms)
    top = stack.max(0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(stack - safe).sum(0))


def load_pieces(path: str) -> Pieces:
    """Pieces of a sentencepiece file.  Its scores are minus the rank of a merge, so they start as weights 1 / (rank + 10)."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    texts = [p.id_to_piece(i) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i)) else "" for i in range(n)]
    score = np.array([p.get_score(i) for i in range(n)])
    weight = 1 / (np.maximum(0, -score) + 10)
    return Pieces(texts, [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)], p.eos_id(), np.log(weight / weight.sum()))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the documents that are not learned from: crc32 of the id as text leaves 1 of 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _word_counts(rows: DataFrame) -> DataFrame:
    """Every distinct word, lower-cased in A-Z, with its count in training documents (0: only in others) and in all."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, "text", 4 << 20)):
            words = Words(b.column("text"), lower=True)
            train = ~np.asarray(b.column("held_out").to_numpy(zero_copy_only=False), bool)
            codes, distinct = coded(words.data, words.start, words.end)
            n = np.bincount(codes, minlength=len(distinct))
            t = np.bincount(codes, weights=train[words.text_of()], minlength=len(distinct)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.large_string()).cast(pa.string()), pa.array(t), pa.array(n)], names=["word", "train", "n"])

    return rows.mapInArrow(counted, "word string, train long, n long").groupBy("word").agg(F.sum("train").alias("train"), F.sum("n").alias("n"))


def fit(words: DataFrame, n_train_docs: int, pieces: Pieces, rounds: int = ROUNDS) -> Pieces:
    """Piece probabilities by expectation-maximisation over all training words; only one number a piece comes to the driver."""
    usable = {*pieces.byte_ids.tolist(), pieces.end_id}
    unused = [i for i, t in enumerate(pieces.texts) if not t and i not in usable]  # other control pieces
    prior = PRIOR * np.exp(pieces.logp)
    for _ in range(rounds):

        def expected(batches: Iterator[pa.RecordBatch], pieces: Pieces = pieces) -> Iterator[pa.RecordBatch]:
            into = np.zeros(len(pieces.texts))
            for b in batches:
                into += pieces.expect(b.column("word").to_pylist(), b.column("train").to_numpy().astype(float))
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(into[at])], names=["piece", "n"])

        got = words.where("train > 0").select("word", "train").mapInArrow(expected, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        count = prior.copy()
        np.add.at(count, got["piece"].to_numpy(int), got["n"].to_numpy(float))
        count[pieces.end_id] += n_train_docs
        count[unused] = 1e-300
        pieces = pieces.with_logp(np.log(count / count.sum()))
    return pieces


def score(docs: DataFrame, pieces: Pieces, rounds: int = ROUNDS, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``held_out``, counts, the base score and the model's log10 probability.

    A null or empty text has its end mark alone.  The base is a word unigram with 0.5
    added to each count.  Rows with a null id count as one with an empty id and are
    trained on or not by it.  Repeated rows are scored alike.  Other columns are not
    read.  An empty table gives an empty result; without training documents all words
    are unknown and pieces keep their first weights.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    words = keep(_word_counts(rows))
    t = words.agg(F.sum("train").alias("n"), F.count_if(F.col("train") > 0).alias("v")).first()
    n_docs = rows.where("not held_out").count()
    total, distinct = (t["n"] or 0) + n_docs, (t["v"] or 0) + (n_docs > 0)
    pieces = fit(words, n_docs, pieces, rounds)

    def scored_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pieces.score(b.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=["word", "train", "n", "logp"])

    scored = keep(words.mapInArrow(scored_words, "word string, train long, n long, logp double"))
    return _documents(rows, scored, head, total, distinct, n_docs, float(pieces.logp[pieces.end_id]))


def _documents(rows: DataFrame, scored: DataFrame, head: int, total: int, distinct: int, n_docs: int, end_logp: float) -> DataFrame:
    """Bring the words' scores to the documents: the head by broadcast, the rest by a join on the word."""
    # the least count that at most ``head`` words reach
    sizes = scored.groupBy("n").count().where(F.col("n") > 1).orderBy(F.desc("n")).limit(head).collect()
    least, sofar = 1 << 62, 0
    for r in sizes:
        sofar += r["count"]
        if sofar > head:
            break
        least = r["n"]
    top = scored.where(F.col("n") >= least).select("word", "train", "logp").toArrow()
    texts = top["word"].combine_chunks().cast(pa.large_string()).cast(pa.large_binary())
    shared = rows.sparkSession.sparkContext.broadcast((texts, top["train"].to_numpy(), top["logp"].to_numpy()))
    floor = math.log10(total + 0.5 * (distinct + 1))
    base = lambda c: np.log10(c + 0.5) - floor

    def scored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, train, logp = shared.value
        columns = (base(train), logp, (train > 0).astype(float))
        key = TaskContext.get().partitionId() << 40
        for b in (part for batch in batches for part in slices(batch, "text", 4 << 20)):
            words = Words(b.column("text"), lower=True)
            of, n = words.text_of(), b.num_rows
            codes, distinct = coded(words.data, words.start, words.end)
            at = pc.index_in(distinct, value_set=known).fill_null(-1).to_numpy()[codes]
            found = at >= 0
            sums = [np.bincount(of[found], weights=x[at[found]], minlength=n) for x in columns]
            rest = np.flatnonzero(~found)
            texts = distinct.take(pa.array(codes[rest])).cast(pa.large_string()).cast(pa.string())
            bounds = np.searchsorted(of[rest], np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key + np.arange(n)), b.column("doc_id"), b.column("held_out"), pa.array(words.count + 1),
                    pa.array(sums[2].astype(np.int64)), pa.array(sums[0].astype(float)), pa.array(sums[1].astype(float)),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), texts),
                ],
                names=["key", "doc_id", "held_out", "n_tokens", "known", "base", "logp", "rest"],
            )
            key += n

    schema = "key long, doc_id long, held_out boolean, n_tokens long, known long, base double, logp double, rest array<string>"
    docs = keep(rows.mapInArrow(scored_rows, schema))
    rest = (
        docs.select("key", F.explode("rest").alias("word"))
        .join(scored, "word")
        .groupBy("key")
        .agg(F.sum(F.log10(F.col("train") + 0.5) - floor).alias("b"), F.sum("logp").alias("l"), F.count_if(F.col("train") > 0).alias("k"))
    )
    zero = F.lit(0.0)
    return docs.drop("rest").join(rest, "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0)) + int(n_docs > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero) + float(base(np.array(n_docs)))).alias("base_score"),
        ((F.col("logp") + F.coalesce("l", zero) + end_logp) / math.log(10)).alias("score"),
    )
