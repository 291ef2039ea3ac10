"""Quality classifier: a byte-level convolutional network in numpy.

Every document is cut into overlapping chunks that cover all its bytes.  Learned filters
over byte embeddings run along each chunk and are max-pooled; the pooled features of all
chunks, as their maximum and their mean over the document, give one probability.

Training sees labelled texts only: a sample of at most ``max_train`` rows that have at
most ``max_bytes`` of text together.  The texts of the sample are seen whole, all their
chunks in every epoch.  Scoring is a pass over the table without any shuffle and covers
every byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import quoted
from ._words import slices, text_bytes

EMBED, FILTERS, WIDTH, STRIDE = 8, 16, 6, 3
#: Bytes of a chunk and between the starts of two chunks; the overlap is the difference.
CHUNK, STEP = 384, 360
#: Most labelled rows that training reads, taken by a hash of their id.
MAX_TRAIN = 3000
#: Most bytes of text of all these rows together, half of them for each class: where they do not suffice, the longest texts go.
MAX_BYTES = 32 << 20
#: Least passes over the sample, and least steps of BATCH texts in all, which a small sample needs more passes for.
EPOCHS, STEPS, BATCH = 12, 500, 32
THRESHOLD = 0.7
_SLICE = 1024  # chunks scored, or learned from, at once


@dataclass
class Net:
    """Byte embeddings, filters and the output layer over (max, mean) of pooled features."""

    embed: np.ndarray  # 257 x EMBED; row 256 is padding
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    out_bias: float

    @staticmethod
    def fresh(seed: int) -> "Net":
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)
        embed[256] = 0
        filters = rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        return Net(embed, filters, np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32), 0.0)

    def dumps(self) -> bytes:
        """The parameters as float32, end to end."""
        return b"".join(p.astype("<f4").tobytes() for p in (self.embed, self.filters, self.bias, self.out, np.array([self.out_bias])))

    @staticmethod
    def loads(raw: bytes | None) -> "Net":
        """Of ``dumps``; without training rows, a net that answers one half."""
        if raw is None:
            return train([], np.zeros(0))
        net = Net.fresh(0)
        parts = np.split(np.frombuffer(raw, "<f4"), np.cumsum([p.size for p in (net.embed, net.filters, net.bias, net.out)]))
        shapes = (net.embed.shape, net.filters.shape, net.bias.shape, net.out.shape)
        return Net(*(p.reshape(x).copy() for p, x in zip(parts, shapes)), float(parts[4][0]))

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Max-pooled filter outputs of each chunk (rows of byte values, 256 for padding)."""
        table = self._pairs()
        n = (chunks.shape[1] - WIDTH) // STRIDE + 1
        out = np.empty((len(chunks), FILTERS), np.float32)
        for a in range(0, len(chunks), 128):
            part = chunks[a : a + 128]
            total = None
            for j in range(WIDTH):
                step = table[j][part[:, j : j + (n - 1) * STRIDE + 1 : STRIDE]]
                total = step if total is None else np.add(total, step, out=total)
            out[a : a + 128] = without_padding(total, part).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def _pairs(self) -> np.ndarray:
        """What each byte adds to each filter at each place: WIDTH x 257 x FILTERS."""
        return np.einsum("be,wef->wbf", self.embed, self.filters.reshape(WIDTH, EMBED, FILTERS)).astype(np.float32)

    def scores(self, column: pa.Array) -> np.ndarray:
        """The probability of label 1 for each text; an empty text is one chunk of padding."""
        data, offsets = text_bytes(column)
        doc, start, stop = chunks_of(offsets)
        n_texts = len(offsets) - 1
        most = np.zeros((n_texts, FILTERS), np.float32)
        total = np.zeros((n_texts, FILTERS), np.float64)
        for a in range(0, len(doc), _SLICE):
            b = slice(a, a + _SLICE)
            got = self.pooled(cut(data, start[b], stop[b]))
            np.maximum.at(most, doc[b], got)
            np.add.at(total, doc[b], got)
        mean = (total / np.bincount(doc, minlength=n_texts)[:, None]).astype(np.float32)
        return sigmoid(np.concatenate([most, mean], 1) @ self.out + self.out_bias)


def without_padding(outputs: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Filter outputs (chunks x windows x FILTERS), with those of windows that begin behind a chunk's last byte below all others; the first window stays."""
    windows = np.maximum(1, -(-(chunks != 256).sum(1) // STRIDE))
    short = np.flatnonzero(windows < outputs.shape[1])
    beyond = np.arange(outputs.shape[1]) >= windows[short, None]
    outputs[short] = np.where(beyond[:, :, None], np.float32(-np.inf), outputs[short])
    return outputs


def cut(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Chunks of CHUNK bytes from each start, padded with 256 from each stop on."""
    at = start[:, None] + np.arange(CHUNK)
    inside = at < stop[:, None]
    if not len(data):
        return np.full(at.shape, 256, np.int16)
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int16), np.int16(256))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))


def chunks_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, stop)`` of the chunks that cover each text; an empty one has one chunk, of padding."""
    n = np.maximum(1, -(-np.maximum(np.diff(offsets) - CHUNK, 0) // STEP) + 1)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, offsets[text] + place * STEP, offsets[text + 1]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 0, epochs: int = EPOCHS) -> Net:
    """Fit by Adam on the log loss.

    Besides all chunks of all texts, every fourth text (anew in each epoch) gives one short
    cut as an example of its own, so that short documents are judged by what they hold and
    not by their length.  With only one class (or no row) the output is that class's
    share, smoothed.
    """
    net = Net.fresh(seed)
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        net.out[:] = 0
        share = (labels.sum() + 1) / (len(labels) + 2)
        net.out_bias = float(np.log(share / (1 - share)))
        return net
    rng = np.random.default_rng(seed)
    raw = [np.frombuffer(t, np.uint8) for t in texts]
    params = [net.embed, net.filters, net.bias, net.out, np.zeros(1, np.float32)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(max(epochs, -(-STEPS // -(-len(raw) // BATCH)))):
        order = rng.permutation(len(raw))
        for a in range(0, len(order), BATCH):
            docs = order[a : a + BATCH]
            parts, label = [raw[d] for d in docs], [labels[d] for d in docs]
            for d in docs[rng.random(len(docs)) < 0.25]:
                begin = int(rng.integers(0, max(1, len(raw[d]) - 16)))
                parts.append(raw[d][begin : begin + int(rng.integers(12, 160))])
                label.append(labels[d])
            grads = gradients(net, parts, np.array(label, np.float32))
            t += 1
            for p, g, mm, vv in zip(params, grads, m, v):
                mm *= 0.9
                mm += 0.1 * g
                vv *= 0.999
                vv += 0.001 * g * g
                p -= 0.01 * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
            net.embed[256] = 0
            net.out_bias = float(params[4][0])
    return net


def gradients(net: Net, texts: list[np.ndarray], label: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss over the texts, by all their chunks, _SLICE of them at a time."""
    data = np.concatenate(texts)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    owner, start, stop = chunks_of(offsets)
    k, table = len(texts), net._pairs()
    pooled, at = np.empty((len(owner), FILTERS), np.float32), np.empty((len(owner), FILTERS, WIDTH), np.int16)
    for a in range(0, len(owner), _SLICE):
        chunks = cut(data, start[a : a + _SLICE], stop[a : a + _SLICE])
        n = (CHUNK - WIDTH) // STRIDE + 1
        z = sum(table[j][chunks[:, j : j + (n - 1) * STRIDE + 1 : STRIDE]] for j in range(WIDTH))
        top = without_padding(z, chunks).argmax(1)  # chunks x FILTERS
        pooled[a : a + _SLICE] = np.take_along_axis(z, top[:, None], 1)[:, 0]
        at[a : a + _SLICE] = chunks[np.arange(len(chunks))[:, None, None], top[:, :, None] * STRIDE + np.arange(WIDTH)]
    pooled = np.maximum(pooled + net.bias, 0)
    count = np.bincount(owner, minlength=k).astype(np.float32)
    most = np.zeros((k, FILTERS), np.float32)
    np.maximum.at(most, owner, pooled)
    mean = np.zeros((k, FILTERS), np.float32)
    np.add.at(mean, owner, pooled)
    mean /= count[:, None]
    h = np.concatenate([most, mean], 1)
    d = ((sigmoid(h @ net.out + net.out_bias) - label) / k).astype(np.float32)
    g_out, g_bias = h.T @ d, np.array([d.sum()], np.float32)
    g_h = d[:, None] * net.out
    # the maximum's share goes to the first chunk that has it
    first = np.full((k, FILTERS), len(owner))
    for f in range(FILTERS):
        has = np.flatnonzero(pooled[:, f] == most[owner, f])
        np.minimum.at(first[:, f], owner[has], has)
    g_pool = g_h[owner, FILTERS:] / count[owner, None] + g_h[owner, :FILTERS] * (first[owner] == np.arange(len(owner))[:, None])
    g_pool *= pooled > 0
    g_filters = np.zeros((WIDTH * EMBED, FILTERS), np.float32)
    g_embed = np.zeros((257, EMBED), np.float64)
    by_filter = net.filters.reshape(WIDTH, EMBED, FILTERS)
    for f in range(FILTERS):
        x = net.embed[at[:, f]]  # chunks x WIDTH x EMBED
        g_filters[:, f] = np.tensordot(g_pool[:, f], x, 1).ravel()
        for w in range(WIDTH):
            weight = np.bincount(at[:, f, w], weights=g_pool[:, f], minlength=257)
            g_embed += weight[:, None] * by_filter[w, :, f]
    return [g_embed.astype(np.float32), g_filters, g_pool.sum(0), g_out, g_bias]


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """True where crc32 of the id as text leaves ``fold``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def candidates(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Labelled ids that are not held out, as ``__id`` and ``__label``."""
    marked = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    return marked.where("__label is not null and __id is not null").where(~held_out("__id")).distinct()


def sampled(docs: DataFrame, marked: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What training receives: ``max_train`` rows by a hash at most, whole texts, ``__label`` and ``__text``.

    Where a class has more than half of ``max_bytes``, its longest texts are left out, so
    that one long text never stands in the way of others; one of more than half goes itself.
    """
    by_hash = [F.xxhash64("__id"), F.col("__id"), F.col("__label")]
    picked = [marked.where(F.col("__label") == x).orderBy(*by_hash).limit(max_train // 2) for x in (0, 1)]
    # at most max_train short rows are broadcast; the texts do not move
    picked = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text is not null").join(picked, "__id")
    rows = rows.select("__label", "__text", F.xxhash64("__text").alias("__hash"), F.octet_length("__text").alias("__n"))
    # the sizes of at most max_train rows come to the driver and say which texts stay
    order = ("__hash", "__label", "__n")
    sizes = rows.select(*order).orderBy(*order).limit(max_train).collect()
    classes, n = [], 0
    for label in (0, 1):
        total, last = 0, None
        for r in sorted((r for r in sizes if r["__label"] == label), key=lambda r: (r["__n"], r["__hash"])):
            total += r["__n"]
            if total > max_bytes // 2:
                break
            last, n = r, n + 1
        if last is not None:
            classes.append((F.col("__label") == label) & (F.struct("__n", "__hash") <= F.struct(F.lit(last["__n"]), F.lit(last["__hash"]))))
    if not classes:
        return rows.select("__label", "__text").limit(0)
    within = F.struct(*order) <= F.struct(*[F.lit(sizes[-1][c]) for c in order])
    return rows.where(within & reduce(lambda a, b: a | b, classes)).orderBy(*order).limit(n).select("__label", "__text")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Net:
    """Train on labelled rows that are not held out, at most ``max_train`` of them (half of each class at least, where there are so many).

    Rows with a null label, id or text do not train.  The sample is by a hash of the id, so
    it does not depend on the order of the rows; its texts are seen whole.
    """
    marked = candidates(labels, id_col, label_col)
    sample = sampled(docs, marked, max_train, max_bytes, id_col, text_col).withColumn("all", F.lit("all"))
    found = sample.groupBy("all").applyInPandas(lambda got: trained(got, seed), "net binary, ones long, n long").collect()
    if not found:
        return Net.loads(None)
    net, (ones, n) = Net.loads(found[0]["net"]), found[0][1:]
    # the sample has more of the rarer class than the table; the scores are to follow the table's shares
    true = marked.agg(F.sum("__label").alias("ones"), F.count("*").alias("n")).first()
    odds = lambda ones, n: np.log((ones + 1) / (n - ones + 1))
    if 0 < ones < n:
        net.out_bias += float(odds(true["ones"], true["n"]) - odds(ones, n))
    return net


def trained(got: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Train in one task on the bounded sample, in an order that its rows alone decide."""
    got = got.sort_values(["__text", "__label"])
    labels = got["__label"].to_numpy()
    texts = [x.encode("utf-8", "surrogatepass") for x in got["__text"]]
    return pd.DataFrame({"net": [train(texts, labels, seed).dumps()], "ones": [int(labels.sum())], "n": [len(labels)]})


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep`` and the score of each text, null and empty ones included.

    The net's few kilobytes travel with the task.  Columns of the input beyond those named
    are not read, so clashing names do no harm; ``score_col`` must not be one of them.
    """
    columns = list(dict.fromkeys([id_col, *keep]))
    if score_col.lower() in [c.lower() for c in columns]:
        raise ValueError(f"{score_col} is a column of the input")
    rows = docs.select(*quoted(list(dict.fromkeys([*columns, text_col]))))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, text_col)):
            got = net.scores(b.column(text_col))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(got, pa.float64())], names=[*columns, score_col])

    schema = docs.select(*quoted(columns)).withColumn(score_col, F.lit(0.0)).schema
    return rows.mapInArrow(scored, schema)


def good(docs: DataFrame, net: Net, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more; all columns come through as they are."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, text_col)):
            yield b.filter(pa.array(net.scores(b.column(text_col)) >= threshold))

    return docs.mapInArrow(kept, docs.schema)
