"""Periodic runs in word sequences: stretches that repeat a shorter one several times in a row.

Heavy and light words are counted apart.  At each lag, the number of words that equal the
word so far behind them is the sum over all words of the autocorrelation of their places:
for frequent words by one Fourier transform each, whose rounded inverse is exact; for rare
ones by the differences of their places.  A run of period q has at least ``least_matches``
in a row at lag q, so only lags with so many matches in all are scanned for islands of
them.  Everything is per document, so no row moves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, fresh, quoted
from ._words import Words, coded, joined, positions, slices

#: A run repeats its period so often at least, and has so many words at least.
TIMES, LEAST = 4, 6
#: Pairs of places that cost as much as one step of a transform, and texts of fewer words, which need no transform.
PAIR_STEPS, SHORT = 2.0, 512


def least_matches(q: np.ndarray | int, times: int = TIMES, least: int = LEAST) -> np.ndarray | int:
    """Words in a row that equal the word ``q`` behind them, in the shortest run of period ``q``."""
    return np.maximum(times * q, least) - q


def light_counts(codes: np.ndarray, most_lag: np.ndarray, first: np.ndarray, base: np.ndarray, light: np.ndarray) -> np.ndarray:
    """Matches at each lag of the texts ``codes[first[t]:first[t + 1]]`` by the words marked in ``light``.

    The counts of lags 1 to ``most_lag[t]`` of text t stand from ``base[t]`` on.  Pairs go
    by the number of uses of the word between them, in ascending order, and a place leaves
    once its pair is beyond the longest lag, as all later ones are then.
    """
    out = np.zeros(int(base[-1]), np.int64)
    text = np.repeat(np.arange(len(most_lag)), np.diff(first))
    at = np.flatnonzero(light)
    at = at[np.lexsort((at, codes[at], text[at]))]
    code, place, of = codes[at], at, text[at]
    live, step = np.arange(len(at)), 1
    while len(live):
        live = live[live + step < len(at)]
        other = live + step
        lag = place[other] - place[live]
        ok = (code[other] == code[live]) & (of[other] == of[live]) & (lag <= most_lag[of[live]])
        live, lag = live[ok], lag[ok]
        if len(live):
            where = base[of[live]] + lag - 1
            low = int(where.min())
            counts = np.bincount(where - low)
            out[low : low + len(counts)] += counts
        step += 1
    return out


def heavy_counts(codes: np.ndarray, heavy: np.ndarray, most_lag: int) -> np.ndarray:
    """Matches of one text at lags 1 to ``most_lag`` by the given words: their power spectra add up, and one inverse gives all lags."""
    size = 1 << int(len(codes) + most_lag).bit_length()
    power = np.zeros(size // 2 + 1)
    for c in heavy:
        spectrum = np.fft.rfft(codes == c, size)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[1 : most_lag + 1]).astype(np.int64)


def lag_counts(codes: np.ndarray, first: np.ndarray, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """``(counts, base)``: matches at each lag up to a ``times``-th of each text, see ``light_counts``."""
    n = np.diff(first)
    most_lag = n // times
    base = np.concatenate([[0], np.cumsum(most_lag)])
    light = np.ones(len(codes), bool)
    heavies = []
    for t in np.flatnonzero(n >= SHORT).tolist():
        a, b = first[t], first[t + 1]
        found, use = np.unique(codes[a:b], return_inverse=True)
        uses = np.bincount(use)
        size = 1 << int(n[t] + most_lag[t]).bit_length()
        # a use meets about a quarter of the others within the longest lag; a transform takes size * log(size) steps
        many = uses.astype(float) ** 2 / 4 * PAIR_STEPS > size * np.log2(size)
        if many.any():
            light[a:b] = ~many[use]
            heavies.append((t, found[many]))
    counts = light_counts(codes, most_lag, first, base, light)
    for t, heavy in heavies:
        counts[base[t] : base[t + 1]] += heavy_counts(codes[first[t] : first[t + 1]], heavy, int(most_lag[t]))
    return counts, base


def islands(codes: np.ndarray, q: int, matches: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the stretches with period ``q`` that have so many matches in a row, as far as the period reaches.

    Each such row of matches holds a place whose number is a multiple of ``matches``, and
    reaches from it half as far on one side at least; only texts where this is so are
    compared at all places.
    """
    n = len(codes) - q
    at = np.arange(matches - 1, n, matches)
    at = at[codes[at] == codes[at + q]]
    back, on = at, at
    for k in range(1, min(8, (matches - 1) // 2) + 1):
        back = back[back >= k]
        on = on[on + k < n]
        back, on = back[codes[back - k] == codes[back - k + q]], on[codes[on + k] == codes[on + k + q]]
        if not len(back) and not len(on):
            return []
    if not len(back) and not len(on):
        return []
    same = np.zeros(n + 2, bool)
    same[1:-1] = codes[:n] == codes[q:]
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, stop = edge[::2], edge[1::2]
    long = stop - start >= matches
    return list(zip(start[long].tolist(), (stop - start + q)[long].tolist()))


def runs_of(codes: np.ndarray, lags: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period; ``lags`` holds every period at least."""
    found: dict[tuple[int, int], int] = {}
    for q in sorted(lags.tolist()):
        for place in islands(codes, q, int(least_matches(q, times, least))):
            # a stretch of so many periods with a shorter period is that one's run, from end to end
            found.setdefault(place, q)
    return sorted((start, length, q) for (start, length), q in found.items())


def document_runs(codes: np.ndarray, first: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    counts, base = lag_counts(codes, first, times)
    lag = positions(np.diff(base)) + 1
    enough = np.flatnonzero(counts >= least_matches(lag, times, least))
    bounds = np.searchsorted(enough, base)
    return [
        runs_of(codes[first[t] : first[t + 1]], lag[enough[bounds[t] : bounds[t + 1]]], times, least) if bounds[t] < bounds[t + 1] else []
        for t in range(len(first) - 1)
    ]


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period, compared exactly; of equal ones the first, of those the one of shorter period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


SCHEMA = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def find_runs(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), times: int = TIMES, least: int = LEAST) -> DataFrame:
    """The periodic runs of each text and the text without their repeats.

    A run is a stretch of words with smallest period q and at least ``times`` * q and
    ``least`` words that no neighbour extends.  Returns the columns ``keep`` (they must not
    have the name of a result), the number of words and runs, the strongest run (nulls
    without one), all runs by start and period, and the words that no run holds after its
    first period, joined by one space.  One row for each row.  A null text has no words.
    Other columns are not read.  ``times`` is at least 2.  A task holds a batch of texts,
    and about 100 bytes for each word of the longest one.
    """
    names = [x.split()[0] for x in SCHEMA.replace("struct<start: long, length: long, period: long>", "").split(", ")]
    clash = {c.lower() for c in keep} & set(names)
    if clash or times < 2:
        raise ValueError(f"{', '.join(sorted(clash))} of the input has the name of a result" if clash else "a run has two periods at least")
    bounded_batches(docs.sparkSession)
    source = fresh(docs.select(*quoted(list(keep))), "__source")
    rows = docs.select(*quoted(list(keep)), *[c.alias(source) for c in quoted([text_col])])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, source)):
            words = Words(b.column(source))
            codes, _ = coded(words.data, words.start, words.end)
            runs = document_runs(codes, words.first, times, least)
            text, ends = joined(words)
            collapsed, best = [], []
            for t, mine in enumerate(runs):
                a, z = int(words.first[t]), int(words.first[t + 1])
                best.append(strongest(mine))
                if a == z:
                    collapsed.append("")
                    continue
                start = int(ends[a] - (words.end[a] - words.start[a]))
                whole = bytes(text[start : int(ends[z - 1])])
                if mine:
                    out = dropped(z - a, mine)
                    whole = b" ".join(w for w, gone in zip(whole.split(b" "), out.tolist()) if not gone)
                collapsed.append(whole.decode())
            columns = [[x and x[k] for x in best] for k in range(3)] + [[x and 1000 * x[1] // x[2] for x in best]]
            made = [pa.array(words.count), pa.array([len(x) for x in runs], pa.int64()), *[pa.array(c, pa.int64()) for c in columns]]
            listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made, listed, pa.array(collapsed, pa.string())], names=[*keep, *names])

    head = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(found, f"{head}, {SCHEMA}" if head else SCHEMA)


def runs_text() -> Column:
    """The runs as text, a line ``start,length,period`` for each."""
    return F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))), "")
