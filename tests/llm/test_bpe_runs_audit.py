"""Byte-level BPE, periodic runs and the source audit."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sqlcheck import SMALL, same

from meshlake.llm import byte_bpe, periodic_runs, source_audit
from meshlake.llm import queries as q

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, ids string, n long, term string, p string"
ROWS = [
    (0, None, "en", "a"), (1, "", "en", "a"), (2, " \n\t ", None, "a"), (3, "One two", "en", None), (4, "don't stop 12 é中文\x00 \x1c!", "en", "a"), (4, "don't stop 12 é中文\x00 \x1c!", "en", "a"),
    (None, "a a a a a a a", "en", "b"), (5, "x y " * 30000, "fr", "b"), (6, "z" * 300_000, "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "ids", 1, "term", "p") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("same", pat_str=P.PATTERN, mergeable_ranks=encoder.rank, special_tokens={})


def packed(ids):
    return np.array(ids, "<u4").tobytes()


# byte-level BPE

ODD = st.sampled_from([chr(c) for c in list(byte_bpe.class_differences())[::500]]) if byte_bpe.class_differences() else st.just("x")


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from("aabbcde  \n\t's1é中"), ODD), max_size=60))
def test_ids_equal_those_of_the_library(encoder, library, text):
    got = encoder.encode([text], {})[0]
    assert got == packed(library.encode_ordinary(text))
    assert encoder.decode(got) == text.encode()


def test_one_line_of_many_words_merges_as_each_alone(encoder, library):
    rng = random.Random(3)
    words = list({"".join(rng.choice("abcdest") for _ in range(rng.randint(1, 40))) for _ in range(3000)})
    assert encoder.replayed(words) == {w: packed(library.encode_ordinary(w)) for w in words}


def test_pairs_of_lower_rank_come_first_in_their_word():
    # the merge of "xy" opens "xya", of a lower rank, beside a second "xy" in the word
    ranks = {bytes([b]): b for b in range(256)} | {b"xya": 256, b"xy": 257, b"ax": 258, b"xyx": 259}
    import base64

    raw = b"\n".join(base64.b64encode(t) + b" " + str(n).encode() for t, n in ranks.items())
    mine = byte_bpe.Encoder(raw, r"\S+|\s+", {})
    theirs = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    texts = [" ".join("".join(rng.choice("xya") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 6))) for _ in range(400)]
    assert mine.encode(texts, {}) == [packed(theirs.encode_ordinary(t)) for t in texts]


@pytest.mark.parametrize("text", ["a" * 200_000, "ab" * 60_000, " " * 100_000, "x\n" * 700_000, "word " * 300_000])
def test_long_texts_and_words(encoder, library, text):
    assert encoder.encode([text, None, ""], {}) == [packed(library.encode_ordinary(text)), b"", b""]


def test_bounds_do_not_change_ids(encoder, monkeypatch):
    texts = [f"some text {k} and more of it {k % 7}" for k in range(200)]
    whole = encoder.encode(texts, {})
    monkeypatch.setattr(byte_bpe, "WORDS", 3)
    monkeypatch.setattr(byte_bpe, "KNOWN", 5)
    monkeypatch.setattr(byte_bpe, "LONGEST", 2)
    monkeypatch.setattr(byte_bpe, "REPLAY_BYTES", 4)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 10)
    assert encoder.encode(texts, {}) == whole


def test_vocabularies_and_ids_that_are_none(encoder):
    with pytest.raises(ValueError):
        byte_bpe.Encoder(b"YQ== 0", P.PATTERN, {})
    with pytest.raises(ValueError):
        encoder.decode(packed([50256]))


def test_encoding_of_hard_rows(docs, encoder, library):
    got = byte_bpe.encode(docs, encoder, keep=("doc_id", "lang", "p"))
    assert got.columns == ["doc_id", "lang", "p", "ids"]
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got.collect()) == sorted((str(i), packed(library.encode_ordinary(t or ""))) for i, t, *_ in ROWS)
    back = byte_bpe.decode(got, encoder)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"]).decode()) for r in back.collect()) == sorted((str(i), t or "") for i, t, *_ in ROWS)
    with pytest.raises(ValueError):
        byte_bpe.encode(docs, encoder, keep=("IDS",))
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), encoder), encoder).count() == 0


def test_whole_table_of_ids(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in q.op11_byte_bpe(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode_ordinary(text)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


# periodic runs


def brute_runs(w, times=4, least=6):
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size, part = j - i + p, w[i : j + p]
            if j > i and size >= max(least, times * p) and not any(part[d:] == part[: size - d] for d in range(1, p)):
                out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out)


def row_of(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2]), " ".join(x for i, x in enumerate(w) if i not in gone)


RUNS = st.lists(st.one_of(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 40)), st.tuples(st.lists(st.integers(0, 3), max_size=6), st.just(1))), max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(RUNS, min_size=1, max_size=4), st.sampled_from([(512, 2.0), (4, 2.0), (4, 1e9)]), st.sampled_from([(4, 6), (2, 2), (3, 9)]))
def test_runs_by_brute_force(texts, bounds, rule):
    texts = [[x % (3 + k) for part, n in t for x in (part * n)[: len(part) * n - n % 3]] for k, t in enumerate(texts)]
    codes, first = np.array([x for t in texts for x in t], np.int64), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(int)
    old = periodic_runs.SHORT, periodic_runs.PAIR_STEPS
    try:
        periodic_runs.SHORT, periodic_runs.PAIR_STEPS = bounds
        assert periodic_runs.document_runs(codes, first, *rule) == [brute_runs(t, *rule) for t in texts]
    finally:
        periodic_runs.SHORT, periodic_runs.PAIR_STEPS = old


@pytest.mark.parametrize("steps", [1e9, 1e-9])
def test_lag_counts_are_exact(monkeypatch, steps):
    """By transforms alone and by pairs alone."""
    monkeypatch.setattr(periodic_runs, "SHORT", 1)
    monkeypatch.setattr(periodic_runs, "PAIR_STEPS", steps)
    rng = np.random.default_rng(2)
    texts = [np.minimum(rng.zipf(1.5, n), 50) for n in (3000, 0, 1, 900, 5)]
    counts, base = periodic_runs.lag_counts(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    want = [int((t[:-p] == t[p:]).sum()) for t in texts for p in range(1, len(t) // 4 + 1)]
    assert counts.tolist() == want and base[-1] == len(want)


def test_a_long_text_with_a_long_period():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 500, 300_000)
    codes[100_000:140_000] = np.tile(codes[100_000:105_000], 8)
    codes[140_000] = -1
    runs = periodic_runs.document_runs(codes, np.array([0, len(codes)]))[0]
    assert (100_000, 40_000, 5_000) in runs or any(s <= 100_000 and s + n == 140_000 and p == 5000 for s, n, p in runs)


def test_runs_of_hard_rows(spark, docs):
    got = periodic_runs.find_runs(docs, keep=("doc_id", "p", "ids")).collect()
    want = []
    for i, text, *_ in ROWS:
        w = WORD.findall(text or "")
        runs = brute_runs(w) if len(w) < 1000 else [(0, 60000, 2)]
        head, rest = row_of(w, runs)
        want.append((i, "p", "ids", len(w), *head, [tuple(r) for r in runs], rest))
    assert sorted(map(repr, (tuple([*r[:-2], [tuple(x) for x in r[-2]], r[-1]]) for r in got))) == sorted(map(repr, want))
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs.withColumnRenamed("p", "Period"), keep=("Period",))
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_whole_table_of_runs(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = q.op12_periodic_runs(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts) and sum(r["n_runs"] for r in got) > 20
    for r in got:
        w, h = WORD.findall(texts[r["doc_id"]]), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            a, g = h // 10 % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = brute_runs(w)
        head, rest = row_of(w, runs)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert tuple(r)[1:] == (*head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest())


def test_planted_rows_without_words(spark):
    """Documents whose hash would change them, but for their lack of words."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows = [(i, t) for i, t in zip(ids, (None, "", " \n", "one"))] + [(None, "a b")]
    got = q.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))


# source audit


def test_shares_are_exact_beyond_64_bits(spark):
    cases = [(0, 0, 1), (3, 10, 4), (9_000_000_000_000, 9_000_000_000_001, 1000), (123_456_789_012, 9_876_543_210_987, 10_000_000), (0, 0, 0)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select("c", "n", "v", source_audit.share("c", "n", "v").alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 2) // max(1, r["n"] + 2 * r["v"]) for r in got)


AUDIT = "doc_id long, text string, lang string, source string, term string, n long"


def brute_audit(rows, min_docs, most):
    """The definition, in whole numbers."""
    rows = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, lang, source, *_ in rows]
    out, langs = [], sorted({r[0] for r in rows})
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in langs:
        mine = [r for r in rows if r[0] == lang]
        terms = sorted({t for r in mine for t in r[2]}, key=str.encode)
        terms = [t for t in terms if sum(t in r[2] for r in mine) >= min_docs]
        sources = sorted({r[1] for r in mine})

        def shares(part):
            counts = [sum(r[2].count(t) for r in part) for t in terms]
            return counts, [1 + 10**9 * (c + 2) // (sum(counts) + 2 * len(terms)) for c in counts]

        of, whole = {s: shares([r for r in mine if r[1] == s]) for s in sources}, shares(mine)[1]
        for s in sources:
            pairs = sorted(((-sum(map(f, of[s][1], of[o][1])), o.encode(), o) for o in sources if o != s))
            found = sorted((-f(p, w), t.encode(), t) for t, c, p, w in zip(terms, *of[s], whole) if c and p > w)[:most]
            out += [(lang, s, part, item, -v, k) for part, got in (("pair", pairs), ("term", found)) for k, (v, _, item) in enumerate(got, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_audit_by_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [*"abcdefgh", "Éa", "éa", "x1y", "中", "A-b"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [
        (k, rng.choice([None, "", *[" ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randint(1, 40))) for _ in range(4)]]), rng.choice(["en", "fr", None, ""]), rng.choice([*"abcde", None]), "t", 7)
        for k in range(120)
    ]
    rows += [rows[5]] * 12 + [(500, "12 34", "xx", "only", "t", 7), (501, None, "xx", "other", "t", 7), (502, "lone", "yy", "one", "t", 7)]
    docs = spark.createDataFrame(rows, AUDIT).repartition(5)
    for least, most in ((10, 10), (1, 3), (2, 1)):
        got = sorted(map(tuple, source_audit.audit(docs, min_docs=least, most=most).collect()))
        assert got == brute_audit(rows, least, most)


def test_only_promising_buckets_are_evaluated(spark, monkeypatch):
    """Terms with counts that no bound lets into the first ones are not looked at."""
    text = " ".join(w for k in range(26) for w in [chr(97 + k) * 3] * (k + 1))
    rows = [(d, text if s == "a" else text[: 40 + d], "en", s, "t", 7) for d in range(12) for s in "ab"]
    docs = spark.createDataFrame(rows, AUDIT)
    seen = []
    real = source_audit.small

    def spied(df):
        seen.append((df.columns, df.count()))
        return real(df)

    monkeypatch.setattr(source_audit, "small", spied)
    got = sorted(map(tuple, source_audit.audit(docs, most=2).collect()))
    assert got == brute_audit(rows, 10, 2)
    chosen = [n for columns, n in seen if columns == ["lang", "source", "n"]]
    assert chosen and chosen[0] < 10  # of 26 buckets and more


def test_audit_of_hard_rows(spark, docs):
    rows = [(*r, "t", 7) for r in ROWS]
    assert sorted(map(tuple, source_audit.audit(docs, min_docs=1).collect())) == brute_audit(rows, 1, 10)
    assert source_audit.audit(docs.limit(0)).count() == 0


def test_audit_beyond_the_broadcast(spark, monkeypatch):
    from meshlake.llm import _shared

    monkeypatch.setattr(_shared, "BROADCAST", 0)
    same(q.op13_source_audit(spark, SMALL), q.OP13_SQL)
