from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sqlcheck import SMALL, same

from meshlake.llm import classifier, decontamination, line_dedup, lm_scoring, minhash, packing, quality_rules, sharding, substring_dedup, token_files
from meshlake.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_removed string"
LONG = " ".join(f"w{k * k % 97}" for k in range(30))
ROWS = [
    (0, None, "en", "a"), (1, "", "en", "a"), (2, " \n\t ", None, "a"), (3, "One two", "en", "a"), (4, "one TWO", "en", "a"), (5, LONG, "en", "a"), (6, LONG, "fr", "a"), (6, LONG, "fr", "a"),
    (7, "x " + LONG + " y", "en", "a"), (8, LONG + "\n" + LONG + "\nzz " + LONG, "en", "a"), (None, LONG + " q", "en", "a"), (9, "é" * 50 + " ' don't 12 a\x01b", None, None), (10, "long " * 40000, "en", "a"), (10, "other text with the same id", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", list(q.oracle_sql()))
def test_rows_equal_those_of_the_sql(spark, name):
    same(q.queries()[name](spark, SMALL), q.oracle_sql()[name])


# sharding


@pytest.mark.parametrize("bucket_bytes", [100, 1 << 24])
def test_shards_are_whole_and_even(docs, none, bucket_bytes):
    out = sharding.shuffle_shards(docs, 4, bucket_bytes=bucket_bytes)
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((a, b) for a, b, _, _ in ROWS)
    sizes = Counter(r["shard"] for r in rows)
    assert sorted(sizes) == [0, 1, 2, 3] and max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(n))
    assert sorted(map(repr, rows)) == sorted(map(repr, out.collect()))  # again the same
    assert sharding.shuffle_shards(none, 4).count() == 0
    assert len(sharding.shuffle_shards(docs, 40).collect()) == len(ROWS)


def test_copies_of_one_row_are_dealt_apart(spark):
    rows = [(None, None)] * 4000 + [(7, "same text")] * 4000 + [(k, f"text {k}") for k in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.shuffle_shards(frame, 12, bucket_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
    for d, n in ((None, 4000), (7, 4001)):
        by_shard = Counter(r["shard"] for r in out if r["doc_id"] == d)
        assert sum(by_shard.values()) == n and len(by_shard) == 12 and max(by_shard.values()) < 700
    packed = packing.pack(frame, block_docs=300).toPandas()
    assert len(packed) == len(rows) and packed["doc_id"].isna().sum() == 4000
    blocks = packed.groupby(packed["bin"] // 2**32).size()
    assert len(blocks) == 40 and blocks.max() < 450


# packing


def test_packing_is_whole(docs, none):
    out = packing.pack(docs, capacities=(8, 16, 64), block_docs=5).toPandas()
    assert len(packing.pack(none).collect()) == 0
    for _, b in out.groupby("bin"):
        used = b["piece_length"].sum()
        assert (b["bin_used"] == used).all()
        assert b["bin_capacity"].iloc[0] == min(c for c in (8, 16, 64) if c >= used)
        spans = sorted(zip(b["bin_offset"], b["piece_length"]))
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]]
    found = Counter()
    for (_, n), d in out.groupby(["doc_id", "n_length"], dropna=False):
        found[n] += d["piece_length"].sum()
    expected = Counter()
    for _, text, _, _ in ROWS:
        expected[len(words(text)) + 1] += len(words(text)) + 1
    assert found == expected


def test_packing_takes_the_fullest_bin():
    out = packing.pack_block(0, pd.Series([0, 1, 2, 3]), np.array([9, 6, 4, 1]), (10,), 0, 1e9)
    assert out["bin_used"].tolist() == [10, 10, 10, 10] and out["bin"].nunique() == 2


# decontamination, lines, substrings


def test_decontamination_of_odd_rows(spark, docs, none):
    items = spark.createDataFrame([(1, "ONE two"), (2, None), (3, ""), (4, LONG)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, items).collect()}
    assert {k for k in found if k[1] == 1} == {(3, 1), (4, 1)}
    assert {d for d, i in found if i == 4} == {5, 6, 7, 8, None}
    assert found[(7, 4)]["window_start"] == 1 and found[(7, 4)]["similarity"] == 1.0
    assert decontamination.contaminated(none, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0
    left = decontamination.decontaminate(docs, items)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {0, 1, 2, 9, 10}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=12), st.text("abc", max_size=12)), min_size=1, max_size=8))
def test_banded_distance(pairs):
    got = line_dedup.banded_distance([np.array([ord(c) for c in a], np.uint32) for a, _ in pairs], [np.array([ord(c) for c in b], np.uint32) for _, b in pairs], 2)
    assert got.tolist() == [min(3, line_dedup._plain_distance(a, b)) for a, b in pairs]


@pytest.mark.parametrize("short", [16, 1])
def test_lines_by_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(line_dedup, "SHORT", short)
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    rng = np.random.default_rng(5)
    base = ["the quick brown fox jumps over", "a second line that is long enough"]
    lines = []
    for _ in range(60):
        x = list(base[rng.integers(2)])
        for _ in range(rng.integers(0, 4)):
            x[rng.integers(len(x))] = "xyz"[rng.integers(3)]
        lines.append("".join(x))
    texts = [(k, "\n".join(lines[3 * k : 3 * k + 3]) + "\n \n") for k in range(20)]
    gone, seen, expected = 0, [], {}
    for k, t in texts:
        left = []
        for x in t.split("\n"):
            near = x.strip() and any(line_dedup._plain_distance(x, y) <= 2 for y in seen)
            gone += bool(near)
            left += [] if near else [x]
            seen += [x] if x.strip() else []
        expected[k] = "\n".join(left)
    out = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == expected and gone > 20


def test_lines_of_odd_rows(docs, none):
    out = line_dedup.dedup_lines(docs)
    rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert out.count() == len(ROWS) and out.columns == ["doc_id", "text", "lang", "n_lines", "n_removed"]
    assert rows[(0, None)]["n_lines"] == 0 and (1, "") in rows and (2, " \n\t ") in rows
    assert rows[(6, "")]["n_removed"] == 1
    assert line_dedup.dedup_lines(none).count() == 0


def test_substrings_of_odd_rows(docs, none):
    rows = substring_dedup.dedup_substrings(docs).collect()
    assert len(rows) == len(ROWS) and substring_dedup.dedup_substrings(none).count() == 0
    seen, expected = set(), []
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for d, text, _, _ in order:
        w, cover, own = words(text), set(), set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen or x in own:
                cover |= set(range(k, k + 20))
            own.add(x)
        expected.append((d, len(w), len(cover), " ".join(x for k, x in enumerate(w) if k not in cover)))
        seen |= own
    assert sorted(map(repr, ((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in rows))) == sorted(map(repr, expected))


# language model


def test_lattice_sums_all_segmentations():
    rng = np.random.default_rng(0)
    texts = ["", "▁", "a", "b", "ab", "▁a", "ba", "aab"]
    raw = rng.random(len(texts) + 257)
    logp = np.log(raw / raw.sum())
    pieces = lm_scoring.Pieces(texts + [""] * 257, list(range(len(texts), len(texts) + 256)), len(texts) + 256, logp)

    def total(s):
        if not s:
            return 1.0
        out = sum(math.exp(logp[i]) * total(s[len(t) :]) for i, t in enumerate(texts) if t and s.startswith(t))
        if s[0] not in texts:
            out += math.exp(sum(logp[len(texts) + b] for b in s[0].encode())) * total(s[1:])
        return out

    some = ["a", "abab", "aabba", "aéb", "b" * 9, "€"]
    assert np.allclose(pieces.score(some), [math.log(total("▁" + s)) for s in some])


def test_scores_of_documents(spark, docs, none):
    pieces = lm_scoring.load_pieces(q.tokenizer_file("piece_bpe_32k.model"))
    got = lm_scoring.score(docs, pieces, head=3).collect()
    assert len(got) == len(ROWS) and lm_scoring.score(none, pieces).count() == 0
    tokens = lambda t: [*words(lower(t)), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    train = Counter(t for d, text, _, _ in ROWS if not held(d) for t in tokens(text))
    n, v = sum(train.values()), len(train)
    expected = sorted((repr(d), held(d), len(tokens(t)), sum(train[x] > 0 for x in tokens(t)), n, round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)), 4)) for d, t, _, _ in ROWS)
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expected
    assert all(r["score"] < 0 for r in got)


def test_learning_raises_held_out_likelihood(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = lm_scoring.load_pieces(q.tokenizer_file("piece_bpe_32k.model"))
    held = [lm_scoring.score(docs, pieces, rounds).where("held_out").toPandas()["score"].sum() for rounds in (0, 2)]
    assert held[1] > held[0]


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**31), st.integers(0, 2**64 - 1)), max_size=700), st.integers(0, 300))
def test_code_round_trip(ids, zeros):
    x = np.array(ids + [0] * zeros, np.uint64)
    assert np.array_equal(token_files.decode(*token_files.encode(x), len(x)), x)


def test_token_files_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    path = q.tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    expected = sorted(((d is not None, d or 0), d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, text, _, _ in ROWS for i in [t.encode(text or "", add_special_tokens=False).ids + [1]])
    got = sorted(token_files.document_table(spark, docs, path).collect(), key=lambda r: r["start"])
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda d: (d is not None, d))
    assert token_files.document_table(spark, none, path).count() == 0
    with pytest.raises(ValueError):
        token_files.unpack_file(b"none")


# quality rules


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark, docs, none):
    got = quality_rules.judge(docs, quality_rules.references(docs)).collect()
    expected = sorted((repr(d), *base_counts(t)) for d, t, _, _ in ROWS)
    assert sorted((repr(r["doc_id"]), *(r[c] for c in quality_rules.COUNTS)) for r in got) == expected
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.judge(none, quality_rules.references(none)).count() == 0
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["doc_id"]: base_counts(r["text"]) for r in small.collect()}
    assert {r["doc_id"]: tuple(r[c] for c in quality_rules.COUNTS) for r in q.op8_quality_rules(spark, SMALL).collect()} == want


@pytest.mark.parametrize("block", [1024, 1])
def test_small_languages_beside_large_ones(spark, monkeypatch, block):
    monkeypatch.setattr(quality_rules, "BLOCK_LANGUAGES", block)
    rng = np.random.default_rng(1)
    text = lambda name, n: " ".join(f"{name}{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in rng.integers(0, 40, n))
    # half of the words are common ones: references come from documents that pass the base rules
    prose = lambda n: " ".join(x if k % 2 else f"rare{rng.integers(10**6)}" for k, x in enumerate(text("big", n).split()))
    rows = [(k, prose(300_000), "aa") for k in range(8)] + [(k, text("other", 150), "bb") for k in range(10, 22)]
    rows += [(30, text("few", 150), "cc"), (31, text("odd", 150), "aa"), (32, text("other", 150), "aa"), (33, text("bare", 150), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in quality_rules.judge(frame, quality_rules.references(frame)).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["kept"] and got[k]["word_distance"] > 0 for k in [*range(10, 22), 32])  # by the small language's own reference
    assert all(got[k]["kept"] and got[k]["word_distance"] == got[k]["class_distance"] == 0 for k in (30, 33))  # too few words for one
    assert not got[31]["kept"] and not got[31]["base_failed"] and got[31]["word_distance"] > quality_rules.WORD_DISTANCE


def test_distance():
    p, r = np.array([[0.5, 0.5, 0.0]]), np.array([0.0, 0.0, 1.0])
    assert quality_rules.js_distance(p, r)[0] == pytest.approx(1.0) and quality_rules.js_distance(p, p[0])[0] == 0.0


# near duplicates


def test_near_duplicates_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SHORT", 4)
    rng = np.random.default_rng(3)
    texts = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(90)]
        for _ in range(40):
            x = list(base)
            for k in rng.choice(90, rng.integers(0, 6), replace=False):
                x[k] = f"r{rng.integers(10**6)}"
            texts.append(" ".join(x))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(86)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root)) and 8 < len(set(root)) < 160


def test_near_duplicates_of_odd_rows(docs, none):
    got = minhash.near_duplicates(docs)
    rows = {(r["doc_id"], r["n_shingles"]): r for r in got.collect()}
    assert got.count() == len(ROWS) and minhash.near_duplicates(none).count() == 0
    assert rows[(0, 0)]["component_id"] == 0 and rows[(4, 1)]["component_id"] == 3 and rows[(6, 26)]["component_id"] == 5
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter(r["doc_id"] for r in left.collect())[5] == 1 and {0, 1, 2, 3} <= {r["doc_id"] for r in left.collect()}
    twice = minhash.drop_near_duplicates(docs.where("doc_id = 6"))
    assert twice.count() == 1


def test_union_estimate_is_exact_for_small_sets():
    a, b = np.arange(10, dtype=np.uint64), np.arange(5, 20, dtype=np.uint64)
    rows = [pa.array([x.view(np.int64).tolist()], pa.list_(pa.int64())) for x in (a, b)]
    shared, size = minhash.union_estimate(*rows)
    assert (shared[0], size[0]) == (5, 20)


# classifier


def auc(score, label):
    return np.mean([(a > b) + 0.5 * (a == b) for a in score[label == 1] for b in score[label == 0]])


def test_classifier(spark, docs, none):
    got = q.op10_quality(spark, SMALL).toPandas()
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").toPandas()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    assert auc(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.9
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got["doc_id"]]).all()
    one = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    net = classifier.fit(docs, one)
    scores = [r["score"] for r in classifier.score(docs, net, keep=("lang",)).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert classifier.score(none, classifier.fit(none, one.limit(0))).count() == 0


def test_every_byte_is_in_a_chunk():
    net = classifier.Net.fresh(1)
    text = "a" * 5000
    changed = [net.scores(pa.array([text[:k] + "Zq!" * 4 + text[k + 12 :]]))[0] != net.scores(pa.array([text]))[0] for k in (0, 370, 2500, 4980)]
    assert all(changed)


def test_training_is_bounded_by_rows_and_bytes(spark):
    rows = [(k, f"text {k} " + "x" * (100 * k), k % 2) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    marked = classifier.candidates(docs, "doc_id", "quality")
    usable = {r[1]: r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    whole = classifier.sampled(docs, marked).collect()
    assert {r["__text"]: r["__label"] for r in whole} == usable and len(whole) == len(usable)
    few = classifier.sampled(docs, marked, max_bytes=9000).collect()
    assert 0 < len(few) < len(whole) and sum(len(r["__text"]) for r in few) <= 9000 and all(r["__text"] in usable for r in few)
    assert classifier.sampled(docs, marked, max_bytes=1).count() == 0
    assert classifier.sampled(docs, marked, max_train=8).count() <= 8


@pytest.mark.parametrize("place", ["first", "middle", "last"])
def test_one_long_text_does_not_end_the_sample(spark, place):
    rows = [(k, ("good prose " if k % 2 else "#### junk ") * (20 + k % 7), k % 2) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    marked = classifier.candidates(docs, "doc_id", "quality")
    hashes = sorted(r["h"] for r in docs.selectExpr("xxhash64(text) AS h").distinct().collect())
    low, high = {"first": (-(1 << 63), hashes[0]), "middle": (hashes[3], hashes[-3]), "last": (hashes[-1], (1 << 63) - 1)}[place]
    tried = spark.range(4000).selectExpr("concat(repeat('long text ', 20000), id) AS t").where((F.xxhash64("t") > low) & (F.xxhash64("t") < high))
    long = tried.first()["t"]
    more = spark.createDataFrame([(*r[:2], r[2]) for r in rows] + [(1000, long, 1)], "doc_id long, text string, quality int")
    assert zlib.crc32(b"1000") % 4 != 2
    everything = classifier.candidates(more, "doc_id", "quality")
    want = {(r[1], r[2]) for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    got = classifier.sampled(more, everything, max_bytes=150_000).collect()
    assert {(r["__text"], r["__label"]) for r in got} == want and len(got) == classifier.sampled(docs, marked).count()
    net = classifier.fit(more, more, max_bytes=150_000)
    scores = {r["doc_id"]: r["score"] for r in classifier.score(more, net).collect()}
    held = [(scores[k], label) for k, _, label in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert auc(np.array([x for x, _ in held]), np.array([y for _, y in held])) > 0.9


def brute_score(net, text):
    """The network in doubles, window by window."""
    embed, filters, bias, out = (x.astype(np.float64) for x in (net.embed, net.filters, net.bias, net.out))
    raw = text.encode()
    chunks = [raw[a : a + classifier.CHUNK] for a in range(0, max(1, len(raw) - classifier.CHUNK + classifier.STEP), classifier.STEP)]
    pooled = []
    for chunk in chunks:
        values = []
        for a in range(0, max(1, len(chunk)), classifier.STRIDE):
            if a + classifier.WIDTH > classifier.CHUNK:
                break
            window = [*chunk[a : a + classifier.WIDTH]]
            window += [256] * (classifier.WIDTH - len(window))
            values.append(np.concatenate([embed[b] for b in window]) @ filters)
        pooled.append(np.maximum(np.max(values, 0) + bias, 0))
    h = np.concatenate([np.max(pooled, 0), np.mean(pooled, 0)])
    return 1 / (1 + np.exp(-(h @ out + net.out_bias)))


def biased(seed):
    net, rng = classifier.Net.fresh(seed), np.random.default_rng(seed)
    net.bias[:] = rng.normal(0.3, 0.5, classifier.FILTERS)
    net.out_bias = 0.2
    return net


def test_scores_by_brute_force():
    net, rng = biased(5), np.random.default_rng(1)
    texts = ["", "a", "abc", "abcd", "x" * 5, "é" * 200] + [bytes(rng.integers(32, 127, n).astype(np.uint8)).decode() for n in (6, 10, 383, 384, 385, 386, 387, 744, 745, 900, 5000)]
    assert np.allclose(net.scores(pa.array(texts)), [brute_score(net, t) for t in texts], atol=1e-5)


def test_padding_has_no_say():
    """A short text scores the same whatever a filter makes of padding alone."""
    net = biased(2)
    net.bias[:] = 3.0
    net.filters[:] = -np.abs(net.filters)
    net.embed[:256] = np.abs(net.embed[:256])
    assert np.allclose(net.pooled(classifier.cut(np.frombuffer(b"abcdefghijkl", np.uint8), np.array([0]), np.array([12])))[0], [
        max(0, max(sum(float(net.embed[b] @ net.filters.reshape(classifier.WIDTH, classifier.EMBED, -1)[j, :, f]) for j, b in enumerate(b"abcdefghijkl"[a : a + 6])) for a in (0, 3, 6, 9)) + 3.0)
        for f in range(classifier.FILTERS)
    ], atol=1e-4)


def test_gradient_by_finite_differences():
    """Against differences of the brute-force loss in doubles, away from the rectifier's corner."""
    net, rng = biased(3), np.random.default_rng(0)
    texts = [rng.integers(32, 127, n).astype(np.uint8) for n in (10, 400, 1500, 900)]
    label = np.array([0, 1, 1, 0], np.float32)
    grads = classifier.gradients(net, texts, label)
    net.embed, net.filters, net.bias, net.out = (x.astype(np.float64) for x in (net.embed, net.filters, net.bias, net.out))

    def loss():
        got = np.array([brute_score(net, x.tobytes().decode()) for x in texts])
        return -np.mean(label * np.log(got) + (1 - label) * np.log(1 - got))

    for g, p in zip(grads, (net.embed, net.filters, net.bias, net.out)):
        flat, step = p.reshape(-1), 1e-6
        for i in np.argsort(-abs(g).reshape(-1))[:5]:
            old = flat[i]
            flat[i] = old + step
            high = loss()
            flat[i] = old - step
            low = loss()
            flat[i] = old
            assert abs((high - low) / (2 * step) - g.reshape(-1)[i]) < 1e-3 * abs(g).max()


# pipeline


def test_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    folder, before = str(tmp_path), spark.read.parquet(f"{SMALL}/documents.parquet")
    outs = []
    for name, stage in p.STAGES:
        stage(spark, before, SMALL).write.parquet(f"{folder}/{name}")
        outs.append(spark.read.parquet(f"{folder}/{name}"))
        before = outs[-1]
    quality, lines, near, clean, packed = outs
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(x.columns == columns for x in outs[:-1])
    views = {"documents": quality.toPandas()}
    sha = [(r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in lines.collect()]
    import duckdb

    con = duckdb.connect()
    con.register("documents", views["documents"])
    assert sorted(sha) == sorted((r[0], r[3]) for r in con.execute(q.OP4_SQL).fetchall())
    con.unregister("documents")
    con.register("documents", lines.toPandas())
    kept = con.execute(q.OP9_SQL.replace("100 * c >= 85", "100 * c >= 80")).df()
    assert {r["doc_id"] for r in near.collect()} == set(kept[kept["kept"]]["doc_id"])
    con.unregister("documents")
    con.register("documents", near.toPandas())
    con.register("benchmark", spark.read.parquet(f"{SMALL}/benchmark.parquet").toPandas())
    bad = set(con.execute(q.OP3_SQL).df()["doc_id"])
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()} - bad
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}
    whole = p.run(spark, SMALL).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, packed.collect()))
