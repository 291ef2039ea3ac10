"""The thin ``opN_<name>`` queries and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, classifier, decontamination, line_dedup, lm_scoring, minhash, packing, periodic_runs, quality_rules, sharding, source_audit, substring_dedup, token_files
from ._shared import table

#: The folder with the public tokenizers' files; None: the one of the installed module.
TOKENIZERS: str | None = None


def tokenizer_file(name: str) -> str:
    if TOKENIZERS is not None:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shuffle_shards(docs, 16).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = lm_scoring.load_pieces(tokenizer_file("piece_bpe_32k.model"))
    return lm_scoring.score(table(spark, sf_dir, "documents"), pieces)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.document_table(spark, docs, tokenizer_file("word_bpe_49k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.references(docs))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = classifier.fit(docs, table(spark, sf_dir, "labels"))
    return classifier.score(docs, net).select(
        "doc_id",
        classifier.held_out().alias("held_out"),
        "score",
        (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoder = byte_bpe.Encoder.load(tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), encoder)
    back = byte_bpe.decode(ids, encoder, keep=("doc_id", "ids"))
    return back.select("doc_id", byte_bpe.n_ids("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with the words of every tenth document, by a hash of its id, repeated from a place on with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    rows = rows.select("*", F.when(F.size("w") > 0, F.size("w")).alias("n"))  # null where the text stays as it is
    rows = rows.select("*", F.expr("int(g % n)").alias("a"), F.expr("int(1 + (n - g % n) div (3 + g % 8))").alias("p"))
    repeats = "flatten(array_repeat(slice(w, a + 1, p), int((n - a) div p + 1)))"
    changed = F.expr(f"array_join(concat(slice(w, 1, a), slice({repeats}, 1, n - a)), ' ')")
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(periodic_runs.runs_text().cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_packing, op3_decontamination, op4_line_dedup, op5_substring_dedup, op6_lm_scoring, op7_token_files, op8_quality_rules, op9_near_dedup, op10_quality, op11_byte_bpe, op12_periodic_runs, op13_source_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op4_line_dedup": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op9_near_dedup": OP9_SQL, "op13_source_audit": OP13_SQL}


#: Words, shingles and windows by brute force; the best window of each document and item, the first of equals.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), sizes AS (SELECT DISTINCT least(5, len(w)) AS k FROM b WHERE len(w) > 0
), ds AS (
  SELECT doc_id, len(w) AS m, k, p, array_to_string(w[p + 1 : p + k], ' ') AS s
  FROM d, sizes, unnest(range(0, greatest(0, len(w) - k + 1))) AS t(p)
), bs AS (
  SELECT item_id, n, k, s, count(*) AS c
  FROM (SELECT item_id, len(w) AS n, least(5, len(w)) AS k, array_to_string(w[p + 1 : p + least(5, len(w))], ' ') AS s
        FROM b, unnest(range(0, greatest(0, len(w) - least(5, len(w)) + 1))) AS t(p) WHERE len(w) > 0)
  GROUP BY ALL
), hits AS (
  SELECT doc_id, item_id, m, n, ds.k AS k, p, ds.s AS s, c, least(n, m) AS size FROM ds JOIN bs ON ds.s = bs.s AND ds.k = bs.k
), shared AS (
  SELECT doc_id, item_id, n, size, k, ws, s, least(count(*), c) AS n_both
  FROM hits, unnest(range(greatest(0, p - (size - k)), least(p, m - size) + 1)) AS t(ws)
  GROUP BY doc_id, item_id, n, size, k, ws, s, c
), sims AS (
  SELECT doc_id, item_id, ws, size, sum(n_both) / ((n - k + 1) + (size - k + 1) - sum(n_both)) AS sim
  FROM shared GROUP BY doc_id, item_id, ws, size, n, k
)
SELECT doc_id, item_id, CAST(sim AS DOUBLE) AS similarity, CAST(ws AS BIGINT) AS window_start, CAST(size AS BIGINT) AS window_words
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, ws) AS r FROM sims WHERE sim >= 0.8) WHERE r = 1
"""


#: All pairs of lines of like length, of 10 code points or more.  Of 20 or more, one of the line's three segments stands in the other one,
#: or they differ by more than two edits; where the shorter has fewer, one of its two halves does, or they differ by more than one.
OP4_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents
), lines AS (
  SELECT doc_id, i, p[i] AS line FROM parts, unnest(range(1, len(p) + 1)) AS t(i) WHERE regexp_matches(p[i], '[^\x20\x09-\x0D]')
), firsts AS (
  SELECT line, min(struct_pack(d := doc_id, i := i)) AS spot, length(line) AS n FROM lines GROUP BY line
), long AS (
  SELECT *, line[: n // 3] AS s1, line[n // 3 + 1 : 2 * n // 3] AS s2, line[2 * n // 3 + 1 :] AS s3 FROM firsts WHERE n >= 20
), brief AS (
  SELECT *, line[: n // 2] AS s1, line[n // 2 + 1 :] AS s2 FROM firsts WHERE n BETWEEN 10 AND 19
), one AS (
  SELECT a.line AS x, a.spot AS xs, b.line AS y, b.spot AS ys FROM brief a JOIN firsts b ON b.n BETWEEN a.n AND a.n + 1
  WHERE a.line <> b.line AND (contains(b.line, a.s1) OR contains(b.line, a.s2)) AND levenshtein(a.line, b.line) <= 1
), near AS (
  SELECT CASE WHEN xs < ys THEN y ELSE x END AS line FROM one
  UNION
  SELECT DISTINCT b.line FROM long a JOIN long b ON a.n BETWEEN b.n - 2 AND b.n + 2
  WHERE a.spot < b.spot AND (contains(a.line, b.s1) OR contains(a.line, b.s2) OR contains(a.line, b.s3)) AND levenshtein(a.line, b.line) <= 2
), gone AS (
  SELECT doc_id, i FROM lines JOIN firsts USING (line) WHERE struct_pack(d := doc_id, i := i) > spot OR line IN (SELECT line FROM near)
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(m, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(CASE WHEN m IS NULL THEN array_to_string(p, chr(10)) ELSE kept END, '')) AS kept_sha256
FROM parts
LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS m FROM gone GROUP BY doc_id) USING (doc_id)
LEFT JOIN (
  SELECT doc_id, string_agg(p[i], chr(10) ORDER BY i) AS kept FROM parts, unnest(range(1, len(p) + 1)) AS t(i)
  WHERE (doc_id, i) NOT IN (SELECT (doc_id, i) FROM gone) GROUP BY doc_id
) USING (doc_id)
"""


#: Every window of 20 words with its earliest place.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p + 1 : p + 20], ' ') AS s FROM d, unnest(range(0, greatest(0, len(w) - 19))) AS t(p)
), repeats AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, p + k AS i FROM repeats, unnest(range(0, 20)) AS t(k)
), counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, string_agg(w[t.i + 1], ' ' ORDER BY t.i) AS s
  FROM d, unnest(range(0, len(w))) AS t(i) LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.i = t.i WHERE gone.i IS NULL GROUP BY d.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


#: Exact similarities of all documents that share a shingle, and the least id that each reaches.
OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM d, unnest(range(0, greatest(1, len(w) - 4))) AS t(p) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT DISTINCT a, a AS b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON a = doc_id
"""


#: Every kept term for every pair of sources, and for every group and its language.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), uses AS (SELECT lang, source, row, unnest(w) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS n FROM uses GROUP BY ALL HAVING count(DISTINCT row) >= 10
), langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), sources AS (SELECT DISTINCT lang, source FROM d
), counts AS (SELECT lang, source, term, count(*) AS c FROM uses SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM sources LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c, 0) AS c, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 2)) // (s.n + 2 * l.v) AS HUGEINT) AS p,
    CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.n + 2)) // (l.n + 2 * l.v) AS HUGEINT) AS q
  FROM totals s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts x ON x.lang = s.lang AND x.source = s.source AND x.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE c > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 10
"""
