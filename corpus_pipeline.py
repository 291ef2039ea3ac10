"""The corpus pipeline: stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read
again before the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm import classifier, decontamination, line_dedup, minhash, packing
from meshlake.llm._shared import fresh, quoted, settled, table

#: Per cent of shared shingles from which documents are near copies.
NEAR = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    return classifier.good(docs, classifier.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand earlier; ``n_chars``, where there is one, follows the text.

    Null and empty texts, and documents of which no line is left, stay.  Of rows equal in id
    and text all keep the same lines.  Other columns come through, whatever their names.
    """
    own = {c: fresh(docs, f"__{c}") for c in ("n_lines", "n_removed") if c in docs.columns}
    left = line_dedup.dedup_lines(docs.withColumnsRenamed(own))
    out = dict(zip(docs.columns, quoted([own.get(c, c) for c in docs.columns])))
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.select(*[x.alias(c) for c, x in out.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.drop_near_duplicates(docs, NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Not expressible in SQL (a trained network, a packing by turns); tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each result but the last is kept as Parquet and read again, and what else a stage kept is deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
