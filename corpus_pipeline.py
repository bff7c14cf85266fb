"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes what its predecessor kept and returns the columns of
``documents``; the last returns one row for each packed piece, and with the
first piece of each training sequence its ids.

A null or empty text goes in the quality rules (no words), as does any with
fewer than 50.  Rows with a null id are judged, but take no part in the search
for near duplicates and stay.  Where an id occurs several times, each row is
judged by its own text; of repeated rows one stays.  A very long text is one row of
work in each stage.  An empty table gives an empty one.  Extra columns stay as they
are up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgauge.llm.common import table, written
from quillgauge.llm.neardup import deduplicated
from quillgauge.llm.ordinal import fit, selected
from quillgauge.llm.packing import pieces_with_sequences, sequences
from quillgauge.llm.rules import kept_by_rules
from quillgauge.llm.secrets import redacted


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the graded classifier selects; it learns from the labelled ones among them."""
    return selected(docs, fit(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base counts and the likelihood ratio of trusted to raw documents."""
    return kept_by_rules(docs, table(spark, sf_dir, "labels"), shrunk=True, corpus=table(spark, sf_dir, "documents"))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id."""
    return deduplicated(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by the name of its kind, and counts the characters anew."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; one row for each piece, the first of a sequence with the sequence's padded ids."""
    return pieces_with_sequences(sequences(docs, "byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicate_removal),
    ("secret scans", secret_redaction),
    ("packing", packing),
]

#: Bytes of a row group between stages: each task that reads a stage's texts holds one.
ROW_GROUP_BYTES = 16 << 20

#: Training, sketches and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}", ROW_GROUP_BYTES)
    return docs
