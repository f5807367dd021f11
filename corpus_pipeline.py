"""From raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm.common import materialize, table
from pairloom.llm.jaccard_join import keep_one_each
from pairloom.llm.line_dedup import dedup_documents
from pairloom.llm.mixing import mixed_documents
from pairloom.llm.packing import pack
from pairloom.llm.quality import filter_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose posterior quality is high enough. Null and empty texts go; equal texts share one fate; no rows give none."""
    return filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that stand earlier (by doc_id, null first, then text). Null texts stay null; a text may end up empty."""
    return dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (least doc_id, null first, then text) of each group of near duplicates. Texts without words are in no group and stay."""
    return keep_one_each(docs, k=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document, in training order; the last use of a source may be cut. Texts without words are never used; null is a source of its own."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences. Null text counts as empty; repeated and null ids are documents of their own; no rows give none."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: SQL can express neither the expectation maximisation nor the packing; tests/llm has plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; extra columns are carried along up to the last, whatever their names. A table of no rows gives none."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
