"""Shared plumbing of the corpus operators: tables, shared storage, row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.storage import materialize, release, setting, shared_dir

__all__ = ["SPACE", "WORD", "arrow_batches", "boxed", "keyed", "materialize", "release", "setting", "shared_dir", "table", "unboxed"]

#: A word: a maximal run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Separator of words (the complement of WORD's class).
SPACE = r"[\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_batches(spark: SparkSession, mb: int = 2, rows: int = 2000) -> None:
    """Bounds Arrow batches by bytes as well as rows, so that Python workers hold little."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def keyed(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(rid, doc_id, text, *extra): rid is unique and ascends with doc_id (nulls first).

    doc_id must be an integer column. Where it is unique and not null it serves as rid at no cost. Else rows
    are range-sorted and numbered once: repeated and null ids then stand for separate documents, in order
    of their text. docs that have a rid come back as they are; callers select doc_id and text of others' tables first.
    """
    if "rid" in docs.columns:
        return docs
    kind = docs.schema["doc_id"].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"doc_id must be an integer column, not {kind}; number the rows first")
    cols = ["doc_id", "text", *(extra or [])]
    slim = docs.select(*cols)
    clash = slim.select("doc_id").groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").limit(1).count()
    if not clash:
        return slim.withColumn("rid", F.col("doc_id").cast("long"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ordered = slim.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(ordered.withColumn("rid", F.monotonically_increasing_id()), "keyed")


def named(column: str) -> Column:
    """A column of that very name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def boxed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): all other columns in one struct, by number, so that their names meet none of ours."""
    others = [named(c).alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("filler")).alias("rest"))


def in_box(names: list[str], column: str) -> Column:
    return F.col("rest").getField(f"c{names.index(column)}")


def unboxed(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns of docs again, in their order; `changed` replaces some that exist."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return df.select(*[(changed[c] if c in changed else own[c] if c in own else in_box(names, c)).alias(c) for c in names])
