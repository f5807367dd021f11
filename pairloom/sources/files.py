"""Readers and writers of the text formats around an alignment. All of them run on executors, and none opens a path itself."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pairloom.functions.symbols import config_tag, is_clean


def read_fasta(spark: SparkSession, path: str, clean: bool = False, species: Callable[[Column], Column] | None = None, full_header: bool = False) -> DataFrame:
    """(row_id, header, seq): header up to white space (or all of it), sequence lines joined; row_id is 1, 2, .. in input order.

    Records, not lines, are the unit of a split. clean: rows with another symbol than a residue or gap are left
    out and keep their number, so ids meet those of split files; rejected() counts them. species: adds a
    column of that name, made from the whole header.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    head = F.substring_index(record, "\n", 1)
    seq = F.regexp_replace(F.substr(record, F.length(head) + 1), r"\s", "")
    whole = F.regexp_replace(head, r"\r$", "")
    name = whole if full_header else F.regexp_extract(head, r"^(\S*)", 1)
    cols = [name.alias("header"), seq.alias("seq")] + ([species(whole).alias("species")] if species else [])
    out = numbered(raw.filter(F.trim("value") != "").select(*cols))
    return out.filter(is_clean(F.col("seq"))) if clean else out


def numbered(df: DataFrame) -> DataFrame:
    """Adds row_id: 1, 2, .. in input order. Partitions are counted first; a row for each of them is broadcast."""
    at = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_id", 33))
    counts = at.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    out = at.join(F.broadcast(before), "_p")
    return out.select((F.col("_before") + F.col("_id") - F.shiftleft("_p", 33) + 1).alias("row_id"), *df.columns)


def rejected(rows: DataFrame) -> DataFrame:
    """(read, kept, rejected) of rows(seq) that were read without `clean`."""
    ok = is_clean(F.col("seq"))
    return rows.agg(F.count("*").alias("read"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("rejected"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, header): header lines only; of several headers in a line the first."""
    lines = spark.read.text(path).filter(F.startswith("value", F.lit(">")))
    return numbered(lines.select(F.trim(F.element_at(F.split(F.expr("substr(value, 2)"), ">"), 1)).alias("header")))


def check_width(rows: DataFrame) -> int:
    """The width that all sequences share; ValueError if they differ."""
    lo, hi = rows.agg(F.min(F.length("seq")), F.max(F.length("seq"))).first()
    if lo != hi:
        raise ValueError(f"sequences are {lo} to {hi} symbols wide")
    return lo or 0


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, split) of a file with two lines of indices, train and then test, parted by spaces or commas."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), "\n")).alias("k", "line"))
    return lines.select(F.explode(F.split(F.trim("line"), r"[\s,]+")).alias("x"), F.when(F.col("k") == 0, "train").otherwise("test").alias("split")).select(F.col("x").try_cast("long").alias("row_id"), "split").filter("row_id IS NOT NULL")


def read_replicates(spark: SparkSession, folder: str) -> DataFrame:
    """(n_start, replicate, iter, tp) of files N<n>_r<k>.txt with one row of tab-separated fractions each."""
    t = spark.read.text(folder).withColumn("f", F.element_at(F.split(F.input_file_name(), "/"), -1))
    t = t.filter(F.col("f").rlike(r"^N\d+_r\d+\.txt$"))
    at = lambda g: F.regexp_extract("f", r"^N(\d+)_r(\d+)\.txt$", g).cast("int")
    return t.select(at(1).alias("n_start"), at(2).alias("replicate"), F.posexplode(F.split("value", "\t")).alias("iter", "x")).select("n_start", "replicate", (F.col("iter") + 1).alias("iter"), F.col("x").try_cast("double").alias("tp"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a log; a missing file is an empty one."""
    try:
        return spark.read.text(path).withColumnRenamed("value", "line")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "line string")


def write_rounds(rounds: DataFrame, predictions: DataFrame, prefix: str) -> None:
    """Two tab-separated tables under prefix: rounds and predictions."""
    for name, df in (("rounds", rounds), ("predictions", predictions)):
        df.write.option("sep", "\t").option("header", True).csv(f"{prefix}/{name}")


def summarise_replicates(reps: DataFrame, iters: int) -> DataFrame:
    """(n_start, n_replicates, 1 .. iters): mean fraction by iteration, wide."""
    wide = reps.groupBy("n_start").pivot("iter", list(range(1, iters + 1))).agg(F.avg("tp"))
    return reps.groupBy("n_start").agg(F.count_distinct("replicate").alias("n_replicates")).join(wide, "n_start")


def write_row(df: DataFrame, order: str, value: str, path: str) -> None:
    """One line of tab-separated values, in order; a single value is a scalar file. For results of a few rows."""
    line = df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("string").alias("_v")))), lambda x: x["_v"]), "\t").alias("value"))
    line.coalesce(1).write.mode("overwrite").text(path)


def write_split(split: DataFrame, path: str, first: str = "train", sep: str = " ") -> None:
    """The two lines that read_split() reads: the ids of `first`, then all others."""
    side = (F.col("split") != first).cast("int")
    lines = split.groupBy(side.alias("_s")).agg(F.array_join(F.array_sort(F.collect_list("row_id")), sep).alias("value"))
    lines.orderBy("_s").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_report(lines: DataFrame, order: str, path: str) -> None:
    """A text report of lines(line), in order, as one file."""
    lines.orderBy(order).select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str, tokens: int = 10) -> DataFrame:
    """(code, k, correct) of the lines of a pairing report that have so many tokens and a whole number as the second."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).filter(F.size("t") == tokens)
    k = F.col("t")[1].try_cast("long")
    return t.select(F.col("t")[0].alias("code"), k.alias("k"), F.col("t")[2].try_cast("long").alias("correct")).filter("k IS NOT NULL")


def cached(spark: SparkSession, folder: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives, kept as Parquet under a tag of its configuration and read from there next time."""
    path = f"{folder}/{config_tag(config)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def find_resumable(spark: SparkSession, folder: str, prefix: str, target: int, glob: str = "*") -> tuple[str, int] | None:
    """(path, iterations) of the furthest file named prefix<iterations>... of at most `target` iterations; of a
    checkpoint, <..>_iter=<iterations>, that number counts. None if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path")  # names only
    name = F.element_at(F.split("path", "/"), -1)
    reached = F.coalesce(F.nullif(F.regexp_extract(name, r"_iter=(\d+)", 1), F.lit("")), F.regexp_extract(name, "^" + re.escape(prefix) + r"(\d+)", 1)).try_cast("long")
    best = files.filter(F.startswith(name, F.lit(prefix))).withColumn("n", reached).filter(F.col("n") <= target).orderBy(F.desc("n"), "path").limit(1).first()
    return None if best is None else (best["path"], best["n"])
