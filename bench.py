"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom import catalog
from pairloom.functions.symbols import RESIDUES
from pairloom.plans import pairing
from pairloom.storage import materialize

HEADLINE = ("seq_encode", "weights_hamming", "site_freq", "pair_freq", "pmi", "pair_scores", "coupling_strength", "consensus", "near_dup_pairs", "linear_alignment", "conservation_quartiles", "tail_mean", "nn_distance", "flagship")
#: The published run: rows, species, the largest one, sites of the two halves, known pairs, increment, rounds.
ROWS, SPECIES, LARGEST, WIDTH_A, WIDTH_B, START, INCREMENT, ROUNDS = 3851, 741, 184, 111, 174, 100, 6, 5


def published_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alignment of the published run's size; symbols come from the documents' texts, right halves in part from left ones."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = d.count()
    rows = spark.range(ROWS).select(F.col("id").alias("row_id"), (F.col("id") % n).alias("doc_id")).join(d, "doc_id")
    species = F.when(F.col("row_id") < LARGEST, 0).otherwise(1 + F.col("row_id") % (SPECIES - 1))
    text = F.rpad(F.substring(F.translate("text", " \n.,bjxzuo", ""), 1, WIDTH_A), WIDTH_A, "-")
    left = F.regexp_replace(F.translate(text, RESIDUES.lower(), RESIDUES), f"[^{RESIDUES}]", "-")
    right = F.rpad(F.concat(F.translate(left, RESIDUES[:10], RESIDUES[10:]), F.reverse(left)), WIDTH_B, "-")
    return materialize(rows.select("row_id", species.cast("string").alias("species"), F.concat(left, F.substring(right, 1, WIDTH_B)).alias("seq")), "alignment")


def five_rounds(spark: SparkSession, rows: DataFrame) -> None:
    width = WIDTH_A + WIDTH_B
    start = pairing.draw_start(rows, START, 1)
    pairing.iterate(rows, width, WIDTH_A, INCREMENT, ROUNDS, (15 * width - 1) // 100, 1, start)[1].collect()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    catalog.QUERIES["seq_encode"](spark, sf_dir).count()
    for name in HEADLINE:
        t = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    rows = published_shape(spark, sf_dir)
    t = time.perf_counter()
    five_rounds(spark, rows)
    times["five_rounds_published_shape"] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(os.path.basename(sf_dir.rstrip("/")).lstrip("sf") or 0)}))


if __name__ == "__main__":
    main()
