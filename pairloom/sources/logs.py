"""Typed tables of training logs (a line of key=value for each checkpoint), and what is concluded from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.symbols import kv_array, kv_map, kv_scalar

CORRELATION = ("r", "slope", "intercept", "mean_abs_diff", "max_abs_diff")
NORMS = ("mean_norm", "max_norm", "min_norm")
#: Thresholds of the verdicts: strong and partial correlation, live gradient, dead units, gap of train and held-out.
STRONG, PARTIAL, LIVE, DEAD, GAP = 0.8, 0.4, 0.05, 0.05, 0.1


def _checkpoints(lines: DataFrame, **cols: Column) -> DataFrame:
    at = kv_scalar(F.col("line"), "iter").cast("long")
    return lines.filter(F.startswith("line", F.lit("iter="))).select(at.alias("iter"), *[c.alias(k) for k, c in cols.items()])


def _scalars(keys: tuple[str, ...]) -> dict[str, Column]:
    return {k: kv_scalar(F.col("line"), k) for k in keys}


def _arrays(*keys: str) -> dict[str, Column]:
    return {k: kv_array(F.col("line"), k) for k in keys}


def lpl(lines: DataFrame, every: int = 100) -> DataFrame:
    """(iter, value) of numbered lines (row_id, line) with one number each, written every so many iterations."""
    return lines.select((F.col("row_id") * every).alias("iter"), F.col("line").try_cast("double").alias("value"))


def correlation(lines: DataFrame) -> DataFrame:
    return _checkpoints(lines, **_scalars(CORRELATION))


def vh(lines: DataFrame) -> DataFrame:
    return _checkpoints(lines, **_scalars(CORRELATION), **_arrays("mean_h_data", "mean_h_model"))


def norms(lines: DataFrame) -> DataFrame:
    return _checkpoints(lines, **_scalars(NORMS), **_arrays("norms"))


def firing(lines: DataFrame) -> DataFrame:
    return _checkpoints(lines, **_arrays("data_rate", "model_rate"))


def freeze(lines: DataFrame) -> DataFrame:
    """(iter, status, max_before, max_after); null where a map is empty."""
    top = lambda key: F.array_max(F.map_values(kv_map(F.col("line"), key)))
    return _checkpoints(lines, status=F.regexp_extract("line", r"\bstatus=(\S+)", 1), max_before=top("drift_before_reset"), max_after=top("drift_after_reset"))


def final_status(lines: DataFrame) -> DataFrame:
    """(status) of the FINAL line, n/a if there is none."""
    found = F.regexp_extract("line", r"\bstatus=(\S+)", 1)
    return lines.filter(F.startswith("line", F.lit("FINAL"))).agg(F.coalesce(F.max(found), F.lit("n/a")).alias("status"))


def correlation_verdict(r: Column) -> Column:
    """What a held-out correlation of the two halves says; null if there is none."""
    return F.when(r > STRONG, "generalizes").when(r > PARTIAL, "partial").when(r.isNotNull(), "not yet")


def gradient_verdict(norm: Column) -> Column:
    return F.when(norm > LIVE, "live").when(norm.isNotNull(), "died out")


def dead_units(rates: Column) -> Column:
    """How many units are almost always off or on."""
    return F.size(F.filter(rates, lambda x: (x < DEAD) | (x > 1 - DEAD)))


def dead_count(rate: Column) -> Column:
    """dead_units() as an aggregate over rows of one rate each."""
    return F.count_if((rate < DEAD) | (rate > 1 - DEAD))


def gap_verdict(train: Column, heldout: Column) -> Column:
    return F.when(train - heldout > GAP, "overfits").when((train - heldout).isNotNull(), "agrees")


def growth(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, first, last, ratio) of each series; a ratio to 0 is null."""
    at = F.struct(*order)
    g = df.groupBy(*by).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    return g.withColumn("ratio", F.try_divide("last", "first"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(row_id, line) in input order; a log is a small file."""
    w = Window.orderBy("_id")
    return lines.withColumn("_id", F.monotonically_increasing_id()).select(F.row_number().over(w).alias("row_id"), "line")
