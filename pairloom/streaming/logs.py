"""Training logs as a stream: lines are parsed as they arrive and averaged by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.symbols import kv_scalar


def windowed_metric(lines: DataFrame, key: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, n, mean) of key=value in lines (ts, line); lines later than `late` are dropped with their window's state."""
    parsed = lines.select("ts", kv_scalar(F.col("line"), key).alias("x")).filter("x IS NOT NULL")
    g = parsed.withWatermark("ts", late) if lines.isStreaming else parsed
    return g.groupBy(F.window("ts", window)).agg(F.count("*").alias("n"), F.avg("x").alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")
