"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import materialize, release


def _print(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 16))).first()


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the least vertex that each vertex of edges(a, b) reaches. Vertices without edges are absent.

    Each round hangs neighbours on the least vertex known; rounds grow with the logarithm of the size.
    Only minima are aggregated, so a hub is as cheap as its edges.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    seen = _print(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        new = materialize(small.filter("u > v").distinct(), "edges")
        now = _print(new)
        release(e)
        e = new
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("v"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("v"), "component").distinct())
