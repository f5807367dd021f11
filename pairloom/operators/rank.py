"""Top cells, overlaps, hits and misses, consensus and quantile buckets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.sampling import order_statistics, range_bucket, ranked_within


def top_share(strength: DataFrame, share: float) -> DataFrame:
    """(i, j, strength, k): the strongest cells, max(1, round half even (share * cells)) of them; ties by j, then i."""
    n = strength.agg(F.greatest(F.lit(1), F.rint(F.lit(share) * F.count("*")).cast("int")).alias("keep"))
    k = F.row_number().over(Window.orderBy(F.desc("strength"), "j", "i"))
    return strength.withColumn("k", k).crossJoin(F.broadcast(n)).filter("k <= keep").drop("keep")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(k, common, share) of two top sets of equal size."""
    both = a.select("i", "j").join(b.select("i", "j"), ["i", "j"]).agg(F.count("*").alias("common"))
    return a.agg(F.count("*").alias("k")).crossJoin(both).select("k", "common", (F.col("common") / F.col("k")).alias("share"))


def top_sweep(model: DataFrame, truth: DataFrame, ceiling: DataFrame, shares: list[float]) -> DataFrame:
    """(cutoff, k, common, share, ratio) for each share of the cells: overlap of model and truth, and over that of truth and ceiling.

    Each matrix is ranked once; its cells are as many as pairs of sites, whatever the number of rows.
    """
    w = Window.orderBy(F.desc("strength"), "j", "i")
    at = lambda df, name: df.select("i", "j", F.row_number().over(w).alias(name))
    cells = at(truth, "t").join(at(model, "m"), ["i", "j"]).join(at(ceiling, "c"), ["i", "j"])
    n = F.greatest(F.lit(1), F.rint(F.col("cutoff") * F.col("n")).cast("int"))
    cuts = truth.agg(F.count("*").alias("n")).select("n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("cutoff")).select("cutoff", n.alias("k"))
    both = lambda a, b: F.count_if((F.col(a) <= F.col("k")) & (F.col(b) <= F.col("k")))
    out = cells.crossJoin(F.broadcast(cuts)).groupBy("cutoff", "k").agg(both("m", "t").alias("common"), both("t", "c").alias("_top"))  # a row for each share is broadcast
    return out.select("cutoff", "k", "common", (F.col("common") / F.col("k")).alias("share"), F.try_divide("common", "_top").alias("ratio"))


def hit_miss(truth: DataFrame, model: DataFrame, cells: DataFrame) -> DataFrame:
    """(i, j, category): 0 background, 1 in both, 2 missed, 3 false alarm."""
    t, m = (x.select("i", "j", F.lit(True).alias(c)) for x, c in ((truth, "t"), (model, "m")))
    c = F.when(F.col("t") & F.col("m"), 1).when(F.col("t"), 2).when(F.col("m"), 3).otherwise(0)
    return cells.select("i", "j").join(t, ["i", "j"], "left").join(m, ["i", "j"], "left").select("i", "j", c.alias("category"))


def consensus(long: DataFrame) -> DataFrame:
    """(pos, code, conservation): the commonest symbol of each site (least code on a tie) and its share."""
    n = long.groupBy("pos", "code").agg(F.count("*").alias("n"))
    best = n.groupBy("pos").agg(F.max(F.struct("n", (-F.col("code")).alias("c"))).alias("best"), F.sum("n").alias("all"))
    return best.select("pos", (-F.col("best.c")).alias("code"), (F.col("best.n") / F.col("all")).alias("conservation"))


def quartiles(df: DataFrame, value: str) -> DataFrame:
    """Adds bucket 1..4: exact linear quartile edges, upper edge included; null values are in bucket 4."""
    n = df.filter(F.col(value).isNotNull()).count()
    at = [q * (n - 1) for q in (0.25, 0.5, 0.75)]
    found = order_statistics(df, value, [math.floor(x) + 1 for x in at] + [math.ceil(x) + 1 for x in at]) if n else []
    edges = [float(a + (b - a) * (x - math.floor(x))) for a, b, x in zip(found[:3], found[3:], at)]
    bucket = F.lit(4)
    for k, e in reversed(list(enumerate(edges, 1))):
        bucket = F.when(F.col(value) <= e, k).otherwise(bucket)
    return df.withColumn("bucket", bucket)


def tail_mean(df: DataFrame, by: str, time: str, key: str, value: str, share: float = 0.2) -> DataFrame:
    """Mean of the last max(1, round half even (share * n)) values of each group, by time (a timestamp), then key."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    ranked = ranked_within(df, [by], [F.desc(time), F.desc(key)], -range_bucket(df, at))
    return ranked.filter(F.col("k") <= F.greatest(F.lit(1.0), F.rint(share * F.col("n")))).groupBy(by).agg(F.avg(value).alias("tail_mean"), F.count("*").alias("used"))


def best_median_worst(df: DataFrame, value: str, key: str) -> DataFrame:
    """(which, key): the rows of least and largest value and that of rank ceil(n / 2), by value, then key (integers)."""
    t = df.select(value, key).filter(F.col(value).isNotNull())
    n = t.count()
    ranks = {"worst": 1, "median": (n + 1) // 2, "best": n}
    rows = []
    for which, v in zip(ranks, order_statistics(t, value, list(ranks.values())) if n else []):
        below = t.filter(F.col(value) < v).count()
        rows.append((which, order_statistics(t.filter(F.col(value) == v), key, [ranks[which] - below])[0]))
    return df.sparkSession.createDataFrame(rows, f"which string, {key} long")


def kth_largest(strength: DataFrame, k: int) -> DataFrame:
    """(k, threshold): the k-th largest strength."""
    top = strength.orderBy(F.desc("strength"), "j", "i").limit(k)
    return top.agg(F.count("*").alias("k"), F.min("strength").alias("threshold"))


def ends(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first and the last n rows in an order, with `end` (head or tail); rows of a short table are in both."""
    back = [F.desc(c) if isinstance(c, str) else c for c in order]
    return df.orderBy(*order).limit(n).withColumn("end", F.lit("head")).unionByName(df.orderBy(*back).limit(n).withColumn("end", F.lit("tail")))
