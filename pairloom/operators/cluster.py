"""Components of similar rows and splits that keep them whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import symbols as S
from pairloom.operators.stats import similar_pairs
from pairloom.storage import materialize, release


def _table(df: DataFrame) -> DataFrame:
    return materialize(df, "cluster")


#: Nodes that a task joins at a time; with more, it gives out what it has and begins anew.
HELD = 500_000


def _forest(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: each partition's edges replaced by stars around the least node that it joins, by union-find. No more rows than edges."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def stars() -> pa.RecordBatch:
            part = [x for x in up if up[x] != x]
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])

        for b in batches:
            for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > HELD:
                yield stars()
                up.clear()
        yield stars()

    return edges.select("u", "v").mapInArrow(go, "u long, v long")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component) for nodes(v): least node reachable over edges(a, b). Null ends join nothing.

    Each partition first joins its own edges, so only a forest of them is shuffled; then neighbours are hung on the least node
    known, large ones and small ones in turn, and partitions join theirs again, until nothing changes. Rounds
    grow with the logarithm of the longest path, and a hub is as cheap as its edges.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    e = _table(_forest(e).distinct())
    seen = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 16))).first()
        if now == seen:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        new = _table(_forest(small.filter("u > v")).distinct())
        release(e)
        e = new
    return nodes.select("v").join(e.select(F.col("u").alias("v"), F.col("v").alias("component")), "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def similar_components(rows: DataFrame, width: int, most: int) -> DataFrame:
    """(row_id, component): least row_id among rows joined by sequences that differ at `most` sites or fewer."""
    first = rows.groupBy("seq").agg(F.min("row_id").alias("v"))
    pairs = similar_pairs(rows, width, most)
    edges = pairs.join(first.select(F.col("seq").alias("a"), F.col("v").alias("va")), "a").join(first.select(F.col("seq").alias("b"), F.col("v").alias("vb")), "b")
    comp = components(first.select("v"), edges.select(F.col("va").alias("a"), F.col("vb").alias("b")))
    return rows.join(first, "seq").join(comp, "v").select("row_id", "component")


def leakage_components(rows: DataFrame, width: int, most: int) -> DataFrame:
    """similar_components() joined further where they share a species; null and placeholder species join nothing."""
    comp = _table(similar_components(rows, width, most))
    held = rows.filter(~S.is_placeholder(F.col("species"))).join(comp, "row_id").select("species", F.col("component").alias("a")).distinct()
    edges = held.join(held.groupBy("species").agg(F.min("a").alias("b")), "species").filter("a <> b").select("a", "b")
    joined = components(comp.select(F.col("component").alias("v")).distinct(), edges)
    return comp.withColumnRenamed("component", "v").join(joined, "v").select("row_id", "component")


def _slot(a, t: int, v: int, ht, hv, nb, size):
    """Place of train's slot a (from 0) when slots of both sides are merged by how full the side is, train first."""
    before = ((ht + a * size) * v - hv * t + size * t - 1) // (size * t)
    return a + min(max(before, 0), nb)


def grouped_split(rows: DataFrame, comp: DataFrame, train: int, val: int) -> DataFrame:
    """(row_id, split) that keeps components whole: largest first, to the emptier of train and val in proportion.

    A side takes components, whatever their size, until it has reached its target; with both reached, the rest
    is unused. Components of one size fill slots of the two sides in turn, so the driver only sees how
    many there are of each size (the root of twice the rows at most), and where each side then stands.
    """
    sizes = comp.groupBy("component").count()
    plan, ht, hv = [], 0, 0
    for size, many in sizes.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).collect():
        na, nb = max(0, -(-(train - ht) // size)), max(0, -(-(val - hv) // size))
        m, lo, hi = min(many, na + nb), 0, na
        while lo < hi:  # train's slots among the first m
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if _slot(mid, train, val, ht, hv, nb, size) < m else (lo, mid)
        plan.append((size, ht, hv, na, nb))
        ht, hv = ht + lo * size, hv + (m - lo) * size
    plan = rows.sparkSession.createDataFrame(plan, "count long, ht long, hv long, na long, nb long")
    slots = _place(sizes).join(F.broadcast(plan), "count")
    side = F.when(F.col("k") >= F.col("na") + F.col("nb"), "unused").when(_is_train(train, val), "train").otherwise("val")
    return comp.join(slots.select("component", side.alias("split")), "component").select("row_id", "split")


def _is_train(t: int, v: int):
    """Whether place k is one of train's slots: the inverse of _slot is tried around its straight line and at both ends."""
    line = F.floor((F.col("k") + (F.col("hv") * t - F.col("ht") * v) / (F.col("count") * t)) / (1 + v / t)) if t else F.lit(0)
    tries = [line + d for d in (-2, -1, 0, 1, 2)] + [F.col("k"), F.col("k") - F.col("nb")]

    def hit(a):
        before = F.ceil(((F.col("ht") + a * F.col("count")) * v - F.col("hv") * t) / (F.col("count") * max(1, t)))
        return (a >= 0) & (a < F.col("na")) & (a + F.least(F.greatest(before, F.lit(0)), F.col("nb")) == F.col("k"))

    out = F.lit(False)
    for a in tries:
        out = out | hit(a)
    return out


def _place(sizes: DataFrame) -> DataFrame:
    """Adds k, the rank (from 0) of each component among those of its size; ranges of names are counted first."""
    low, high = sizes.agg(F.min("component"), F.max("component")).first()
    step = max(1, -(-((high or 0) - (low or 0) + 1) // 4096))
    t = sizes.withColumn("_r", F.floor((F.col("component") - (low or 0)) / step))
    per = t.groupBy("count", "_r").agg(F.count("*").alias("_n"))
    before = per.select("count", "_r", (F.sum("_n").over(Window.partitionBy("count").orderBy("_r")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("count", "_r").orderBy("component"))
    return t.withColumn("_k", rank).join(before, ["count", "_r"]).select("component", "count", (F.col("_before") + F.col("_k") - 1).alias("k"))
