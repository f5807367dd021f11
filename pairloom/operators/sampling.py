"""Seeded orders, exact subsamples, splits, batches and bootstraps, without sorting a table in one task.

A row's place is given by the md5 of seed and id, so draws do not depend on partitions. Ranks come from two
levels: rows are counted by the first hex digits of their hash (a table of fixed size), and only rows of
one such bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits that name a bucket.
DIGITS = 4


def seeded(seed: int | str, *cols: str) -> Column:
    """md5 of seed and columns, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def ranked(df: DataFrame, seed: int | str, by: str = "row_id") -> DataFrame:
    """Adds k: 1, 2, .. in the order of seeded(seed, by), then by."""
    df = df.withColumn("_h", seeded(seed, by)).withColumn("_b", F.substring("_h", 1, DIGITS))
    counts = df.groupBy("_b").agg(F.count("*").alias("_n"))  # 16 ** DIGITS rows at most
    before = counts.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_h", by))
    return df.join(F.broadcast(before), "_b").withColumn("k", F.col("_before") + inside).drop("_h", "_b", "_before")


def first_n(df: DataFrame, n: int, seed: int | str, by: str = "row_id") -> DataFrame:
    """The n rows of df that come first in seeded order; all of them, nothing drawn, if there are no more.

    Only the bucket that the limit falls in is sorted.
    """
    df = df.withColumn("_h", seeded(seed, by)).withColumn("_b", F.substring("_h", 1, DIGITS))
    counts = df.groupBy("_b").agg(F.count("*").alias("_n"))
    upto = counts.select("_b", "_n", F.sum("_n").over(Window.orderBy("_b")).alias("_upto"))
    edge = upto.filter(F.col("_upto") >= n).orderBy("_b").limit(1).select("_b", (n - (F.col("_upto") - F.col("_n"))).alias("_left")).first()
    if edge is None:
        return df.drop("_h", "_b")
    whole = df.filter(F.col("_b") < edge["_b"])
    part = df.filter(F.col("_b") == edge["_b"]).orderBy("_h", by).limit(int(edge["_left"]))
    return whole.unionByName(part).drop("_h", "_b")


def exact_split(rows: DataFrame, seed: int, num: int, den: int) -> DataFrame:
    """(row_id, split): train are the first floor(num * n / den) rows in seeded order, val the rest."""
    n = rows.count() * num // den
    train = first_n(rows.select("row_id"), n, seed).select("row_id", F.lit("train").alias("split"))
    return rows.select("row_id").join(train, "row_id", "left").select("row_id", F.coalesce("split", F.lit("val")).alias("split"))


def paired_subsample(rows: DataFrame, seed: int, n: int | None = None, num: int = 1, den: int = 1) -> DataFrame:
    """The first n rows in seeded order, or floor(num * rows / den) of them; the full set is returned as it is."""
    return rows if n is None and num >= den else first_n(rows, rows.count() * num // den if n is None else n, seed)


def minibatches(rows: DataFrame, seed: int, epoch: int, size: int) -> DataFrame:
    """(row_id, batch, slot): an epoch's order cut into batches of `size`, of all rows if there are fewer; the rest that fills none is left out."""
    n = rows.count()
    size = max(1, min(size, n))
    k = F.col("k") - 1
    out = ranked(rows.select("row_id"), f"{seed}:{epoch}")
    return out.select("row_id", F.floor(k / size).cast("int").alias("batch"), (k % size).cast("int").alias("slot")).filter(F.col("batch") < n // size)


def maybe_weights(rows: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(row_id, w): the weights given, or 1 for each row where reweighting is off."""
    return rows.select("row_id", F.lit(1.0).alias("w")) if weights is None else weights.select("row_id", "w")


def cumulative(weights: DataFrame, buckets: int = 4096) -> DataFrame:
    """(row_id, w, lo, hi): sums of w up to each row by row_id; ranges of row_id are summed first, then rows in each."""
    low, high = weights.agg(F.min("row_id"), F.max("row_id")).first()
    if low is None:
        return weights.select("row_id", "w", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    step = max(1, -(-(high - low + 1) // buckets))
    t = weights.select("row_id", "w", F.floor((F.col("row_id") - low) / step).alias("_b"))
    sums = t.groupBy("_b").agg(F.sum("w").alias("_s"))  # `buckets` rows at most
    before = sums.select("_b", (F.sum("_s").over(Window.orderBy("_b")) - F.col("_s")).alias("_before"))
    hi = F.col("_before") + F.sum("w").over(Window.partitionBy("_b").orderBy("row_id"))
    return t.join(F.broadcast(before), "_b").select("row_id", "w", hi.alias("hi")).select("row_id", "w", (F.col("hi") - F.col("w")).alias("lo"), "hi")


def weighted_draws(weights: DataFrame, draws: int, seed: int) -> DataFrame:
    """(draw, row_id): inverse-CDF sampling with replacement by w; draws find their row by bucketed range join."""
    cdf = cumulative(weights)
    total = cdf.agg(F.max("hi").alias("all"))
    u = F.conv(F.substring(seeded(seed, "id"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    d = weights.sparkSession.range(draws).crossJoin(F.broadcast(total)).select(F.col("id").alias("draw"), (u * F.col("all")).alias("u"))
    b = cdf.select("row_id", "lo", "hi", F.explode(F.sequence(F.floor("lo"), F.floor("hi"))).alias("b"))
    return d.withColumn("b", F.floor("u")).join(b, "b").filter("lo <= u AND u < hi").select("draw", "row_id")


def range_bucket(df: DataFrame, key: Column, buckets: int = 4096) -> Column:
    """A whole number that rises with key (an integer or timestamp in microseconds), about `buckets` of them over df."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    return F.floor((key - F.lit(low or 0)) / F.lit(max(1, -(-((high or 0) - (low or 0) + 1) // buckets))))


def ranked_within(df: DataFrame, by: list[str], order: list, bucket: Column) -> DataFrame:
    """Adds k (1, 2, .. in each group, in `order`) and n (rows of the group); null is a group of its own.

    bucket must rise with the order. Rows are counted by group and bucket, and only those of one bucket are
    sorted together, so a group that holds a third of all rows is not one task's work.
    """
    t = df.withColumn("_b", bucket)
    per = t.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    sums = per.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_b").alias("_k"), (F.sum("_n").over(group.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(group).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order))
    t = t.withColumn("_i", inside)
    match = t["_b"] == sums["_k"]
    for c in by:
        match = match & t[c].eqNullSafe(sums[f"_{c}"])
    return t.join(sums, match).withColumn("k", F.col("_before") + F.col("_i")).select(*df.columns, "k", "n")


def order_statistics(df: DataFrame, value: str, ranks: list[int], few: int = 100_000) -> list[float]:
    """The values of the given ranks (1 is the least; nulls do not count), exact, all of them in two passes.

    The first pass brackets each rank with a mergeable quantile sketch of known rank error; the second counts what is below each bracket and
    what is inside. Brackets of more than `few` rows are bracketed again (a table of billions); others are sorted on the driver.
    """
    t = df.select(F.col(value).alias("v")).filter("v IS NOT NULL")
    out: dict[int, float] = {}
    todo = [(sorted(set(ranks)), 0, None, None)]  # ranks, rows below the range, its ends
    while todo:
        want, below, low, high = todo.pop()
        inside = t if low is None else t.filter(F.col("v").between(low, high))
        accuracy = 20_000
        n = inside.count()
        # the sketch is off by n / accuracy ranks at most; one more on each side for the rounding of shares
        slack = n / accuracy + 1
        shares = [min(1.0, max(0.0, (k - below + d * slack) / n)) for k in want for d in (-1, 1)]
        ends = inside.agg(F.percentile_approx("v", [0.0, *shares, 1.0], accuracy), F.min("v"), F.max("v")).first()
        cuts = [ends[1] if s == 0 else ends[2] if s == 1 else e for s, e in zip(shares, ends[0][1:-1])]
        spans = sorted({(a, b) for a, b in zip(cuts[::2], cuts[1::2])})
        counts = inside.agg(*[F.count_if(F.col("v") < a) for a, _ in spans], *[F.count_if(F.col("v") <= b) for _, b in spans]).first()
        for i, (a, b) in enumerate(spans):
            first, last = below + counts[i], below + counts[len(spans) + i]
            here = [k for k, (x, y) in zip(want, zip(cuts[::2], cuts[1::2])) if (x, y) == (a, b)]
            if a == b:
                out.update(dict.fromkeys(here, a))
            elif last - first <= few or (low, high) == (a, b):
                values = sorted(x["v"] for x in inside.filter(F.col("v").between(a, b)).collect())
                out.update({k: values[k - first - 1] for k in here})
            else:
                todo.append((here, first, a, b))
    return [out[k] for k in ranks]
