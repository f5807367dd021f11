"""Weights, frequencies, mutual information, correlations and scores over the long form (row_id, pos, code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.symbols import STATES, codes
from pairloom.operators.hamming import masked, masked_pairs, near, near_counts
from pairloom.storage import materialize


def long_form(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select("row_id", *keep, F.posexplode(codes(F.col("seq"))).alias("pos", "code")).withColumn("pos", F.col("pos") + 1)


def similar_pairs(rows: DataFrame, width: int, most: int) -> DataFrame:
    """(a, b, d): distinct sequences, a < b, that differ at `most` sites or fewer. Sequences have one width; null ones are like none."""
    seqs = materialize(rows.select("seq").filter("seq IS NOT NULL").distinct(), "sequences")  # read four times
    return masked_pairs(seqs, width, most) if masked(width, most) else near(seqs, seqs, width, most, once=True)


def sequence_weights(rows: DataFrame, width: int, most: int) -> DataFrame:
    """(row_id, w): one over the number of rows, itself included, that differ at `most` sites or fewer."""
    n = rows.groupBy("seq").agg(F.count("*").alias("n"))
    if masked(width, most):
        counts = near_counts(n.filter("seq IS NOT NULL").withColumnRenamed("n", "c"), width, most)
        return rows.join(counts.select("seq", (1.0 / F.col("n")).alias("w")), "seq").select("row_id", "w")
    p = similar_pairs(rows, width, most)
    sides = p.select(F.col("a").alias("seq"), F.col("b").alias("o")).unionByName(p.select(F.col("b").alias("seq"), F.col("a").alias("o")))
    more = sides.join(n.withColumnRenamed("seq", "o"), "o").groupBy("seq").agg(F.sum("n").alias("more"))
    w = n.join(more, "seq", "left").select("seq", (1.0 / (F.col("n") + F.coalesce("more", F.lit(0)))).alias("w"))
    return rows.join(w, "seq").select("row_id", "w")


def site_freq(long: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(pos, code, f) of observed cells."""
    src = long.withColumn("w", F.lit(1.0)) if weights is None else long.join(weights, "row_id")
    f = src.groupBy("pos", "code").agg(F.sum("w").alias("s"))
    return f.join(f.groupBy("pos").agg(F.sum("s").alias("all")), "pos").select("pos", "code", (F.col("s") / F.col("all")).alias("f"))


def pair_freq(long: DataFrame, width_a: int, weights: DataFrame | None = None) -> DataFrame:
    """(i, j, a, b, f): i in the left block, j in the right one."""
    src = long.withColumn("w", F.lit(1.0)) if weights is None else long.join(weights, "row_id")
    left = src.filter(F.col("pos") <= width_a).select("row_id", "w", F.col("pos").alias("i"), F.col("code").alias("a"))
    right = src.filter(F.col("pos") > width_a).select("row_id", F.col("pos").alias("j"), F.col("code").alias("b"))
    f = left.join(right, "row_id").groupBy("i", "j", "a", "b").agg(F.sum("w").alias("s"))
    return f.join(f.groupBy("i", "j").agg(F.sum("s").alias("all")), ["i", "j"]).select("i", "j", "a", "b", (F.col("s") / F.col("all")).alias("f"))


def _grid(spark, width: int, width_a: int, first: int) -> DataFrame:
    """All cells (i, j, a, b): a fixed domain, whatever the data."""
    seq = lambda x, y: F.explode(F.sequence(F.lit(x), F.lit(y)))
    d = spark.range(1).select(seq(1, width_a).alias("i")).select("i", seq(width_a + 1, width).alias("j"))
    return d.select("i", "j", seq(first, STATES).alias("a")).select("i", "j", "a", seq(first, STATES).alias("b"))


def complete(long: DataFrame, width: int, width_a: int, weights: DataFrame | None = None, first: int = 1) -> DataFrame:
    """(i, j, a, b, fab, fa, fb) over the whole domain, unseen cells 0."""
    one, two = site_freq(long, weights), pair_freq(long, width_a, weights)
    g = _grid(long.sparkSession, width, width_a, first).join(two, ["i", "j", "a", "b"], "left")
    g = g.join(one.select(F.col("pos").alias("i"), F.col("code").alias("a"), F.col("f").alias("fa")), ["i", "a"], "left")
    g = g.join(one.select(F.col("pos").alias("j"), F.col("code").alias("b"), F.col("f").alias("fb")), ["j", "b"], "left")
    zero = F.lit(0.0)
    return g.select("i", "j", "a", "b", F.coalesce("f", zero).alias("fab"), F.coalesce("fa", zero).alias("fa"), F.coalesce("fb", zero).alias("fb"))


def pmi(long: DataFrame, width: int, width_a: int, weights: DataFrame | None = None, pseudo: float = 0.15) -> DataFrame:
    """(i, j, a, b, pmi) of residue states: log of joint over marginals, both with pseudocounts."""
    q = float(STATES)
    mixed = lambda f, k: (1 - pseudo) * F.col(f) + pseudo / k
    c = complete(long, width, width_a, weights, first=2)
    return c.select("i", "j", "a", "b", F.log(mixed("fab", q * q) / (mixed("fa", q) * mixed("fb", q))).alias("pmi"))


def pmi_counts(long: DataFrame, width: int, width_a: int, n: int, pc: float = 0.01) -> DataFrame:
    """(i, j, a, b, pmi) of all states: the variant with count pseudocounts and a renormalised joint."""
    q = float(STATES)
    c = complete(long, width, width_a)
    one = lambda f: (F.col(f) * n + pc) / (n + pc * q)
    joint = (F.col("fab") + pc / (q * q)) / (1 + pc)
    return c.select("i", "j", "a", "b", F.log(joint / (one("fa") * one("fb")) + 1e-12).alias("pmi"))


def connected_corr(long: DataFrame, width: int, width_a: int) -> DataFrame:
    return complete(long, width, width_a).select("i", "j", "a", "b", (F.col("fab") - F.col("fa") * F.col("fb")).alias("c"))


def coupling_strength(corr: DataFrame) -> DataFrame:
    return corr.groupBy("i", "j").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("strength"))


def pair_scores(rows: DataFrame, table: DataFrame, width_a: int) -> DataFrame:
    """(species, hk, rr, score) of all left and right halves of a group.

    A score depends on the two half sequences only, so each distinct pair of halves of a species is
    scored once; gap cells, which the table lacks, add 0.
    """
    width = F.length("seq")
    half = rows.select("species", "row_id", F.substring("seq", 1, width_a).alias("l"), F.expr(f"substring(seq, {width_a + 1})").alias("r"))
    ls = half.groupBy("species", "l").agg(F.collect_list("row_id").alias("hk"))
    rs = half.groupBy("species", "r").agg(F.collect_list("row_id").alias("rr"))
    halves = ls.select("species", "l").join(rs.select("species", "r"), "species").select("l", "r").distinct()
    cell = halves.select("l", "r", F.posexplode(codes(F.col("l"))).alias("i", "a")).withColumn("i", F.col("i") + 1)
    cell = cell.select("l", "r", "i", "a", F.posexplode(codes(F.col("r"))).alias("j", "b")).withColumn("j", F.col("j") + width_a + 1)
    score = cell.join(table, ["i", "j", "a", "b"], "left").groupBy("l", "r").agg(F.sum(F.coalesce("pmi", F.lit(0.0))).alias("score"))
    pairs = ls.join(rs, "species").join(score, ["l", "r"])
    return pairs.select("species", F.explode("hk").alias("hk"), "rr", "score").select("species", "hk", F.explode("rr").alias("rr"), "score")


def safe_r(x: str, y: str) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def linear_alignment(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Per group: r, slope and intercept of y on x, and the mean and largest absolute difference."""
    d = F.abs(F.col(x) - F.col(y))
    return df.groupBy(*by).agg(safe_r(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(d).alias("mean_diff"), F.max(d).alias("max_diff"))


def site_pairs_corr(long: DataFrame, width: int) -> DataFrame:
    """(i, j, a, b, c): connected correlations of all ordered pairs of sites, each with itself too, over all states."""
    n = long.agg(F.count_distinct("row_id").cast("double").alias("n"))
    one = long.groupBy("pos", "code").agg(F.count("*").alias("k"))
    x, y = long.select("row_id", F.col("pos").alias("i"), F.col("code").alias("a")), long.select("row_id", F.col("pos").alias("j"), F.col("code").alias("b"))
    two = x.join(y, "row_id").groupBy("i", "j", "a", "b").agg(F.count("*").alias("kab"))
    seq = lambda hi: F.explode(F.sequence(F.lit(1), F.lit(hi)))
    grid = long.sparkSession.range(1).select(seq(width).alias("i")).select("i", seq(width).alias("j")).select("i", "j", seq(STATES).alias("a")).select("i", "j", "a", seq(STATES).alias("b"))
    g = grid.join(two, ["i", "j", "a", "b"], "left")
    g = g.join(one.select(F.col("pos").alias("i"), F.col("code").alias("a"), F.col("k").alias("ka")), ["i", "a"], "left")
    g = g.join(one.select(F.col("pos").alias("j"), F.col("code").alias("b"), F.col("k").alias("kb")), ["j", "b"], "left").crossJoin(F.broadcast(n))
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("n")
    return g.select("i", "j", "a", "b", (share("kab") - share("ka") * share("kb")).alias("c"))


def zero_diagonal(matrix: DataFrame, value: str) -> DataFrame:
    """(i, j, value) with 0 where i = j."""
    return matrix.withColumn(value, F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col(value)))


def off_diagonal(matrix: DataFrame) -> DataFrame:
    """Cells of different sites only."""
    return matrix.filter("i <> j")


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, cov, r) of each pair of columns above the diagonal, in one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    cell = lambda a, b: F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.covar_samp(a, b).alias("cov"), safe_r(a, b).alias("r"))
    return df.agg(F.array(*[cell(a, b) for a, b in pairs]).alias("c")).select(F.inline("c"))


def species_weight(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(species, k, weight, per_row): effective rows of each species and their mean weight."""
    g = rows.select("row_id", "species").join(weights, "row_id").groupBy("species").agg(F.count("*").alias("k"), F.sum("w").alias("weight"))
    return g.withColumn("per_row", F.col("weight") / F.col("k"))


def firing_rate(hidden: DataFrame, least: float = 0.0) -> DataFrame:
    """(unit, rate): share of rows in which a unit is above `least`."""
    return hidden.groupBy("unit").agg(F.avg((F.col("h") > least).cast("double")).alias("rate"))
