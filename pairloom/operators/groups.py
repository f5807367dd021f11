"""Grouping, dedup and labelling of rows (row_id, species, seq); row_id orders everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.sampling import range_bucket, ranked_within


def species_groups(rows: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """(species, n, first): groups of least..most rows; null species belong to none."""
    g = rows.filter("species IS NOT NULL").groupBy("species").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    return g.filter(F.col("n") >= least) if most is None else g.filter(F.col("n").between(least, most))


def dedup_first(rows: DataFrame, within: list[str]) -> DataFrame:
    """Rows of least row_id for each value of `within`: a minimum, not a sort, so a hot value is summed first."""
    keep = rows.groupBy(*within).agg(F.min("row_id").alias("row_id"))
    return rows.join(keep.select("row_id"), "row_id", "left_semi")


def complement(rows: DataFrame, kept: DataFrame) -> DataFrame:
    return rows.join(kept.select("row_id"), "row_id", "left_anti")


def drop_largest(rows: DataFrame) -> DataFrame:
    """Without the largest group; of equal ones the first to appear goes."""
    top = species_groups(rows, 1).orderBy(F.desc("n"), "first").limit(1).select("species")
    return rows.join(top, "species", "left_anti")


def label_top_groups(rows: DataFrame, n: int, other: str = "other") -> DataFrame:
    """Adds label: the species if it is among the n largest, else `other`."""
    top = species_groups(rows, 1).orderBy(F.desc("n"), "first").limit(n).select("species", F.col("species").alias("label"))
    return rows.join(F.broadcast(top), "species", "left").withColumn("label", F.coalesce("label", F.lit(other)))


def partition_groups(rows: DataFrame, inside: str) -> DataFrame:
    """(species, side): all inside, all outside or straddling, by the boolean column `inside`."""
    every, none = F.bool_and(inside), F.bool_and(~F.col(inside))
    side = F.when(every, "inside").when(none, "outside").otherwise("straddling")
    return rows.groupBy("species").agg(side.alias("side"))


def shift_partner(rows: DataFrame) -> DataFrame:
    """(row_id, partner): each row's predecessor in its group, cyclic: the wrong-partner control."""
    r = ranked_within(rows.select("species", "row_id"), ["species"], ["row_id"], range_bucket(rows, F.col("row_id")))
    before = r.select(F.col("species").alias("s"), F.col("row_id").alias("partner"), (F.col("k") % F.col("n") + 1).alias("next"))
    return r.join(before, r.species.eqNullSafe(before.s) & (r.k == before.next)).select("row_id", "partner")


def scramble_pairs(rows: DataFrame, seed: int) -> DataFrame:
    """(species, hk, rr): a seeded random pairing inside each group; rows without a species have no partner."""
    named = rows.filter("species IS NOT NULL").select("species", "row_id")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("b"), F.col("row_id").cast("string")))
    a = ranked_within(named, ["species"], ["row_id"], range_bucket(named, F.col("row_id"))).select("species", F.col("row_id").alias("hk"), "k")
    b = ranked_within(named.withColumn("h", h), ["species"], ["h", "row_id"], F.conv(F.substring(h, 1, 3), 16, 10).cast("long")).select("species", F.col("row_id").alias("rr"), "k")
    return a.join(b, ["species", "k"]).select("species", "hk", "rr")


def species_split(rows: DataFrame, seed: int, target: int) -> DataFrame:
    """(species, n, split): whole groups in seeded order while that comes closer to `target` rows, then no more."""
    g = rows.groupBy("species").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("species"))), "species").rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("upto", F.sum("n").over(w))
    closer = F.abs(F.col("upto") - target) < F.abs(F.col("upto") - F.col("n") - target)
    g = g.withColumn("taken", F.min(F.when(closer, 1).otherwise(0)).over(w))
    return g.select("species", "n", F.when(F.col("taken") == 1, "train").otherwise("test").alias("split"))


def species_groups_counted(rows: DataFrame, placeholder: Column, least: int = 2) -> DataFrame:
    """(why, rows): what becomes of each row: no species, placeholder, small group, or kept."""
    n = rows.groupBy("species").agg(F.count("*").alias("n"))
    why = F.when(F.col("species").isNull(), "no species").when(placeholder, "placeholder").when(F.col("n") < least, "small group").otherwise("kept")
    return n.withColumn("why", why).groupBy("why").agg(F.sum("n").alias("rows"))


def union_of_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(row_id), each once, of the groups named in groups(species)."""
    return rows.join(groups.select("species").distinct(), "species", "left_semi").select("row_id").distinct()


def order_by_size(rows: DataFrame, seed: int) -> DataFrame:
    """(species, n, k): the largest first, equal ones in seeded order."""
    g = rows.groupBy("species").agg(F.count("*").alias("n"))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("species").cast("string")))
    return g.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), h, "species")))


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with `found`, whether right has its key: the row's id there is row_id of right, null for a miss."""
    first = right.groupBy(key).agg(F.min("row_id").alias("found_row"))
    return left.join(first, key, "left").withColumn("found", F.col("found_row").isNotNull())
