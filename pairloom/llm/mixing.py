"""Mixing sources to target weights over a curriculum (operator 1). DataFrame functions only.

Each source's weight changes over training time t in [0, 1] along a piecewise linear schedule. Its
integral up to t is the source's token demand so far. A source's documents queue in hash order and
repeat in passes; a document's training position is the t at which demand reaches its place in the
queue. Rows are then range-sorted by position. Places in the queue come from a two-level prefix sum,
(source, bucket) and then within a bucket, so that no task holds a large source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import WORD, boxed, in_box, materialize, unboxed

#: Base weights of the sources in code point order (null last), repeating.
BASE_WEIGHTS = (5.0, 2.0, 1.0)
#: Curriculum profiles, repeating like the weights: (t, factor) knots whose integral over [0, 1] is 1.
PROFILES = (
    ((0.0, 1.4), (1.0, 0.6)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def _literal(xs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def _cumulative(knots: Sequence[tuple[float, float]]) -> list[float]:
    """The schedule's integral at each knot, scaled to end at 1."""
    area = [0.0]
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        area.append(area[-1] + (t1 - t0) * (a + b) / 2)
    return [x / area[-1] for x in area]


def pieces(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(t0, weight, slope, share before, share after) of each piece of a schedule, scaled so that shares end at 1."""
    cum = _cumulative(knots)
    scale = 1 / sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:]))
    return [(t0, a * scale, (b - a) * scale / (t1 - t0), cum[k], cum[k + 1]) for k, ((t0, a), (t1, b)) in enumerate(zip(knots, knots[1:]))]


def position_at(share: Column, profile: Column, profiles=PROFILES) -> Column:
    """Training time at which a source on its profile has used `share` of its demand."""
    out = F.lit(None).cast("double")
    for i, knots in enumerate(profiles):
        at = F.lit(1.0)
        for t0, a, slope, low, high in reversed(pieces(knots)):
            rest = F.greatest(share - F.lit(low), F.lit(0.0))
            # rest = a x + slope x^2 / 2, in the form that stays stable as slope goes to 0
            x = 2 * rest / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0))))
            at = F.when(share < F.lit(high), F.lit(t0) + x).otherwise(at)
        out = F.when(profile == i, F.least(at, F.lit(1.0))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float, profiles: int = len(PROFILES)) -> DataFrame:
    """(source, source_size, target, profile): shares of all tokens by weight, none above cap times its size.

    The excess of capped sources goes to the others by weight until none is above: with sources in
    order of cap / weight, the first source whose cap exceeds the level of those from it on sets it.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("per_weight", "rank")
    every = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = _literal(weights)
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("rank", F.row_number().over(by) - 1)
    t = t.withColumn("weight", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("profile", F.col("rank") % profiles)
    t = t.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("per_weight", F.col("most") / F.col("weight"))
    t = t.withColumn("total", F.sum("source_size").over(every))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    t = t.withColumn("level", F.max(F.when(F.col("per_weight") >= F.col("level"), F.col("level"))).over(every))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return t.select("source", "source_size", target.cast("double").alias("target"), "profile")


def mix(docs: DataFrame, weights: Sequence[float] = BASE_WEIGHTS, cap: float = 3.0, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs, by training position of its first use.

    doc_id, source, size, source_size, target, taken (words used, all passes), passes and positions
    (arrays: words used in each pass, and when), position (of the first pass; null if unused). size counts words; null text has none. Null
    source: a source of its own, last. A pass ends inside a document where the target falls there.
    Repeated rows take turns. Null doc_ids are documents of their own, which queue by their text. Empty
    texts are never used; empty docs give no rows. `keep` names more columns to carry along; they break ties.
    """
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # rows without an id queue by their text, so that they share no key
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))))
    turn = F.conv(F.substring(F.md5(F.concat(F.lit("turn:"), name)), 1, 15), 16, 10).cast("long")
    sizes = materialize(docs.select("doc_id", "source", *keep, n.alias("size"), turn.alias("turn"), F.xxhash64("text").alias("tie")), "sizes")
    buckets = max(1, math.isqrt(sizes.count()))
    sizes = sizes.withColumn("bucket", F.pmod(F.col("turn"), F.lit(buckets)))
    per = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    targets = source_targets(per, weights, cap)
    lead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        per.withColumn("lead", F.coalesce(F.sum("size").over(lead), F.lit(0)))
        .alias("p")
        .join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
        .select("p.source", "p.bucket", "p.lead", "t.source_size", "t.target", "t.profile")
    )
    starts = materialize(starts, "starts")
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "tie", *keep).rowsBetween(Window.unboundedPreceding, -1)
    queue = sizes.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("q")
    rows = queue.join(starts.alias("s"), F.col("q.source").eqNullSafe(F.col("s.source")) & (F.col("q.bucket") == F.col("s.bucket")))
    at = F.col("s.lead") + F.col("q.within")
    whole = F.round(F.col("target")).cast("long")
    used = [F.least(F.greatest(whole - F.col("source_size") * e - at, F.lit(0)), F.col("size")) for e in range(math.ceil(cap))]
    taken = sum(used[1:], used[0])
    share = [(at + F.col("source_size") * e) / F.greatest(F.col("target"), F.lit(1.0)) for e in range(math.ceil(cap))]
    places = [F.when(u > 0, position_at(x, F.col("profile"))) for u, x in zip(used, share)]
    out = rows.select(
        "doc_id", F.col("q.source").alias("source"), *keep, "size", "source_size", "target",
        taken.alias("taken"), F.array(*used).alias("passes"), F.array(*places).alias("positions"), places[0].alias("position"), "turn",
    )
    spread = F.coalesce("position", 1 + F.pmod(F.col("turn"), F.lit(1 << 20)) / (1 << 20))  # unused rows share no key
    return out.withColumn("_at", spread).repartitionByRange("_at", "doc_id").sortWithinPartitions("_at", "doc_id").drop("_at", "turn")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = BASE_WEIGHTS, cap: float = 3.0) -> DataFrame:
    """The rows to train on, in order of position, with docs' columns: a row for each pass that uses a document.

    A document that a pass ends in is cut there, to its first words joined by single spaces. Docs
    without a source column are one source. Equal rows are one document that is used in their stead.
    """
    names = docs.columns
    rows = boxed(docs)
    source = in_box(names, "source").cast("string") if "source" in names else F.lit(None).cast("string")
    # rows that agree in all columns are interchangeable; their copies are numbered by the join
    rest = F.to_json("rest") if "map<" in rows.schema["rest"].dataType.simpleString() else F.col("rest")
    keyed_rows = rows.select("doc_id", "text", "rest", source.alias("source"), F.xxhash64("doc_id", "text", rest).alias("key"))
    plan = mix(keyed_rows.select("doc_id", "source", "text", "key"), weights, cap, keep=["key"]).filter("taken > 0")
    plan = plan.select("doc_id", "key", "size", F.filter(F.arrays_zip("passes", "positions"), lambda x: x["passes"] > 0).alias("uses"))
    plan = plan.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("uses")).alias("uses"), F.max("size").alias("size"))
    twice = keyed_rows.groupBy("doc_id", "key").count().filter("count > 1").limit(1).count()
    one = keyed_rows.dropDuplicates(["doc_id", "key"]) if twice else keyed_rows
    plan = plan.withColumnRenamed("doc_id", "id").withColumnRenamed("key", "plan_key")
    used = one.join(plan, (F.col("key") == F.col("plan_key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "rest", "size", F.inline("uses"))
    short = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("passes").cast("int")), " ")
    used = used.withColumn("cut", F.col("passes") < F.col("size")).withColumn("text", F.when(F.col("cut"), short).otherwise(F.col("text")))
    used = used.repartitionByRange("positions", "doc_id").sortWithinPartitions("positions", "doc_id")
    changed = {"n_chars": F.when(F.col("cut"), F.length("text").cast("long")).otherwise(in_box(names, "n_chars"))} if "n_chars" in names else {}
    return unboxed(used, names, **changed)
