"""URL filters: rules, and link-graph propagation for what no rule covers (operator 3). DataFrame functions only.

Trust starts at hosts with allowed pages and flows along links; distrust starts at hosts with blocked
pages and flows against links, to those that link there. Both are personalised PageRank over one table of
weighted host edges, a row for each kind. Scores are in pages: each judged page seeds 1, so a host's
verdict depends on its own pages and on those it is linked with, not on the size of the table. What a
host passes on is pushed round by round until no push is worth more than a small part of a page. A host
is blocked if its distrust exceeds its trust and a small part of a page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import materialize, release

#: (verdict, rule); a rule is a host, a slash and the start of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A link to another site: scheme, or none, and a host.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(df: DataFrame) -> DataFrame:
    """Adds host (after the first ://, ASCII lower-cased) and path (up to ? or #); both empty if there is none."""
    place = F.expr("coalesce(regexp_replace(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '(?s)[?#].*', ''), '')")
    df = df.withColumn("_place", place).withColumn("_host", F.substring_index("_place", "/", 1))
    return df.withColumn("host", F.translate("_host", _UPPER, _LOWER)).withColumn("path", F.expr("substr(_place, length(_host) + 1)")).drop("_place", "_host")


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits; null if none does. Rules are a short fixed list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, slash, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(kind, src, dst, share): links between hosts, forward for trust and reversed for distrust.

    Counts are summed before the shuffle, so a host with most pages is a few rows.
    """
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", _UPPER, _LOWER)).filter("host <> '' AND dst <> host")
    pairs = links.groupBy(F.col("host").alias("a"), F.col("dst").alias("b")).agg(F.count("*").cast("double").alias("n"))
    both = pairs.select(F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("a").alias("src"), F.col("b").alias("dst"), "n"),
        F.struct(F.lit("distrust").alias("kind"), F.col("b").alias("src"), F.col("a").alias("dst"), "n"),
    )).alias("e")).select("e.*")
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all_n"))
    return both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all_n")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float, least: float, every: int = 4) -> DataFrame:
    """(kind, host, score) of personalised PageRank from seeds(kind, host, mass), which need not sum to 1.

    Each round pushes what hosts got in the last one along their edges, until no host gets more than `least`;
    scores are the sums of all pushes. Mass at hosts without links ends there. Lineage is cut every few rounds.
    """
    push = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("score"))
    done, held = push, []
    while True:
        parts = []
        for _ in range(every):
            moved = push.withColumnRenamed("host", "src").join(edges, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            push = moved.groupBy("kind", "host").agg(F.sum("score").alias("score"))
            parts.append(push)
        rounds = parts[0].withColumn("k", F.lit(0))
        for k, p in enumerate(parts[1:], 1):
            rounds = rounds.unionByName(p.withColumn("k", F.lit(k)))
        rounds = materialize(rounds, "pushes")
        push = rounds.filter(F.col("k") == every - 1).drop("k")
        last, done = done, materialize(done.unionByName(rounds.drop("k")).groupBy("kind", "host").agg(F.sum("score").alias("score")), "scores")
        held.append(rounds)
        release(last)
        for x in held[:-1]:
            release(x)
        held = held[-1:]
        if not push.filter(F.col("score") > least).limit(1).count():
            release(rounds)
            return done


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, damping: float = 0.85, threshold: float = 1e-4, tolerance: float = 1e-5) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and by whom: the rule or the link graph.

    Null urls and urls without :// have empty host and path, fit no rule and are allowed. A host with
    neither seeds nor links is allowed, and so is one with equal trust and distrust. Null html has no
    links. Repeated rows are pages of their own; an empty table gives no rows. Other columns are ignored.
    threshold and tolerance are in pages.
    """
    t = with_host_and_path(pages.select("page_id", "url", "html"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = materialize(t.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule")), "judged")
    kind = F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust")
    seeds = materialize(judged.filter("by_rule IS NOT NULL AND host <> ''").groupBy(kind.alias("kind"), "host").agg(F.count("*").cast("double").alias("mass")), "seeds")
    edges = materialize(host_edges(t), "edges")
    scores = propagate(seeds, edges, damping, tolerance)
    per_host = scores.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
    )
    bad = materialize(per_host.filter((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))).select("host"), "bad")
    for x in (seeds, edges, scores):
        release(x)
    # only pages that no rule covers need a lookup, and repeated hosts are looked up once
    open_hosts = judged.filter("rule IS NULL").select("host").distinct().join(bad, "host", "left_semi").select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    out = judged.join(open_hosts, (F.col("host") == F.col("bad_host")) & F.col("rule").isNull(), "left")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNull(), "graph").otherwise("rule").alias("by"),
    )
