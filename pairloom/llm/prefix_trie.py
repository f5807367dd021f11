"""Prefix trie of conversations by leaf-peeling message passing (operator 12).

A node is a distinct sequence of first turns, and is told from others by the exclusive or of 128 bits a turn
(turn number, role, text), which adds up over blocks of a conversation in any order.

The conversations whose least member is the same conversation r share a run of r's own turns: nodes of one least
member form a chain, and a chain is what is peeled. Each holds a counter of the chains that hang on it. Chains
whose counter is 0 are complete; they send their totals (leaves, bytes saved) to the chain they hang on, whose counter falls,
until only the root's chain has finished. Rounds follow the nesting of branches, not the length of conversations.
Inside a chain the totals of its nodes are running sums from the bottom.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import arrow_batches, materialize, release

#: Turns of a conversation, nodes of a chain and ids of a hash that one task holds together.
BLOCK = 4096
#: Conversations that start alike: conv_id - conv_id % KIN; shared turns: crc32 of the id % SHARED.
KIN, SHARED = 5, 9
#: Keys with more than one in HOT of all rows are joined by broadcast; there are fewer than HOT of them.
HOT = 1000
_KEY = ["depth", "k1", "k2"]


def _shared(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % SHARED


def _blocked(df: DataFrame, by: str, place: str, down: bool, sums: dict[str, tuple], length: str) -> DataFrame:
    """Running aggregates {name: (aggregate, join, column)} along `place` inside `by`, block by block, so that no task holds a whole run."""
    df = df.withColumn("blk", F.floor(F.col(place) / BLOCK))
    order = F.col(place).desc() if down else F.col(place)
    inside = Window.partitionBy(by, "blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(by).orderBy(F.col("blk").desc() if down else F.col("blk")).rowsBetween(Window.unboundedPreceding, -1)
    whole = df.filter(F.col(length) >= BLOCK).groupBy(by, "blk").agg(*[agg(c).alias(f"all_{n}") for n, (agg, _, c) in sums.items()])
    before = whole.select(by, "blk", *[F.coalesce(agg(f"all_{n}").over(across), F.lit(0)).alias(f"before_{n}") for n, (agg, _, _) in sums.items()])
    df = df.select("*", *[agg(c).over(inside).alias(f"in_{n}") for n, (agg, _, c) in sums.items()]).join(before, [by, "blk"], "left")
    made = [put(F.col(f"in_{n}"), F.coalesce(f"before_{n}", F.lit(0))).alias(n) for n, (_, put, _) in sums.items()]
    drop = {"blk"} | {f"{p}_{n}" for p in ("in", "before") for n in sums}
    return df.select(*[c for c in df.columns if c not in drop], *made)


def _placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their place in their conversation and what their kin need, conversations (conv_id, n, length after rebuilding))."""
    said = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.unhex(F.md5(said)).alias("t"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("id"))
    order = [F.col("turn").asc_nulls_first(), "t", "id"]
    rows = materialize(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    # a conversation may span parts: its rows before a part are counted by part
    seg = rows.groupBy("part", "conv_id").agg(F.count("*").alias("m"))
    base = F.col("conv_id") - F.col("conv_id") % KIN
    convs = seg.groupBy("conv_id").agg(F.sum("m").alias("n")).withColumn("base", base)
    kin = Window.partitionBy("base")
    convs = convs.select("*", F.coalesce(F.sum(F.when(F.col("conv_id") == F.col("base"), F.col("n"))).over(kin), F.lit(0)).alias("n_base"), F.collect_list(F.struct("conv_id", "n")).over(kin).alias("kin"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).join(convs, "conv_id").drop("m")
    here = Window.partitionBy("part", "conv_id").orderBy(*order)
    rows = rows.join(seg, ["part", "conv_id"]).withColumn("pos", F.col("before") + F.row_number().over(here) - 1)
    h = F.least(_shared(F.col("conv_id")), F.col("n_base"))
    length = F.when(F.col("conv_id") == F.col("base"), F.col("n")).otherwise(h + F.greatest(F.col("n") - _shared(F.col("conv_id")), F.lit(0)))
    return rows, convs.select("conv_id", length.alias("length"))


def _rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, length, t, bytes): the turns of all rebuilt conversations."""
    own, h = F.col("conv_id") == F.col("base"), _shared(F.col("conv_id"))
    m = F.least(h, F.col("n_base"))
    one = lambda c, p, n: F.struct(c.alias("conv_id"), p.cast("long").alias("pos"), n.cast("long").alias("length"))
    none = F.array().cast("array<struct<conv_id:bigint,pos:bigint,length:bigint>>")
    kept = F.when(own, F.array(one(F.col("conv_id"), F.col("pos"), F.col("n")))).when(F.col("pos") >= h, F.array(one(F.col("conv_id"), m + F.col("pos") - h, m + F.col("n") - h))).otherwise(none)
    sisters = F.filter("kin", lambda k: (k["conv_id"] != F.col("base")) & (_shared(k["conv_id"]) > F.col("pos")))
    lent = F.transform(sisters, lambda k: one(k["conv_id"], F.col("pos"), F.least(_shared(k["conv_id"]), F.col("n_base")) + F.greatest(k["n"] - _shared(k["conv_id"]), F.lit(0))))
    both = F.concat(kept, F.when(own & (F.col("pos") < SHARED - 1), lent).otherwise(none))
    return rows.select(F.explode(both).alias("x"), "t", "bytes").select("x.conv_id", "x.pos", "x.length", "t", "bytes")


def _joined_hot(heads: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """heads with the chain that each hangs on. Nodes on which more than one in HOT chains hang (fewer than HOT) are broadcast."""
    up = [F.col("depth").alias("at"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("upper")]
    on = ["at", "up1", "up2"]
    hot, cold = nodes.filter(F.col("hanging") * HOT > total).select(*up), nodes.filter((F.col("hanging") > 0) & (F.col("hanging") * HOT <= total)).select(*up)
    rest = heads.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on)
    return heads.join(F.broadcast(hot), on).unionByName(rest)


def _peeled(chains: DataFrame) -> tuple[DataFrame, int]:
    """All chains with their totals (conv_id, upper, at, leaves, saved), and the rounds it took."""
    state, finished, rounds = materialize(chains, "chains"), None, 0
    while True:
        rounds += 1
        done = state.filter("remaining = 0").drop("remaining")
        finished = done if finished is None else finished.unionByName(done)
        pending = state.filter("remaining > 0")
        if pending.limit(1).count() == 0:
            return finished, rounds
        sent = done.groupBy(F.col("upper").alias("conv_id")).agg(F.count("*").alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        now = pending.join(sent, "conv_id", "left").select(
            "conv_id", "upper", "at", (F.col("remaining") - F.coalesce("c", F.lit(0))).alias("remaining"),
            (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
        )
        state = materialize(now, "chains")
        if rounds % 16 == 0:
            finished = materialize(finished, "peeled")


def _ends(members: DataFrame) -> DataFrame:
    """(*_KEY, ends_sha256) of the nodes at which conversations end: ids joined in blocks of BLOCK, then hashed block by block."""
    arrow_batches(members.sparkSession)
    blocks = members.groupBy(*_KEY, F.floor(F.col("conv_id") / BLOCK).alias("blk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "blk")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = h = None
        for b in batches:
            out = []
            for *k, ids in zip(*(b.column(c).to_pylist() for c in (*_KEY, "ids"))):
                if k == key:
                    h.update(b",")
                else:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = k, hashlib.sha256()
                h.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*_KEY, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, h.hexdigest())], [*_KEY, "ends_sha256"])

    return ordered.mapInArrow(go, "depth long, k1 long, k2 long, ends_sha256 string")


def build_trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id must be an integer column. Rows are ordered by turn (null first), ties by role and text; equal rows are
    turns of their own. Null role or text: empty. Rows without conv_id belong to no conversation. c % 5 has
    the sign of c. Other columns are ignored; an empty table gives no rows, not even a root. Texts are hashed
    where they are read and never shuffled; a conversation of any length is spread over tasks.
    """
    rows, lengths = _placed(turns)
    lengths = materialize(lengths, "lengths")
    e = _rebuilt(rows).withColumn("e1", F.xxhash64("pos", "t")).withColumn("e2", F.xxhash64("t", "pos", F.lit(12)))
    xor = lambda a, b: a.bitwiseXOR(b)
    e = _blocked(e, "conv_id", "pos", False, {"k1": (F.bit_xor, xor, "e1"), "k2": (F.bit_xor, xor, "e2")}, "length")
    members = materialize(e.select("conv_id", (F.col("pos") + 1).alias("depth"), "length", "k1", "k2", xor(F.col("k1"), F.col("e1")).alias("up1"), xor(F.col("k2"), F.col("e2")).alias("up2"), "bytes"), "members")
    zero = F.lit(0).cast("long")
    nodes = members.groupBy(*_KEY).agg(F.min(F.struct("conv_id", "length")).alias("least"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min("up1").alias("up1"), F.min("up2").alias("up2"))
    root = lengths.agg(F.min(F.struct("conv_id", "length")).alias("least"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "least", "n_convs", zero.alias("bytes"), zero.alias("up1"), zero.alias("up2"))
    nodes = nodes.unionByName(root).select(*_KEY, "least.conv_id", "least.length", "n_convs", "bytes", "up1", "up2")
    nodes = materialize(nodes, "nodes")
    heads = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "up1", "up2")).alias("head")).select("conv_id", (F.col("head.depth") - 1).alias("at"), "head.up1", "head.up2")
    heads = materialize(heads, "heads")
    hanging = heads.filter("at >= 0").groupBy(F.col("at").alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")).agg(F.count("*").alias("hanging"))
    full = nodes.drop("up1", "up2").join(hanging, _KEY, "left").withColumn("hanging", F.coalesce("hanging", F.lit(0)))
    leaf = F.when((F.col("depth") == F.col("length")) & (F.col("hanging") == 0), 1).otherwise(0).cast("long")
    full = materialize(full.withColumn("leaf", leaf).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    release(nodes)
    hung = _joined_hot(heads.filter("at >= 0"), full, heads.count()).select("conv_id", "upper", "at")
    hung = materialize(hung, "hung")
    sums = full.groupBy("conv_id").agg(F.sum("hanging").alias("remaining"), F.sum("leaf").alias("leaves"), F.sum("own").alias("saved"))
    done, _ = _peeled(sums.join(hung, "conv_id", "left"))
    got = done.filter("upper IS NOT NULL").groupBy(F.col("upper").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    tops = hung.select("conv_id", (F.col("at") + 1).alias("depth"), "upper")
    rows = full.join(got, ["conv_id", "depth"], "left").join(tops, ["conv_id", "depth"], "left")
    rows = rows.withColumn("l", F.col("leaf") + F.coalesce("l", F.lit(0))).withColumn("s", F.col("own") + F.coalesce("s", F.lit(0)))
    add = lambda a, b: a + b
    rows = _blocked(rows, "conv_id", "depth", True, {"n_leaves": (F.sum, add, "l"), "saved_tokens": (F.sum, add, "s")}, "length")
    ends = members.filter("depth = length").select("conv_id", *_KEY).unionByName(lengths.filter("length = 0").select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2")))
    rows = rows.join(_ends(ends), _KEY, "left")
    return rows.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("upper", "conv_id")).alias("parent_conv_id"), "n_convs",
        (F.col("hanging") + F.when(F.col("depth") < F.col("length"), 1).otherwise(0)).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
