"""Pairs of sequences that differ at few sites: multi-index hashing.

Sites are dealt into most + 1 segments; two sequences that differ at `most` sites or fewer agree on a whole segment,
so segments are the join keys. Which site goes to which segment follows from the sites' entropies, measured on the table: each
segment gets a like share, so none is made of gaps and conserved sites alone. A segment value that very many
sequences have is split into blocks, each pair of which is a join key of its own, so no task meets all of its pairs. Candidates are
compared eight sites at a time: exclusive or of packed bytes, fold, count of bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.storage import materialize

#: Sets of sites up to which sequences meet in what is left of them without each set.
MASKS = 64
#: Sequences of one segment value that are joined together; more are split into blocks of about as many.
BLOCK = 2048
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)
Parts = list[list[int]]


def _bytes(col: pa.Array, width: int) -> np.ndarray:
    """A row of width bytes for each sequence; another length is an error."""
    raw = np.frombuffer("".join(col.to_pylist()).encode("latin-1"), np.uint8)
    return raw.reshape(len(col), width)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sites at which rows of two byte matrices differ."""
    pad = -a.shape[1] % 8
    x, y = (np.ascontiguousarray(np.pad(m, ((0, 0), (0, pad)))).view(np.uint64) for m in (a, b))
    z = x ^ y
    return np.bitwise_count((((z & _LOW) + _LOW) | z) & _HIGH).sum(axis=1, dtype=np.int64)


def entropies(seqs: DataFrame, width: int) -> np.ndarray:
    """Entropy of each site over seqs(seq): a row for each site and symbol reaches the driver."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, 256), np.int64)
        for b in batches:
            m = _bytes(b.column("seq"), width)
            for site in range(width):
                total[site] += np.bincount(m[:, site], minlength=256)
        pos, c = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pos.astype(np.int64)), pa.array(c.astype(np.int64)), pa.array(total[pos, c])], ["pos", "c", "n"])

    h = np.zeros(width)
    rows = seqs.select("seq").mapInArrow(go, "pos long, c long, n long").groupBy("pos", "c").agg(F.sum("n").alias("n"))
    for r in rows.groupBy("pos").agg(F.collect_list("n").alias("n")).collect():
        p = np.array(r.n, float) / sum(r.n)
        h[r.pos] = -(p * np.log(p)).sum()
    return h


def segments(h: np.ndarray, parts: int) -> Parts:
    """Sites (from 0) dealt into parts: each site, those of most entropy first, goes to the part with the least so far, of equal ones the shortest."""
    out: Parts = [[] for _ in range(parts)]
    have = np.zeros(parts)
    for site in np.argsort(-h, kind="stable"):
        k = min(range(parts), key=lambda p: (have[p], len(out[p])))
        out[k].append(int(site))
        have[k] += h[site] + 1e-9
    return [sorted(p) for p in out]


def keyed(seqs: DataFrame, width: int, parts: Parts) -> DataFrame:
    """(seq, i, k): the value k of each segment i."""
    power = np.cumprod(np.full(width, 0x9E3779B97F4A7C15, np.uint64))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _bytes(b.column("seq"), width).astype(np.uint64)
            keys = np.stack([(m[:, p] * power[p]).sum(axis=1, dtype=np.uint64) for p in parts], axis=1) if b.num_rows else np.zeros((0, len(parts)), np.uint64)
            keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            off = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(parts))
            yield pa.RecordBatch.from_arrays([b.column("seq"), pa.ListArray.from_arrays(off, pa.array(keys.ravel().view(np.int64)))], ["seq", "keys"])

    return seqs.select("seq").mapInArrow(go, "seq string, keys array<long>").select("seq", F.posexplode("keys").alias("i", "k"))


def near(left: DataFrame, right: DataFrame, width: int, most: int, once: bool = False, parts: Parts | None = None) -> DataFrame:
    """(a, b, d): the different sequences of left(seq) and right(seq), both without repeats, that differ at `most` sites or fewer.

    once: only pairs a < b, for a table with itself. Each pair comes once: at the first segment that it agrees on. parts: the
    segments, where they are known; any most + 1 of them give the same pairs.
    """
    parts = segments(entropies(right, width), most + 1) if parts is None else parts
    r, l = keyed(right, width, parts), keyed(left, width, parts)  # noqa: E741
    hot = r.groupBy("i", "k").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("i", "k", F.ceil(F.col("n") / BLOCK).alias("of"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("of", F.lit(1)) - 1))
    mine = F.pmod(F.xxhash64("seq"), F.coalesce("of", F.lit(1)))
    a = l.join(hot, ["i", "k"], "left").select("i", "k", F.col("seq").alias("a"), mine.alias("p"), other.alias("q"))
    b = r.join(hot, ["i", "k"], "left").select("i", "k", F.col("seq").alias("b"), mine.alias("q"), other.alias("p"))
    met = a.join(b, ["i", "k", "p", "q"]).filter("a < b" if once else "a <> b").select("i", "a", "b")
    order = np.concatenate([np.array(p, int) for p in parts if p]) if width else np.zeros(0, int)
    filled = [i for i, p in enumerate(parts) if p]
    starts = np.cumsum([0, *(len(parts[i]) for i in filled)])[:-1]
    empty = min((i for i, p in enumerate(parts) if not p), default=len(parts))  # all sequences agree on an empty segment

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _bytes(batch.column("a"), width), _bytes(batch.column("b"), width)
            d = distances(x, y)
            at = np.flatnonzero(d <= most)
            agree = np.logical_and.reduceat((x[at] == y[at])[:, order], starts, axis=1) if len(at) else np.zeros((0, len(filled)), bool)
            first = np.minimum(np.where(agree.any(axis=1), np.array(filled)[agree.argmax(axis=1)], len(parts)), empty)
            keep = pa.array(at[first == batch.column("i").to_numpy()[at]])
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep), pa.array(d).take(keep)], ["a", "b", "d"])

    return met.mapInArrow(go, "a string, b string, d long")


def candidates(rows: DataFrame, width: int, most: int) -> int:
    """How many pairs of distinct sequences meet in a segment, before any distance is counted."""
    seqs = materialize(rows.select("seq").distinct(), "sequences")
    k = keyed(seqs, width, segments(entropies(seqs, width), most + 1)).groupBy("i", "k").count()
    return int(k.agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0))).first()[0])


def masked(width: int, most: int) -> bool:
    """Whether the sets of at most `most` sites are so few that sequences meet without each of them."""
    return sum(comb(width, k) for k in range(most + 1)) <= MASKS


def without(width: int, sites: tuple[int, ...]) -> Column:
    """seq without some sites (from 0); another width is an error."""
    seq = F.when(F.length("seq") == width, F.col("seq")).otherwise(F.raise_error(F.lit(f"a sequence is not of {width} sites")))
    cuts = [-1, *sites, width]
    return F.concat(F.lit(""), *[F.substring(seq, a + 2, b - a - 1) for a, b in zip(cuts, cuts[1:]) if b - a > 1])


def near_counts(seqs: DataFrame, width: int, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(seq, n): the sum of c over the sequences of seqs(seq, c), without repeats, that differ at `most` sites or fewer, itself included.

    by: columns that name a set of sequences each; n is of the sequence's own set.

    Sequences that agree without a set of k sites differ at d <= k of these; each is met in comb(width - d, k - d) such sets, so the
    numbers at each distance follow from the sums over all sets of each size. No pairs are made: work grows with the sequences.
    """
    at = []  # the number at distance k as a combination of sums over sets of 0, 1, .. sites
    for k in range(most + 1):
        own = np.eye(most + 1, dtype=np.int64)[k]
        at.append(own - sum((comb(width - d, k - d) * at[d] for d in range(k)), np.zeros(most + 1, np.int64)))
    weight = sum(at)
    sets = [s for k in range(most + 1) for s in combinations(range(width), k)]
    keys = F.array(*[F.struct(F.lit(i).alias("i"), without(width, s).alias("k"), F.lit(int(weight[len(s)])).cast("long").alias("w")) for i, s in enumerate(sets)])
    met = seqs.select(*by, "seq", "c", F.explode(keys).alias("x")).groupBy(*by, "x.i", "x.k", "x.w").agg(F.sum("c").alias("s"), F.collect_list("seq").alias("seqs"))
    return met.select(*by, F.explode("seqs").alias("seq"), (F.col("w") * F.col("s")).alias("s")).groupBy(*by, "seq").agg(F.sum("s").alias("n"))


def masked_pairs(seqs: DataFrame, width: int, most: int) -> DataFrame:
    """(a, b, d), a < b, of seqs(seq) without repeats, as near(once=True): they meet without each set of `most` sites.

    What meets is near, so work grows with the pairs that are found. Each pair comes once: with the set that holds, beside the sites at
    which it differs, the first other ones.
    """
    sets = list(combinations(range(width), min(most, width)))
    prefix = lambda s: next((k for k, e in enumerate(s) if e != k), len(s))
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(prefix(s)).alias("p"), without(width, s).alias("k"), F.concat(F.lit(""), *[F.substring("seq", e + 1, 1) for e in s]).alias("e")) for i, s in enumerate(sets)])
    met = seqs.select("seq", F.explode(keys).alias("x")).groupBy("x.i", "x.p", "x.k").agg(F.collect_list(F.struct("seq", "x.e")).alias("z"))
    two = met.filter(F.size("z") > 1).select("p", "z", F.explode("z").alias("a")).select("p", "a", F.explode("z").alias("b")).filter("a.seq < b.seq")
    differ = [F.substring("a.e", k + 1, 1) != F.substring("b.e", k + 1, 1) for k in range(min(most, width))]
    for k, x in enumerate(differ):
        two = two.filter((F.col("p") > k) | x)
    d = sum((x.cast("long") for x in differ), F.lit(0).cast("long"))
    return two.select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), d.alias("d"))


def best_agreement(query: DataFrame, reference: DataFrame, width: int) -> DataFrame:
    """(seq, d): at how few sites each sequence of query(seq) differs from one of reference(seq), both without repeats.

    Sets of sites left out grow by one; a sequence that has met another is done, so few go on to sets of many sites.
    """
    rest, out = materialize(query.select("seq"), "queries"), None
    reference = materialize(reference.select("seq"), "reference")
    for k in range(width + 1):
        keys = F.array(*[F.struct(F.lit(i).alias("i"), without(width, s).alias("k")) for i, s in enumerate(combinations(range(width), k))])
        there = reference.select(F.explode(keys).alias("x")).select("x.i", "x.k").distinct()
        found = materialize(rest.select("seq", F.explode(keys).alias("x")).select("seq", "x.i", "x.k").join(there, ["i", "k"], "left_semi").select("seq").distinct(), "found")
        done = found.select("seq", F.lit(k).alias("d"))
        out = done if out is None else out.unionByName(done)
        rest = materialize(rest.join(found, "seq", "left_anti"), "queries")
        if not rest.limit(1).count():
            break
    return out
