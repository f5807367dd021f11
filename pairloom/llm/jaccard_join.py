"""N-gram Jaccard join and its components (operator 6).

Tokens (hashes of word shingles) are hashed into groups, and a set is the point of its group counts: the
overlap of two sets is at most the sum of coordinate minima. R-trees over such points find the
candidates: a node's box bounds the overlap with any point in it. What survives is verified on whole sets.

Which points share a tree: two sets that link differ in few tokens, so of slightly more groups one
holds the same tokens in both; equal (group, content) keys name the buckets (Bands). Copies of a set
are one point. First each point asks in a few of its buckets only, which joins nearly all of any
group. Then those buckets whose points still lie in different components are searched in full.
A search returns groups of points joined by candidate pairs, equal ones from several buckets count
once, and a task verifies each group while it unites it: of n points it links n - 1 at most, and a pair
that is joined already is not looked at. So no group is expanded into its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm import kernels as K
from pairloom.llm.common import arrow_batches, boxed, keyed, materialize, release, unboxed
from pairloom.llm.components import components

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GROUP, _CONTENT, _POINT = K.U(0xA24BAED4963EE407), K.U(0x9FB21C651E98DF25), K.U(0xD6E8FEB86659FD93)
LEAF = 32
#: Buckets that a point asks in at first.
PICKS = 3
#: Points, and tokens, of a bucket that a task holds; a larger bucket is dealt to several, and each point that asks goes to all of them.
BLOCK, BLOCK_TOKENS = 8192, 1 << 21


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, all in one array, and n + 1 offsets."""
    h, at = K.row_words(data, off, _LOWER)
    n = np.diff(at)
    rows = np.arange(len(n))
    own, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(h) >= k:
        g = K.rolling(h, k)
        word_row = np.repeat(rows, n)
        inside = np.flatnonzero(word_row[k - 1 :] == word_row[: len(word_row) - k + 1])
        own, values = word_row[inside], g[inside]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):  # the whole sequence counts as one shingle
        whole = np.array([K.rolling(h[at[i] : at[i + 1]], int(n[i]))[0] for i in short], dtype=np.uint64)
        own, values = np.append(own, short), np.append(values, K.mix(whole + n[short].astype(np.uint64)))
    order = np.lexsort((values, own))
    own, values = own[order], values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (own[1:] != own[:-1])
    own, values = own[fresh], values[fresh]
    return values, np.searchsorted(own, np.arange(len(n) + 1))


class Bands:
    """Size bands, and the groups that tokens of a pair whose larger set lies in a band are hashed into.

    A linked pair differs in `differ` tokens at most, so of more groups one has equal content in both.
    A set with tokens in more groups than it can differ in agrees in one that holds tokens; groups
    without tokens need keys only where a set has fewer. Some spare groups make that rare.
    """

    BITS = 7

    def __init__(self, num: int, den: int, top: int = 1 << 36):
        self.num, self.den = num, den
        lo = [1]
        while lo[-1] < top:
            lo.append(max(lo[-1] + 1, lo[-1] * 3 // 2))
        self.lo = np.array(lo, dtype=np.int64)
        self.largest = np.append(self.lo[1:], top * 2) - 1
        self.differ = 2 * self.largest * (den - num) // (den + num)
        g = self.differ + 1.0
        for _ in range(6):
            empty = g * np.exp(-self.largest / g)
            g = self.differ + 1 + np.where(self.differ > 0, np.minimum(self.differ, np.ceil(empty + 2 * np.sqrt(empty) + 1)), 0)
        self.groups = g.astype(np.int64)

    def keys(self, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all sets, and the set of each; the band is the key's last BITS bits.

        A set has keys for each band in which it can be the smaller or the larger one of a pair.
        """
        n = np.diff(at)
        rows = np.flatnonzero(n)
        band = np.searchsorted(self.lo, n[rows], side="right") - 1
        place, content = K.mix(values ^ _GROUP) >> K.U(20), K.mix(values ^ _CONTENT)
        out, own = [], []
        while len(rows):
            g, size = self.groups[band], n[rows]
            base = np.cumsum(g) - g
            i = np.repeat(np.arange(len(rows)), size)
            token = np.arange(len(i)) + (at[rows] - (np.cumsum(size) - size))[i]
            cell = base[i] + (place[token] % g[i].astype(np.uint64)).astype(np.int64)
            total, full = np.zeros(int(g.sum()), np.uint64), np.zeros(int(g.sum()), bool)
            np.add.at(total, cell, content[token])
            full[cell] = True
            row = np.repeat(np.arange(len(rows)), g)
            group = np.arange(len(row)) - base[row]
            few = np.add.reduceat(full, base, dtype=np.int64) <= np.minimum(self.differ[band], size * (self.den - self.num) // self.num)
            pick = full | few[row]
            key = K.mix(total + (group.astype(np.uint64) + (band[row].astype(np.uint64) << K.U(32))) * K._BASE)
            key = (key >> K.U(self.BITS) << K.U(self.BITS)) | band[row].astype(np.uint64)
            out.append(key[pick])
            own.append(rows[row[pick]])
            more = (band + 1 < len(self.lo)) & (self.lo[np.minimum(band + 1, len(self.lo) - 1)] * self.num <= size * self.den)
            rows, band = rows[more], band[more] + 1
        return np.concatenate(out or [np.zeros(0, np.uint64)]), np.concatenate(own or [np.zeros(0, np.int64)])

    def blocks(self, key: Column, members: Column) -> Column:
        """The number of tasks that a bucket is dealt to."""
        largest = F.array(*[F.lit(int(x)) for x in self.largest])
        tokens = F.element_at(largest, (key.bitwiseAND(F.lit((1 << self.BITS) - 1)) + 1).cast("int"))
        return F.greatest(F.ceil(members / BLOCK), F.ceil(members * tokens / BLOCK_TOKENS)).cast("int")


def _dims(n: int) -> int:
    return 1 << min(10, max(4, (n // 3).bit_length()))


def point(values: np.ndarray) -> np.ndarray:
    """Token counts by group; 16 to 1024 groups as the set's size asks."""
    d = _dims(len(values))
    return np.bincount((K.mix(values ^ _POINT) & K.U(d - 1)).astype(np.int64), minlength=d).astype("<u4")


def fold(v: np.ndarray, d: int) -> np.ndarray:
    """The same points with fewer groups."""
    return v.reshape(len(v), -1, d).sum(axis=1) if v.shape[1] > d else v


class RTree:
    """Boxes over points sorted by size and leading coordinates; a box keeps coordinate maxima and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 0], points[:, : points.shape[1] // 2].sum(axis=1), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        cut = np.arange(0, len(sizes), LEAF)
        self.levels = [(cut, np.maximum.reduceat(self.points, cut), np.minimum.reduceat(self.sizes, cut), np.maximum.reduceat(self.sizes, cut))]
        while len(self.levels[-1][0]) > LEAF:
            at, top, low, high = self.levels[-1]
            up = np.arange(0, len(at), LEAF)
            self.levels.append((up, np.maximum.reduceat(top, up), np.minimum.reduceat(low, up), np.maximum.reduceat(high, up)))

    def near(self, p: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
        """Rows of points whose overlap with p may reach num / den of the union."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            at, top, low, high = self.levels[depth]
            bound = np.minimum(top[nodes], p).sum(axis=1)
            need = num * (n + np.maximum(low[nodes], n * num // den))
            nodes = nodes[((den + num) * bound >= need) & (high[nodes] * den >= n * num) & (low[nodes] * num <= n * den)]
            if depth:
                first = self.levels[depth][0][nodes]
                nodes = (first[:, None] + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        rows = (self.levels[0][0][nodes][:, None] + np.arange(LEAF)).ravel()
        rows = rows[rows < len(self.sizes)]
        bound = np.minimum(self.points[rows], p).sum(axis=1)
        return self.order[rows[((den + num) * bound >= num * (n + self.sizes[rows])) & (self.sizes[rows] * den >= n * num) & (self.sizes[rows] * num <= n * den)]]


class Forest:
    """R-trees over points of several widths, one for each width asked with, and the labels that unite() joins."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, num: int, den: int):
        self.points, self.sizes, self.num, self.den = points, sizes, num, den
        self.label = np.unique(labels, return_inverse=True)[1].ravel()
        self.parts = int(self.label.max(initial=-1)) + 1
        self.least = min(map(len, points), default=0)
        self.trees: dict[int, RTree] = {}

    def near(self, i: int, among: int) -> np.ndarray:
        """Of the first `among` points those of other labels that may link with point i."""
        p = self.points[i][None, :]
        d = min(self.least, p.shape[1])
        if d not in self.trees:
            self.trees[d] = RTree(np.vstack([fold(x[None, :], d) for x in self.points[:among]]).astype(np.int64), self.sizes[:among])
        j = self.trees[d].near(fold(p, d)[0].astype(np.int64), int(self.sizes[i]), self.num, self.den)
        return j[self.label[j] != self.label[i]]

    def unite(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        self.label[self.label == b] = a
        self.parts -= 1


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal values in the columns `by`."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(change) + 1, [batch.num_rows]))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            now = tuple(c[lo] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _points(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in t.column("vec").to_pylist()]


def _candidate_groups(f: Forest, asks: np.ndarray, among: int, rid: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(id, rids) of the points that candidate pairs join. The id depends on the members alone."""
    parent = np.arange(len(rid))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(rid) == 2:
        a, b = (fold(p[None, :], f.least)[0].astype(np.int64) for p in f.points)
        n, m = int(f.sizes[0]), int(f.sizes[1])
        if f.label[0] != f.label[1] and (f.den + f.num) * int(np.minimum(a, b).sum()) >= f.num * (n + m) and min(n, m) * f.den >= max(n, m) * f.num:
            parent[1] = 0
    else:
        for i in asks:
            for j in f.near(i, among):
                a, b = find(int(i)), find(int(j))
                if a != b:
                    parent[max(a, b)] = min(a, b)
    top = np.array([find(x) for x in range(len(rid))])
    for r in np.flatnonzero(np.bincount(top) > 1):
        members = np.unique(rid[top == r])
        if len(members) > 1:
            yield int(K.mix(members.astype(np.uint64) * K._BASE).sum(dtype=np.uint64).astype(np.int64)), members


def _search(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Blocks of buckets (key, block, stored, ask, rid, comp, n, vec), stored rows first, to candidate groups (gid, rid).

    Rows that only ask go by in batches, each with the stored rows of one block, of which there are BLOCK or so.
    """
    gids, rids, weight, block, kept = [], [], 0, None, None

    for t in _runs(batches, ["key", "block", "stored"]):
        here, stored = (t.column("key")[0].as_py(), t.column("block")[0].as_py()), t.column("stored")[0].as_py()
        if stored:
            block, kept = here, t
            parts = [t] if t.num_rows > 1 else []
        elif here == block:
            parts = [pa.concat_tables([kept, t.slice(x, BLOCK)]) for x in range(0, t.num_rows, BLOCK)]
        else:
            parts = []  # a block may have no stored rows
        for p in parts:
            rid, comp, n, ask = (p.column(c).to_numpy() for c in ("rid", "comp", "n", "ask"))
            among = kept.num_rows
            asks = np.flatnonzero(ask) if stored else np.arange(among, p.num_rows)
            if len(asks):
                for gid, members in _candidate_groups(Forest(_points(p), n, comp, num, den), asks, among, rid):
                    gids.append(np.full(len(members), gid))
                    rids.append(members)
                    weight += len(members)
        if weight > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gids)), pa.array(np.concatenate(rids))], ["gid", "rid"])
            gids, rids, weight = [], [], 0
    if gids:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gids)), pa.array(np.concatenate(rids))], ["gid", "rid"])


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Candidate groups (gid, rid, comp, tokens) to links (a, b) that join different components: n - 1 of n points at most."""
    a, b = [], []
    for t in _runs(batches, ["gid"]):
        rid, comp = (t.column(c).to_numpy() for c in ("rid", "comp"))
        sets = []
        for chunk in t.column("tokens").chunks:
            raw, off = K.column_bytes(chunk)
            sets += [raw[x:y].view("<u8") for x, y in zip(off[:-1].tolist(), off[1:].tolist())]
        sizes = np.array([len(s) for s in sets])
        f = Forest([point(s) for s in sets], sizes, comp, num, den)
        for i in range(len(rid)):
            if f.parts < 2:
                break
            for j in f.near(i, len(rid)):
                if f.label[i] != f.label[j]:
                    both = _overlap(sets[i], sets[j])
                    if den * both >= num * (sizes[i] + sizes[j] - both):
                        a.append(min(rid[i], rid[j]))
                        b.append(max(rid[i], rid[j]))
                        f.unite(i, int(j))
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _by_row(batches, k: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for b in batches:
        data, off = K.column_bytes(b.column("text"))
        for x, y in K.chunks(off):
            yield (b, x, y, *shingle_sets(data[off[x] : off[y]], off[x : y + 1] - off[x], k))


def group_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """near_groups() of any docs."""
    return near_groups(keyed(docs.select("doc_id", "text")), k, num, den)


def near_groups(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One row per row of docs(rid, doc_id, text): rid, doc_id, n_shingles, component (least rid reachable), component_id (its doc_id).

    Words are lower-cased (A-Z); a set holds distinct k-word shingles, or with fewer words the whole
    sequence as one. Sets link if den * overlap >= num * union. Null or empty text: an empty set, which
    links with nothing. Repeated or null doc_ids are separate documents. A long text is read in pieces;
    its set is held by one task. Other columns are ignored. Empty docs give no rows.
    """
    arrow_batches(docs.sparkSession)
    bands = Bands(num, den)

    def measure(batches):
        for b, x, y, v, at in _by_row(batches, k):
            h = np.append(K.mix(v ^ _CONTENT), K.U(0))
            g = np.append(K.mix(v ^ _POINT), K.U(0))
            n = np.diff(at)
            s1, s2 = (np.where(n > 0, np.add.reduceat(z, at[:-1]), K.U(0)) if len(n) else z[:0] for z in (h, g))
            key, row = bands.keys(v, at)
            key = key[np.argsort(row, kind="stable")].view(np.int64)
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=len(n)))).astype(np.int32)
            cols = [b.column("rid").slice(x, y - x), b.column("doc_id").slice(x, y - x).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(key))]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "n", "s1", "s2", "keys"])

    def full(batches):
        for b, x, y, v, at in _by_row(batches, k):
            sets = [v[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            cols = [b.column("rid").slice(x, y - x), pa.array(np.diff(at).astype(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([point(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "n", "tokens", "vec"])

    # keys take a fraction of the text's bytes, so they, and not the texts, are dealt to find the least row of equal sets
    measured = materialize(docs.select("rid", "doc_id", "text").mapInArrow(measure, "rid long, doc_id long, n long, s1 long, s2 long, keys array<long>"), "measured")
    sized = materialize(measured.drop("keys"), "sized")
    same = materialize(sized.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("rid").alias("rep")), "same")
    unique = measured.select("rid", "keys").join(same.select(F.col("rep").alias("rid")).hint("merge"), "rid")  # by its file's size a table of ids would be broadcast long after it is large
    keyed_rows = materialize(unique.select(F.explode("keys").alias("key"), "rid"), "keys")
    release(measured)
    shared = materialize(keyed_rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    bucket = materialize(keyed_rows.join(shared, "key"), "buckets")
    release(keyed_rows)
    release(shared)
    # near copies share most keys, so the least ones of several orders are likely to be the same
    least = lambda salt: F.min(F.struct(F.xxhash64("key", F.lit(salt)).alias("h"), "key", "c"))
    picks = bucket.groupBy("rid").agg(*[least(s).alias(f"p{s}") for s in range(PICKS)])
    picks = materialize(picks.select("rid", F.array_distinct(F.array(*[F.struct(f"p{s}.key", f"p{s}.c") for s in range(PICKS)])).alias("picks")), "picks")
    sets = materialize(docs.select("rid", "text").join(picks.select("rid").hint("merge"), "rid").mapInArrow(full, "rid long, n long, tokens binary, vec binary"), "sets")

    def links(points: DataFrame, name: str) -> DataFrame:
        """Verified links of the rows (key, block, stored, ask, rid, comp) of buckets."""
        points = points.join(sets.select("rid", "n", "vec"), "rid").select("key", "block", "stored", "ask", "rid", "comp", "n", "vec")
        points = points.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("stored"))
        found = materialize(points.mapInArrow(lambda it: _search(it, num, den), "gid long, rid long").distinct(), "candidates")
        rows = found.join(sets.select("rid", "tokens"), "rid")
        rows = rows.join(joined, "rid", "left").select("gid", "rid", F.coalesce("comp", "rid").alias("comp"), "tokens") if joined else rows.select("gid", "rid", F.col("rid").alias("comp"), "tokens")
        out = materialize(rows.repartition("gid").sortWithinPartitions("gid", "rid").mapInArrow(lambda it: _verify(it, num, den), "a long, b long"), name)
        release(found)
        return out

    joined = None
    asked = picks.select("rid", F.explode("picks").alias("p")).select("rid", "p.key", "p.c")
    own = lambda blocks: F.pmod(F.xxhash64("rid"), blocks).cast("int")
    asked = asked.select("key", own(bands.blocks(F.col("key"), F.col("c"))).alias("block"), F.lit(True).alias("stored"), F.lit(True).alias("ask"), "rid", F.col("rid").alias("comp"))
    first = links(asked, "links")
    joined = materialize(components(first).select(F.col("v").alias("rid"), F.col("component").alias("comp")), "components")
    named = materialize(bucket.join(joined, "rid", "left").select("key", "rid", F.coalesce("comp", "rid").alias("comp")), "named")
    release(bucket)
    release(picks)
    members = [F.count("*").alias("c"), F.sum(F.shiftright(F.xxhash64("rid"), 8)).alias("s1"), F.sum(F.shiftright(F.xxhash64("rid", F.lit(1)), 8)).alias("s2")]
    split = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *members).filter("lo <> hi")
    split = split.groupBy("c", "s1", "s2").agg(F.min("key").alias("key"))  # one of the buckets with the same members
    split = split.select("key", bands.blocks(F.col("key"), F.col("c")).alias("blocks"))
    parted = materialize(named.join(split, "key"), "split")
    release(named)
    # pairs inside a bucket's largest component need no search, so only the other members ask
    most = parted.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp"))["comp"].alias("most"))
    points = parted.join(most, "key").withColumn("ask", F.col("comp") != F.col("most")).withColumn("own", own(F.col("blocks")))
    asks = F.when(F.col("ask"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    points = points.withColumn("block", F.explode(asks)).withColumn("stored", F.col("block") == F.col("own"))
    more = links(points, "more")
    for x in (parted, sets):
        release(x)
    comp = materialize(components(first.unionByName(more)), "components") if more.limit(1).count() else joined.select(F.col("rid").alias("v"), F.col("comp").alias("component"))
    groups = same.join(comp.withColumnRenamed("v", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    ids = sized.select(F.col("rid").alias("component"), F.col("doc_id").alias("component_id"))
    groups = groups.join(ids, "component")
    out = sized.join(groups, ["n", "s1", "s2"], "left")
    return out.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rid").alias("component"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The row of least doc_id of each group of near duplicates, with docs' columns.

    Null ids come first; of rows with equal ids the one of least text stays. Rows without words link
    with nothing and stay. Empty docs give no rows.
    """
    rows = keyed(boxed(docs), ["rest"])
    out = near_groups(rows, k, num, den).filter("component = rid").select("rid")
    return unboxed(rows.join(out, "rid"), docs.columns)
