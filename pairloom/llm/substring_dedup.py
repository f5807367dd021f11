"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks (operator 5).

Parsing every document against every block of the corpus would be quadratic, so blocks are made such that
a document meets those only that can hold its strings: equal strings of `length` words share their least
gram (kernels.Runs), so each such anchor names a reference block, the texts around its occurrences. Texts that are equal as a
whole run of strings are settled by a group-by first: only the earliest is kept in the block. The others
are parsed greedily, in order of document and place, against the index of those before them (_factors);
factors of `length` words or more are duplicate spans, and strings across a factor's end are looked up one
by one. A string that starts earlier anywhere in the corpus does so in its own block, so the result is that of
brute force. Words are compared as 64-bit hashes, all `length` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import kernels as K
from pairloom.llm import repeats as R
from pairloom.llm.common import keyed, materialize, release

_OUT = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:long,length:long>>"


#: Variants of one anchor that one task factors; those of a commoner anchor are compared by (anchor, window hash) in an aggregation.
HOT_VARIANTS = 20_000


def _factors(words: list[np.ndarray], windows: list[np.ndarray], a: list[int], n: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(text, first window, windows) of the factors of each text of a reference block against those before it.

    The block's index names each string of `length` words by its hash and its place from the anchor. A text is
    parsed greedily: a string that the index knows is compared word by word and extended as far as both
    texts agree; then the parse goes on at the first string that reaches over the factor's end, so none is missed.
    """
    index: dict[tuple[int, int], tuple[int, int]] = {}
    for i, (w, h) in enumerate(zip(words, windows)):
        q, hashes = 0, h.tolist()
        while q < n[i]:
            found = index.get((a[i] - q, hashes[q]))
            if found is None:
                index[a[i] - q, hashes[q]] = (i, q)
                q += 1
                continue
            x, y = w[q:], words[found[0]][found[1] :]
            size = min(len(x), len(y))
            other = np.flatnonzero(x[:size] != y[:size])
            reach = int(other[0]) if len(other) else size
            if reach < length:  # equal hashes of different words
                q += 1
                continue
            inside = min(reach - length + 1, n[i] - q)
            yield i, q, inside
            q += inside


def _parse(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (m, rid, p, n, a, ctx), sorted by (m, rid, p), to spans (rid, pack) of strings that stand earlier in their block."""
    rids, packs, held, last = [], [], [], None

    def close() -> None:
        if len(held) > 1:
            rid, p, n, a, words = zip(*held)
            cut = np.append(0, np.cumsum([len(w) for w in words]))
            h = K.rolling(np.concatenate(words), length)
            for i, first, size in _factors(words, [h[x : x + k] for x, k in zip(cut[:-1].tolist(), n)], a, n, length):
                rids.append(rid[i])
                packs.append(R.pack(p[i] + first, size))

    for b in batches:
        data, off = K.column_bytes(b.column("ctx"))
        m, rid, p, n, a = (b.column(k).to_numpy().tolist() for k in ("m", "rid", "p", "n", "a"))
        for i, (x, y) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            if m[i] != last:
                close()
                held, last = [], m[i]
            held.append((rid[i], p[i], n[i], a[i], data[x:y].view(np.uint64)))
        if len(rids) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(packs, pa.int64())], ["rid", "pack"])
            rids.clear()
            packs.clear()
    close()
    yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(packs, pa.int64())], ["rid", "pack"])


def factor_spans(docs: DataFrame, unit: R.Unit, hot_variants: int = HOT_VARIANTS) -> DataFrame:
    """(rid, pack) of all windows whose content also starts earlier."""
    cand = R.candidates(docs, unit)
    cls = R.classes(cand)
    again = cand.join(cls.filter("c > 1").select("m", "r", "f"), ["m", "r"]).filter("rid <> f.rid OR pack <> f.pack").select("rid", "pack")
    hot = cls.filter("multi").groupBy("m").count().filter(F.col("count") > hot_variants).select("m", F.lit(True).alias("hot"))
    marked = cls.filter("multi").join(hot, "m", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    ctx = materialize(R.contexts_of(R.contested(docs, marked.filter("NOT hot")), unit).drop("lead"), "contexts")
    parsed = ctx.repartition("m").sortWithinPartitions("m", "rid", "p").mapInArrow(lambda it: _parse(it, unit.length), "rid long, pack long")
    parts = again.unionByName(parsed)
    if hot.limit(1).count():
        win = materialize(R.windows_of(R.contested(docs, marked.filter("hot")), unit), "windows")
        firsts = win.groupBy("m", "w").agg(F.min(F.struct("rid", "p")).alias("f"), F.count("*").alias("k")).filter("k > 1").select("m", "w", "f")
        parts = parts.unionByName(win.join(firsts, ["m", "w"]).filter("rid <> f.rid OR p <> f.p").select("rid", (F.shiftleft("p", R._SHIFT) + 2).alias("pack")))
    spans = materialize(parts, "spans")
    for x in (cand, cls, ctx):
        release(x)
    return spans


def dedup_substrings(docs: DataFrame, length: int = 20, gram: int = 5, hot_variants: int = HOT_VARIANTS) -> DataFrame:
    """Removes every word covered by a window of `length` words that also starts earlier.

    Earlier: in a document of smaller doc_id (null first), or in the same document at a smaller start.
    One row per row of docs: doc_id, n_words, n_removed, kept_text (kept words joined by a space),
    spans (removed runs of words, from 0). Null text: no words. Repeated or null ids are separate
    documents in order of their text. Long texts are read in pieces. Other columns of docs are ignored.
    Empty docs give no rows.
    """
    R.prepare(docs)
    unit = R.Unit("word", length, gram)
    docs = keyed(docs.select("doc_id", "text"))
    spans = factor_spans(docs, unit, hot_variants)

    def cut(batches):
        for b in batches:
            data, off = K.column_bytes(b.column("text"))
            for x, y in K.chunks(off):
                row, first, last = R.removed(b.column("marks").slice(x, y - x), length)
                part, o = data[off[x] : off[y]], off[x : y + 1] - off[x]
                kept, n = _kept(part, o, row, first, last)
                lost = np.bincount(row, weights=last - first, minlength=y - x).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(x, y - x).cast(pa.int64()), pa.array(n), pa.array(lost), pa.array(kept, pa.string()), R.span_lists(row, first, last, y - x)], ["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    return R.by_document(docs, spans).mapInArrow(cut, _OUT)


def _kept(data: np.ndarray, off: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The words outside the runs, joined by one space, and the number of all words, of each row; long rows go by in pieces."""
    text, n = [[] for _ in range(len(off) - 1)], np.zeros(len(off) - 1, np.int64)
    for (x, y), a, z in K.pieces(data, off, 1 << 20):
        part = data[a:z]
        o = np.array([0, z - a]) if y - x == 1 else off[x : y + 1] - a
        starts, ends, at = K.words(part, o)
        if not len(starts):
            continue
        lo, hi = np.searchsorted(row, [x, y])
        base = at[row[lo:hi] - x] - n[row[lo:hi]]  # words of this row in earlier pieces
        gone = R.flags(np.clip(first[lo:hi] + base, 0, len(starts)), np.clip(last[lo:hi] + base, 0, len(starts)), len(starts))
        stay = np.flatnonzero(~gone)
        size = ends[stay] - starts[stay] + 1
        place = np.append(0, np.cumsum(size))
        src = np.repeat(starts[stay] - place[:-1], size) + np.arange(place[-1])
        out = part[np.minimum(src, len(part) - 1)]
        out[place[1:] - 1] = 32
        cut = place[np.searchsorted(stay, at)]
        for k in range(y - x):
            text[x + k].append(out[cut[k] : cut[k + 1]].tobytes())
        n[x:y] += np.diff(at)
    return [b"".join(t)[:-1] for t in text], n
