"""Dedup of byte strings by sparse suffix sorting (operator 9).

A suffix array of every byte would take hundreds of times the text, since each suffix carries its leading
400 bytes. So suffixes are taken at content-defined anchors only (kernels.Runs), which equal strings share
at equal places. Runs of strings that are equal as a whole are first resolved by a group-by on their
hash. Of the rest, one run of each variant with the bytes around it, suffixes that start at the anchor
are range-partitioned by their leading bytes (sampled splitters). Buckets put the suffixes of an anchor in
lexicographic order by multikey quicksort, and the reversed ones that end there too; what neighbours
share tells which strings around the anchor stand in another place (_block). Bytes are compared, not hashes.
No comparison across bucket boundaries is left: suffixes that agree in their anchor (24 bytes, its hash)
never straddle one, and others hold no common string.
Anchors with very many variants would make one task long: their strings go through a hash
aggregation over (anchor, string) instead, which splits at will.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import kernels as K
from pairloom.llm import repeats as R
from pairloom.llm.common import keyed, materialize, release

#: More variants than this of one anchor are compared by aggregation.
HOT_VARIANTS = 20_000
#: Fewer contexts than this are compared in pairs, which takes less time than sorting them; the result is the same.
FEW = 40


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Rows of words (a row of 8-byte keys each) in order: multikey quicksort, only what ties on one key is sorted by the next."""
    order = np.argsort(words[:, 0], kind="stable")
    new = np.append(True, words[order[1:], 0] != words[order[:-1], 0])
    for k in range(1, words.shape[1]):
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        own = words[order[tied], k]
        sub = np.lexsort((own, group))
        order[tied] = order[tied[sub]]
        own, group = own[sub], group[sub]
        new[tied[1:]] |= (own[1:] != own[:-1]) | (group[1:] != group[:-1])
    return order


def _sorted_suffixes(parts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each part in lexicographic order, and what each shares with the one before it in that order."""
    wide = -(-width // 8) * 8
    m = np.zeros((len(parts), wide), np.uint8)
    for i, x in enumerate(parts):
        m[i, : len(x)] = x
    order = multikey_order(m.view(">u8"))
    m = m[order]
    shared = np.zeros(len(parts), np.int64)
    for x in range(1, len(m), 4096):
        other = m[x : x + 4096] != m[x - 1 : x + 4095][: len(m[x : x + 4096])]
        shared[x : x + 4096] = np.where(other.any(axis=1), other.argmax(axis=1), wide)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, shared


def _common(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    other = np.flatnonzero(x[:n] != y[:n])
    return int(other[0]) if len(other) else n


def _block(ctx: list[np.ndarray], a: np.ndarray, n: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(context, first window, windows) of strings that stand in another context too; contexts have one anchor, at byte a.

    A string with k bytes before the anchor repeats if another context agrees in k bytes to the left and in
    length - k from the anchor on: suffixes that start at the anchor are sorted, and so are the reversed
    ones that end there; what neighbours share says which contexts agree so far.
    """
    low, high = a - n + 1, a  # the bytes before the anchor in a context's last and first window
    lefts, rights = [c[:x][::-1] for c, x in zip(ctx, a.tolist())], [c[x:] for c, x in zip(ctx, a.tolist())]
    v = len(ctx)
    out = []
    if v < FEW:
        hit: list[list[tuple[int, int]]] = [[] for _ in range(v)]
        for i in range(v):
            for j in range(i):
                lo, hi = max(low[i], low[j], length - _common(rights[i], rights[j])), min(high[i], high[j])
                if lo <= hi:
                    hi = min(hi, _common(lefts[i], lefts[j]))
                    if lo <= hi:
                        hit[i].append((int(lo), int(hi)))
                        hit[j].append((int(lo), int(hi)))
        for i, spans in enumerate(hit):
            end = None
            for lo, hi in sorted(spans):
                if end is not None and lo <= end + 1:
                    end = max(end, hi)
                else:
                    if end is not None:
                        out.append((i, int(a[i]) - end, end - start + 1))
                    start, end = lo, hi
            if end is not None:
                out.append((i, int(a[i]) - end, end - start + 1))
        return out
    (pr, sr), (pl, sl) = _sorted_suffixes(rights, length), _sorted_suffixes(lefts, length)
    least = int(low.min())
    flags = np.zeros((v, int(high.max()) - least + 2), bool)
    for k in range(least, int(high.max()) + 1):
        here = np.flatnonzero((low <= k) & (k <= high))
        if len(here) < 2:
            continue
        key = np.cumsum(sr < length - k)[pr[here]] * (v + 1) + np.cumsum(sl < k)[pl[here]]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.append(same, False) | np.append(False, same)
        flags[here[order[twice]], k - least] = True
    edge = np.diff(flags.astype(np.int8), axis=1, prepend=0)
    i, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1]
    return [(int(r), int(a[r]) - (least + y - 1), y - x) for r, x, y in zip(i.tolist(), first.tolist(), last.tolist())]


def _bucket_sort(batches, length: int):
    """Rows (lead, m, rid, p, n, a, ctx), sorted by (lead, m), to spans (rid, pack) of repeated windows.

    A block of one anchor is held; it ends where lead or m changes, also across batches.
    """
    rids, packs = [], []

    def close(held: list[tuple[np.ndarray, ...]]) -> None:
        if len(held) > 1:
            rid, p, n, a = (np.array(c) for c in zip(*(h[:4] for h in held)))
            for i, first, size in _block([h[4] for h in held], a, n, length):
                rids.append(int(rid[i]))
                packs.append(R.pack(int(p[i]) + first, size))

    held, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        data, off = K.column_bytes(b.column("ctx"))
        lead, m, rid, p, n, a = (b.column(k).to_numpy().tolist() for k in ("lead", "m", "rid", "p", "n", "a"))
        for i, (x, y) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            if (lead[i], m[i]) != last:
                close(held)
                held, last = [], (lead[i], m[i])
            held.append((rid[i], p[i], n[i], a[i], data[x:y]))
        if len(rids) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(packs, pa.int64())], ["rid", "pack"])
            rids.clear()
            packs.clear()
    close(held)
    yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(packs, pa.int64())], ["rid", "pack"])


def repeated_spans(docs: DataFrame, unit: R.Unit, hot_variants: int) -> DataFrame:
    """(rid, pack) of all windows whose bytes stand at two places or more."""
    cand = R.candidates(docs, unit)
    cls = R.classes(cand)
    whole = cand.join(cls.filter("c > 1").select("m", "r"), ["m", "r"]).select("rid", "pack")
    hot = cls.filter("multi").groupBy("m").count().filter(F.col("count") > hot_variants).select("m")
    marked = cls.join(hot.withColumn("hot", F.lit(True)), "m", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    ctx = materialize(R.contexts_of(R.contested(docs, marked.filter("NOT hot")), unit), "contexts")
    near = ctx.repartitionByRange("lead", "m").sortWithinPartitions("lead", "m").mapInArrow(lambda it: _bucket_sort(it, unit.length), "rid long, pack long")
    parts = whole.unionByName(near)
    if hot.limit(1).count():
        win = materialize(R.windows_of(R.contested(docs, marked.filter("hot")), unit), "windows")
        twice = win.groupBy("m", "w").count().filter("count > 1").select("m", "w")
        parts = parts.unionByName(win.join(twice, ["m", "w"]).select("rid", (F.shiftleft("p", R._SHIFT) + 2).alias("pack")))
    spans = materialize(parts, "spans")
    for x in (cand, cls, ctx):
        release(x)
    return spans


def dedup_bytes(docs: DataFrame, length: int = 400, gram: int = 24, hot_variants: int = HOT_VARIANTS) -> DataFrame:
    """Removes every byte of the UTF-8 texts that a repeated string of `length` bytes covers.

    A string repeats if it also starts anywhere else, same document included; all its places are
    removed. One row per row of docs: doc_id, n_bytes, n_removed, kept (binary), spans (removed
    runs of bytes, from 0). Null text: no bytes. Repeated or null ids are separate documents. Long texts
    are read in pieces. Other columns are ignored. Empty docs give no rows.
    """
    R.prepare(docs)
    unit = R.Unit("byte", length, gram)
    docs = keyed(docs.select("doc_id", "text"))
    spans = repeated_spans(docs, unit, hot_variants)

    def cut(batches):
        for b in batches:
            data, off = K.column_bytes(b.column("text"))
            for x, y in K.chunks(off):
                o, part = off[x : y + 1] - off[x], data[off[x] : off[y]]
                row, first, last = R.removed(b.column("marks").slice(x, y - x), length)
                lost = np.bincount(row, weights=last - first, minlength=y - x).astype(np.int64)
                n = np.diff(o)
                left = part[~R.flags(o[row] + first, o[row] + last, len(part))] if len(row) else part
                kept = pa.Array.from_buffers(pa.binary(), y - x, [None, pa.py_buffer(np.append(0, np.cumsum(n - lost)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(left))])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(x, y - x).cast(pa.int64()), pa.array(n), pa.array(lost), kept, R.span_lists(row, first, last, y - x)], ["doc_id", "n_bytes", "n_removed", "kept", "spans"])

    return R.by_document(docs, spans).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,length:long>>")
