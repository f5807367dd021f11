"""Exact search for repeated windows of words or bytes, without sorting every suffix.

A document is cut into runs of windows that share their least gram hash (kernels.Runs). Equal windows
have equal minima, so each minimum names a *block* of the corpus, and a window can repeat only
inside its block. Only 1 / w of all positions is shuffled, and only hashes; texts move twice, by document.

Steps, each written to the shared folder: runs of all documents; candidate runs, whose block holds
more than one run; classes of equal runs; contested runs (the first of each class in a block of
several classes), whose windows are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import kernels as K
from pairloom.llm.common import arrow_batches, materialize, release

_SHIFT = 21
#: Windows of a long text that are looked at together.
PART = 1 << 18


@dataclass(frozen=True)
class Unit:
    """What a window is made of: bytes or words; its length and the gram that anchors it."""

    kind: str
    length: int
    gram: int

    def hashes(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "byte":
            return K.byte_hashes(data), off
        return K.row_words(data, off)

    def parts(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, first, bytes, hashes, offsets): rows x .. y - 1, or of a long row the units from `first` on.

        Parts of a long row hold PART windows, and the units that these cover, so neighbours overlap.
        """
        for x, y in K.chunks(off):
            part, o = data[off[x] : off[y]], off[x : y + 1] - off[x]
            if y - x > 1 or len(part) <= 2 * PART:
                yield (x, y, 0, part, *self.hashes(part, o))
                continue
            whole = part if self.kind == "byte" else self.hashes(part, o)[0]
            for a in range(0, max(1, len(whole) - self.length + 1), PART):
                piece = whole[a : a + PART + self.length - 1]
                yield x, y, a, piece, (K.byte_hashes(piece) if self.kind == "byte" else piece), np.array([0, len(piece)])


def pack(start: np.ndarray, n: np.ndarray, own: np.ndarray | int = 0) -> np.ndarray:
    return (start << _SHIFT) | (n << 1) | own


def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and numbers of windows."""
    return p >> _SHIFT, (p >> 1) & ((1 << (_SHIFT - 1)) - 1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def runs_of(docs: DataFrame, unit: Unit) -> DataFrame:
    """(m, r, rid, pack) of every run in docs(rid, text)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            data, off = K.column_bytes(b.column("text"))
            for x, y, first, _, h, at in unit.parts(data, off):
                q = K.Runs(h, at, unit.length, unit.gram)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (_signed(q.m), _signed(q.r), rid[x:y][q.row], pack(q.start + first, q.n, q.own.astype(np.int64)))], ["m", "r", "rid", "pack"])

    return docs.select("rid", "text").mapInArrow(go, "m long, r long, rid long, pack long")


def candidates(docs: DataFrame, unit: Unit) -> DataFrame:
    """Runs whose block holds another run, or a repeat of its own; multi: the block may hold several classes."""
    runs = materialize(runs_of(docs, unit), "runs")
    blocks = (
        runs.groupBy("m")
        .agg(F.count("*").alias("c"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.max(F.col("pack") % 2).alias("own"))
        .filter("c > 1 OR own = 1")
        .select("m", F.expr("lo <> hi OR own = 1").alias("multi"))
    )
    out = materialize(runs.join(blocks, "m"), "candidates")
    release(runs)
    return out


def classes(cand: DataFrame) -> DataFrame:
    """Per class of equal runs: its earliest run (f.rid, f.pack), its size c, and multi."""
    return materialize(
        cand.groupBy("m", "r").agg(F.min(F.struct("rid", "pack")).alias("f"), F.count("*").alias("c"), F.max("multi").alias("multi")),
        "classes",
    )


def contested(docs: DataFrame, cls: DataFrame) -> DataFrame:
    """docs(rid, text) that hold contested runs, with marks: array of (pack, m, c)."""
    per_doc = (
        cls.filter("multi")
        .select(F.col("f.rid").alias("rid"), F.struct(F.col("f.pack").alias("pack"), "m", "c").alias("mark"))
        .groupBy("rid")
        .agg(F.collect_list("mark").alias("marks"))
    )
    return docs.select("rid", "text").join(per_doc, "rid")


def _marks(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, pack, m and c of each mark."""
    col = b.column("marks")
    off = np.asarray(col.offsets, dtype=np.int64)
    flat = col.values.slice(off[0], off[-1] - off[0])
    row = np.repeat(np.arange(len(col)), np.diff(off))
    return (row, *(flat.field(k).to_numpy(zero_copy_only=False) for k in ("pack", "m", "c")))


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first[i], first[i] + 1, .. (n[i] of them) for all i, and the i of each."""
    i = np.repeat(np.arange(len(n)), n)
    return first[i] + np.arange(len(i)) - (np.cumsum(n) - n)[i], i


def _contested_chunks(b: pa.RecordBatch, unit: Unit):
    """By part: unit hashes, bytes, and of each mark the row, first unit, place in the part, windows, m, c. Runs never span parts."""
    data, off = K.column_bytes(b.column("text"))
    row, p, m, c = _marks(b)
    start, n = unpack(p)
    order = np.lexsort((start, row))
    row, m, c, start, n = row[order], m[order], c[order], start[order], n[order]
    for x, y, first, part, h, at in unit.parts(data, off):
        a, z = np.searchsorted(row, [x, y])
        if first or (y - x == 1 and z > a and len(h) == PART + unit.length - 1):
            a, z = a + np.searchsorted(start[a:z], [first, first + PART])
        if a < z:
            yield h, part, row[a:z], start[a:z], at[row[a:z] - x] + start[a:z] - first, n[a:z], m[a:z], c[a:z]


def windows_of(marked: DataFrame, unit: Unit) -> DataFrame:
    """(m, w, rid, p, c): hash w of each window p of the contested runs."""

    def go(batches):
        for b in batches:
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            for h, _, row, start, first, n, m, c in _contested_chunks(b, unit):
                win = K.rolling(h, unit.length)
                at, i = _spread(first, n)
                p = at - first[i] + start[i]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (m[i], _signed(win[at]), rid[row[i]], p, c[i])], ["m", "w", "rid", "p", "c"])

    return marked.mapInArrow(go, "m long, w long, rid long, p long, c long")


def contexts_of(marked: DataFrame, unit: Unit) -> DataFrame:
    """(lead, m, rid, p, n, a, ctx): the bytes, or word hashes of 8 bytes each, that the n windows from p on cover, for each contested run.

    The anchor (the gram of hash m) starts at unit a of ctx; lead are its first 8 bytes (of words: m). A run in
    which the anchor occurs again is cut, so that a is the first occurrence in each of the n windows.
    """
    wide = 1 if unit.kind == "byte" else 8

    def go(batches):
        for b in batches:
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            for h, data, row, start, first, n, m, _c in _contested_chunks(b, unit):
                gram = _signed(K.rolling(h, unit.gram))
                for x in range(0, len(n), 4096):
                    s = slice(x, x + 4096)
                    at, i = _spread(first[s], n[s] + unit.length - unit.gram)
                    hit = np.flatnonzero(gram[at] == m[s][i])
                    i, o = i[hit] + x, at[hit]
                    again = np.append(False, i[1:] == i[:-1])
                    begin = np.where(again, np.append(0, o[:-1]) + 1, first[i])
                    size = np.minimum(o, first[i] + n[i] - 1) - begin + 1
                    i, o, begin, size = (z[size > 0] for z in (i, o, begin, size))
                    at, _i = _spread(begin, size + unit.length - 1)
                    off = pa.py_buffer((wide * np.append(0, np.cumsum(size + unit.length - 1))).astype(np.int32))
                    ctx = pa.Array.from_buffers(pa.binary(), len(size), [None, off, pa.py_buffer((data if wide == 1 else h)[at])])
                    lead = np.zeros(len(o), np.int64) if wide == 1 else m[i]
                    for j in range(8 if wide == 1 else 0):
                        lead = (lead << 8) | data[o + j]
                    cols = (lead, m[i], rid[row[i]], start[i] + begin - first[i], size, o - begin)
                    yield pa.RecordBatch.from_arrays([*(pa.array(z) for z in cols), ctx], ["lead", "m", "rid", "p", "n", "a", "ctx"])

    return marked.mapInArrow(go, "lead long, m long, rid long, p long, n long, a long, ctx binary")


def by_document(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs(rid, doc_id, text) with marks: array of packs from spans(rid, pack), null if there are none."""
    return docs.select("rid", "doc_id", "text").join(spans.groupBy("rid").agg(F.collect_list("pack").alias("marks")), "rid", "left")


def removed(marks: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last + 1 unit of the maximal runs that marked windows cover, in order; touching ones are one run."""
    off = np.asarray(marks.offsets, dtype=np.int64)
    p = marks.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False) if len(off) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(marks)), np.diff(off))
    start, n = unpack(p)
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    end = (start + n[order] - 1 + length).astype(np.int64)
    if not len(row):
        return row, start, end
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(row * span + end) - row * span
    head = np.ones(len(row), bool)
    head[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(head)
    return row[at], start[at], reach[np.append(at[1:], len(row)) - 1]


def flags(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Whether each of `size` units lies in one of the runs, which do not overlap."""
    out = np.zeros(size + 1, np.int8)
    real = last > first
    out[first[real]] += 1
    out[last[real]] -= 1
    return np.cumsum(out, out=out)[:-1].view(bool)


def span_lists(row: np.ndarray, first: np.ndarray, last: np.ndarray, rows: int) -> pa.Array:
    """array<struct<start, length>> by row."""
    at = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.array(first.astype(np.int64)), pa.array((last - first).astype(np.int64))], ["start", "length"]))


def prepare(docs: DataFrame) -> None:
    arrow_batches(docs.sparkSession)
