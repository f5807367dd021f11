"""numpy kernels over the bytes of an Arrow column: words, rolling hashes, sliding minima.

All hashes are 64 bits wide and depend on content alone, so they agree between tasks and reruns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(0x5EED))
_BASE = U(0x9E3779B97F4A7C15)
#: Value of each byte; ASCII white space is 0 in _WORD_BYTE, so that it adds nothing to a word's sum.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD_BYTE = np.where(_IS_SPACE, U(0), _BYTE)
_pow = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE ** 0 .. n - 1, modulo 2 ** 64."""
    global _pow
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 1 << 12)
        _pow = np.full(size, _BASE, dtype=np.uint64)
        _pow[0] = 1
        _pow = np.multiply.accumulate(_pow)
    return _pow[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets (from 0) of a string or binary array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64 if big else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[off[0] : off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about limit bytes each (a longer row stands alone)."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and n + 1 offsets of each row's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    first[heads] = solid[heads]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    tails = heads[heads > 0] - 1
    last[tails] = solid[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def segment_hash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of values[starts[i]:starts[i + 1]], zeros at its end not counted."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, len(values)))
    place = np.arange(starts[0], len(values)) - np.repeat(starts, sizes)
    scaled = values[starts[0] :] * powers(int(sizes.max()))[place]
    return mix(np.add.reduceat(scaled, starts - starts[0]))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return segment_hash(_WORD_BYTE[data], starts)


def row_words(data: np.ndarray, off: np.ndarray, fold: np.ndarray | None = None, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and n + 1 offsets of each row's; fold: what each byte counts as.

    A long text is cut at white space into pieces, so that what is needed beside the hashes stays small.
    """
    hashes, counts = [], np.zeros(len(off) - 1, np.int64)
    for i, a, b in pieces(data, off, piece):
        part = data[a:b] if fold is None else fold[data[a:b]]
        o = off[i[0] : i[1] + 1] - a if i[1] - i[0] > 1 or b - a == off[i[1]] - off[i[0]] else np.array([0, b - a])
        starts, _, at = words(part, o)
        hashes.append(word_hashes(part, starts))
        counts[i[0] : i[1]] += np.diff(at)
    return np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.append(0, np.cumsum(counts))


def pieces(data: np.ndarray, off: np.ndarray, limit: int) -> Iterator[tuple[tuple[int, int], int, int]]:
    """(rows, first byte, last byte): ranges of whole rows, or parts of a longer row cut behind white space."""
    for x, y in chunks(off, limit):
        a, end = int(off[x]), int(off[y])
        while end - a > limit and y - x == 1:
            b, reach = a + limit, limit
            while True:  # a word may be longer than a piece
                gaps = np.flatnonzero(_IS_SPACE[data[max(a, b - reach) : b]])
                if len(gaps) or b == end:
                    break
                b, reach = min(end, b + limit), limit
            if not len(gaps) or b == end:
                break
            b = max(a, b - reach) + int(gaps[-1]) + 1
            yield (x, y), a, b
            a = b
        yield (x, y), a, end


def byte_hashes(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i : i + n] for each i; length len(h) - n + 1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    p = powers(n + 1)
    out, have, acc = None, 0, h
    size = 1
    while True:
        if n & size:
            if out is None:
                out, have = acc, size
            else:
                m = len(h) - have - size + 1
                out = out[:m] * p[size] + acc[have : have + m]
                have += size
        if size * 2 > n:
            break
        m = len(acc) - size
        acc = acc[:m] * p[size] + acc[size : size + m]
        size *= 2
    return mix(out)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """min(h[i : i + w]) for each i; length len(h) - w + 1."""
    acc, size = h, 1
    while size * 2 <= w:
        acc = np.minimum(acc[:-size], acc[size:])
        size *= 2
    if size < w:
        acc = np.minimum(acc[: len(h) - w + 1], acc[w - size :])
    return acc


class Runs:
    """Windows of `length` units, cut where the least gram hash inside the window changes.

    start: first window of the run (unit index from the row's start), row: its row, n: its windows,
    m: the least gram hash, r: hash of all that the run covers, own: whether m occurs twice in it.
    Equal windows have equal m wherever they stand, so only runs of equal m need comparison.
    """

    __slots__ = ("row", "start", "n", "m", "r", "own")

    def __init__(self, h: np.ndarray, off: np.ndarray, length: int, gram: int):
        w = length - gram + 1
        empty = np.zeros(0, np.int64)
        self.row = self.start = self.n = empty
        self.m = self.r = np.zeros(0, np.uint64)
        self.own = np.zeros(0, bool)
        if len(h) < length:
            return
        g = rolling(h, gram)
        m = sliding_min(g, w)
        win = rolling(h, length)
        counts = np.maximum(np.diff(off) - length + 1, 0)
        rows = np.repeat(np.arange(len(counts)), counts)
        if not len(rows):
            return
        first = np.cumsum(counts) - counts
        local = np.arange(len(rows)) - first[rows]
        at = off[:-1][rows] + local
        mm = m[at]
        cut = np.ones(len(rows), bool)
        cut[1:] = (mm[1:] != mm[:-1]) | (rows[1:] != rows[:-1])
        head = np.flatnonzero(cut)
        size = np.diff(np.append(head, len(rows)))
        if int(size.max()) > w:  # periodic text: no run is longer than one minimum can span
            inside = np.arange(len(rows)) - np.repeat(head, size)
            head = np.flatnonzero(inside % w == 0)
            size = np.diff(np.append(head, len(rows)))
        self.row, self.start, self.n, self.m = rows[head], local[head], size, mm[head]
        self.r = segment_hash(win[at] | U(1), head)
        own = np.zeros(len(head), bool)
        begin, reach = at[head], size + w - 1
        step = max(1, (1 << 19) // (2 * w))
        for a in range(0, len(head), step):
            b = slice(a, a + step)
            span = np.arange(int(reach[b].max()))
            where = np.minimum(begin[b, None] + span, len(g) - 1)
            own[b] = ((g[where] == self.m[b, None]) & (span < reach[b, None])).sum(axis=1) > 1
        self.own = own
