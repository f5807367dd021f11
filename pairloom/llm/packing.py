"""Best-fit packing of tokenised documents into sequences (operator 2).

Bounded-space online best fit: a fixed number of bins is open, their free space marked in a bitset (bit f
is set if a bin with f free places is open). A piece goes to the bin with the least free space that
holds it, found by a shift and the lowest set bit. If none does and all bins are taken, the fullest
bin closes first. Bins hold their pieces until they close, so memory is bounded by open bins.
What is still open when a partition ends is packed once more across partitions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import kernels as K
from pairloom.llm.common import arrow_batches, materialize

_SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_SECOND_ROUND = 1 << 62


class Memo:
    """Token ids of texts, as little-endian uint32 bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in a
    row. A word of letters and then marks is two units, Latin letters in lower case. Arrow finds the
    distinct words and units of a batch and lays out the ids; only units not known yet are encoded, those
    of letters many at a time: each ends with the only token that closes a word. At most 2 * `limit` units,
    in two generations, are remembered.
    """

    TAIL = ",.;:!?*$#%&|<>"
    LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    #: Letters that lower case and normal form leave letters (so not U+0130); words of others are one unit.
    LETTERS = LATIN + "\u0100-\u012f\u0131-\u0148\u014a-\u017e\u0391-\u03a1\u03a3-\u03c9\u0400-\u045f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.letters = re.compile(f"[{self.LETTERS}]+")
        self.closes = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.older: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {"": b""}

    def _letters(self, words: list[str]) -> None:
        for a in range(0, len(words), 1000):
            part = words[a : a + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cut = np.flatnonzero(self.closes[ids]) + 1
            if len(cut) == len(part) and cut[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(4 * cut).tolist()]
                self.units.update(zip(part, (raw[x:y] for x, y in zip(at, at[1:]))))
            else:
                self._each(part)

    def _each(self, words: list[str]) -> None:
        for a in range(0, len(words), 5000):
            part = words[a : a + 5000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.units[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _ids(self, units: pa.Array) -> pa.Array:
        d = units.dictionary_encode()
        names, letters, other = d.dictionary.to_pylist(), [], []
        for u in names:
            if u not in self.units:
                if u in self.older:
                    self.units[u] = self.older[u]
                else:
                    (letters if self.letters.fullmatch(u) else other).append(u)
        self._letters(letters)
        self._each(other)
        return pa.array([self.units[u] for u in names], pa.large_binary()).take(d.indices)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Null counts as empty."""
        data, off = K.column_bytes(texts)
        words, at = _split(data, off)
        d = words.dictionary_encode()
        core = pc.utf8_rtrim(d.dictionary, self.TAIL)
        plain, latin = (pc.match_substring_regex(core, f"^[{chars}]+$") for chars in (self.LETTERS, self.LATIN))
        unit = pc.if_else(plain, pc.if_else(latin, pc.utf8_lower(core), core), d.dictionary)
        tail = pc.if_else(plain, _after(d.dictionary, core), "")
        ids = pc.binary_join_element_wise(self._ids(unit), self._ids(tail), pa.scalar(b"", pa.large_binary())).take(d.indices)
        raw, cut = K.column_bytes(ids)
        cut = cut[at].tolist()
        if len(self.units) > self.limit:
            self.older, self.units = self.units, {"": b""}
        return [raw[x:y].tobytes() for x, y in zip(cut, cut[1:])]


class Plain:
    """Token ids of whole texts, by any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: pa.Array) -> list[bytes]:
        out = []
        for t in texts.to_pylist():  # one at a time: texts may be long
            out.append(np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes())
        return out


# What a tokenizer's description says where Memo's way of reading words is right.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: Added tokens that lie inside one unit wherever they stand: marks, letters, marks.
_ADDED = re.compile(r"<\|[A-Za-z0-9_]+\|>")


def by_units(tokenizer) -> bool:
    """Whether the tokenizer treats words apart as Memo does, by its own description.

    Text is put in normal and lower case, cut into letters, digits and marks, and a token closes each word; added tokens are
    matched in the text as it is, and none holds white space or is of letters alone. Anything else, and whole texts are encoded.
    """
    d = json.loads(tokenizer.to_str())
    model = {k: v for k, v in d["model"].items() if k not in ("vocab", "merges")}
    added = all(_ADDED.fullmatch(t["content"]) and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in d["added_tokens"])
    same = (d["normalizer"], d["pre_tokenizer"], model) == (_NORMALIZER, {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}, _MODEL)
    return added and same and d.get("truncation") is None and d.get("padding") is None


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    off = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data)))


def _split(data: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Stretches between spaces and line feeds, and n + 1 offsets of each row's; other white space is left to the tokenizer."""
    solid = (data != 32) & (data != 10)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    filled = np.append(0, np.cumsum(solid))
    return _strings(data[solid], np.diff(np.append(filled[starts], filled[-1]))), np.searchsorted(starts, off)


def _after(whole: pa.Array, head: pa.Array) -> pa.Array:
    """What follows head in whole, of which it is a prefix."""
    data, off = K.column_bytes(whole)
    sizes, skip = np.diff(off), np.diff(K.column_bytes(head)[1])
    place = np.arange(len(data)) - np.repeat(off[:-1], sizes)
    return _strings(data[place >= np.repeat(skip, sizes)], sizes - skip)


@lru_cache(maxsize=1)
def worker_memo(path: str) -> Memo | Plain:
    """One for all tasks of a Python worker: the tokenizer is loaded once, and units stay known."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return Memo(path) if by_units(tokenizer) else Plain(tokenizer)


class Bins:
    """Open bins of `size` places. put() returns the pieces of a bin that it had to close, or of one that is full."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.open = size, limit, 0
        self.bits, self.by_free = 0, [[] for _ in range(size + 1)]

    def _take(self, free: int) -> list:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        return found

    def put(self, length: int, piece) -> list[list]:
        fits, closed = self.bits >> length, []
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            held = self._take(free)
        else:
            if self.open == self.limit:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))  # least free space: the fullest
                self.open -= 1
            free, held = self.size, []
            self.open += 1
        held.append(piece)
        free -= length
        if free:
            self.by_free[free].append(held)
            self.bits |= 1 << free
        else:
            closed.append(held)
            self.open -= 1
        return closed

    def rest(self) -> list[list]:
        out = [held for stack in self.by_free for held in stack]
        self.by_free, self.bits, self.open = [[] for _ in range(self.size + 1)], 0, 0
        return out


class _Rows:
    """Collects rows of pieces and yields them as Arrow batches of bounded size."""

    def __init__(self, first_id: int):
        self.next_id, self.rows, self.weight = first_id, [], 0

    def add(self, held: list, numbered: bool = True) -> None:
        at = 0
        for doc_id, piece, start, length, ids in held:
            self.rows.append((doc_id, piece, start, length, ids, self.next_id if numbered else None, at if numbered else None))
            at += length
            self.weight += len(ids)
        self.next_id += numbered

    def batches(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.rows and self.weight >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), _ARROW)], schema=_ARROW)
            self.rows, self.weight = [], 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, size: int = 2048, open_bins: int = 512, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (uint32, little-endian), sequence_id, offset.

    A document is its ids and end_id; only if longer than `size` is it cut, into pieces of `size`, the
    last one shorter. Null text counts as empty: one piece, end_id alone. Repeated or null doc_ids are
    separate documents. Other columns are ignored. Empty docs give no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bins = worker_memo(path), Bins(size, open_bins)
        out = _Rows(TaskContext.get().partitionId() << 36)
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                pieces = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), memo.encode(part.column("text"))):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        one = ids[at : at + 4 * size]
                        pieces.append((doc_id, k, at // 4, len(one) // 4, one))
                pieces.sort(key=lambda p: -p[3])
                for p in pieces:
                    for held in bins.put(p[3], p):
                        out.add(held)
                yield from out.batches(1 << 21)
        for held in bins.rest():
            out.add(held, numbered=False)
        yield from out.batches(0)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, out = Bins(size, open_bins), _Rows(_SECOND_ROUND | TaskContext.get().partitionId() << 36)
        for b in batches:
            for p in zip(*(b.column(k).to_pylist() for k in ("doc_id", "piece", "start", "length", "ids"))):
                for held in bins.put(p[3], p):
                    out.add(held)
            yield from out.batches(1 << 21)
        for held in bins.rest():
            out.add(held)
        yield from out.batches(0)

    done = materialize(docs.select("doc_id", "text").mapInArrow(first, _SCHEMA), "packed")
    rest = done.filter("sequence_id IS NULL")
    tokens = rest.agg(F.sum("length")).first()[0] or 0
    parts = max(1, round(tokens / size / 4000))
    again = rest.repartition(parts, "doc_id", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "piece").mapInArrow(second, _SCHEMA)
    return done.filter("sequence_id IS NOT NULL").unionByName(again)
