"""Quality rules with weak supervision (operator 8).

Each rule votes good, bad or abstains. How often each rule says what about good and about bad documents
is estimated by expectation maximisation over the counts of vote patterns of the whole corpus (there are
at most 3 ** rules of them). A document is kept if its posterior probability of being good is high
enough, not if it meets every rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm import kernels as K
from pairloom.llm.common import arrow_batches, boxed, materialize, unboxed

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_stops", "n_shouts", "n_other")
#: Bytes of text that are looked at together.
_PIECE = 1 << 20
_table = np.zeros(256, bool)


def _flags(chars: bytes | range) -> np.ndarray:
    t = _table.copy()
    t[list(chars)] = True
    return t


_SYMBOL = _flags(b"#*$%&|<>")
_UPPER = _flags(range(65, 91))
_LETTER = _flags([*range(65, 91), *range(97, 123)])
_STOP, _SHOUT = _flags(b".!?:;\"'"), _flags(b"!")


def _line_sums(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """By line: words, their code points, symbols, capitals, letters, shouts, bytes that begin other scripts, and the last byte of its last word (0: none)."""
    starts, ends, at = K.words(data, off)
    per = lambda flags: np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[off])
    two = np.zeros(len(data), bool)  # Latin letters of two bytes; the capitals are C3 80 .. C3 9E
    two[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    big = two.copy()
    big[:-1] &= data[1:] <= 0x9E
    n = np.diff(at)
    last = np.zeros(len(n), np.uint8)
    last[n > 0] = data[ends[at[1:][n > 0] - 1] - 1]
    return [n, per(~K._IS_SPACE[data] & ((data & 0xC0) != 0x80)), per(_SYMBOL[data]), per(_UPPER[data] | big), per(_LETTER[data] | two), per(_SHOUT[data]), per(data >= 0xC8), last]


def _line_hash(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    return K.segment_hash(np.where(data == 10, K.U(0), K._BYTE[data]), off[:-1])


def _lines(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """_line_sums and a hash of each line; lines go by in groups, and a very long one in pieces, so little is held beside the text."""
    sums, hashes = [], []
    for x, y in K.chunks(off, _PIECE):
        part, o = data[off[x] : off[y]], off[x : y + 1] - off[x]
        if len(part) <= _PIECE or y - x > 1:
            sums.append(_line_sums(part, o))
            hashes.append(_line_hash(part, o))
            continue
        total = [np.zeros(1, np.int64) for _ in range(7)] + [np.zeros(1, np.uint8)]
        for _, a, z in K.pieces(part, o, _PIECE):
            now = _line_sums(part[a:z], np.array([0, z - a]))
            total = [t + u for t, u in zip(total[:7], now[:7])] + [now[7] if now[7][0] else total[7]]
        sums.append(total)
        whole = part[:-1] if part[-1] == 10 else part  # longer lines than _PIECE have a hash of their own kind
        hashes.append(np.frombuffer(hashlib.blake2b(whole.tobytes(), digest_size=8).digest(), np.uint64))
    return [np.concatenate(c) for c in zip(*sums)] if sums else [np.zeros(0, np.int64)] * 8, np.concatenate(hashes or [np.zeros(0, np.uint64)])


def measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """FEATURES of each row of UTF-8 text."""
    rows = len(off) - 1
    # lines: from each row's start and after each line feed
    feed = np.flatnonzero(data == 10) + 1
    heads = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], feed[feed < len(data)])))
    line_row = np.searchsorted(off, heads, side="right") - 1
    (n, chars, symbols, upper, letters, shouts, other, last), h = _lines(data, np.append(heads, len(data)))
    per = lambda c: np.bincount(line_row, weights=c, minlength=rows).astype(np.int64)
    full = n > 0
    key = K.mix(h[full] ^ (line_row[full].astype(np.uint64) * K._BASE))
    n_lines = np.bincount(line_row[full], minlength=rows)
    n_dup = n_lines - np.bincount(line_row[full][np.unique(key, return_index=True)[1]], minlength=rows)
    n_stop = np.bincount(line_row[full][_STOP[last[full]]], minlength=rows)
    # words in 3-word windows that occur twice in the row
    repeat = np.zeros(rows, np.int64)
    words, at = K.row_words(data, off)
    if len(words) >= 3:
        g = K.rolling(words, 3)
        row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(at))
        inside = np.flatnonzero(row[2:] == row[:-2])
        keys = K.mix(g[inside] ^ (row[inside] * K._BASE))
        ordered = np.sort(keys)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(again):
            twice = inside[again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys]
            hit = np.zeros(len(words), bool)
            for j in range(3):
                hit[twice + j] = True
            repeat = np.diff(np.append(0, np.cumsum(hit))[at])
    return [per(n), per(chars), per(symbols), n_dup, repeat, n_lines, per(upper), per(letters), n_stop, per(shouts), per(other)]


def with_features(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns `carry` of docs (of any type) and FEATURES, all long. Null text: all 0."""
    arrow_batches(docs.sparkSession)
    src = docs.select(*carry) if "text" in carry else docs.select(*carry, "text")
    fields = [src.schema[c] for c in carry] + [T.StructField(f, T.LongType()) for f in FEATURES]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = K.column_bytes(b.column("text"))
            for x, y in K.chunks(off):
                made = measure(data[off[x] : off[y]], off[x : y + 1] - off[x])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(x, y - x) for c in carry), *(pa.array(np.asarray(v, dtype=np.int64)) for v in made)], [*carry, *FEATURES])

    return src.mapInArrow(go, T.StructType(fields))


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(x: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 2).otherwise(1)


def rules() -> dict[str, Column]:
    """Votes: 0 bad, 1 abstain, 2 good."""
    mean, symbols, dups = _share("word_chars", "n_words"), _share("n_symbols", "n_words"), _share("n_dup_lines", "n_lines")
    repeats, upper, letters = _share("n_repeat_words", "n_words"), _share("n_upper", "n_letters"), _share("n_letters", "word_chars")
    stops, shouts = _share("n_stops", "n_lines"), _share("n_shouts", "n_words")
    latin = 3 * F.col("n_other") < F.col("word_chars")  # rules on letters and sentence ends abstain on other scripts
    return {
        "word_length": _vote(mean, (mean >= 3) & (mean <= 10), (mean < 2.5) | (mean > 14)),
        "symbols": _vote(symbols, symbols <= 0.02, symbols > 0.15),
        "dup_lines": _vote(dups, dups <= 0.05, dups > 0.3),
        "repeats": _vote(repeats, repeats <= 0.1, repeats > 0.3),
        "capitals": _vote(upper, latin & (upper <= 0.12), latin & (upper > 0.4)),
        "letters": _vote(letters, latin & (letters >= 0.85), latin & (letters < 0.7)),
        "sentences": _vote(stops, latin & (stops >= 0.7), latin & (stops < 0.1)),
        "shouting": _vote(shouts, shouts <= 0.02, shouts > 0.15),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[float, np.ndarray]:
    """Log prior odds of good, and log ratios [rule, vote] of how good and bad documents are voted on.

    Starts from each pattern's share of good votes. Vote shares are smoothed by a few documents that
    follow the rule's meaning, so rules that never disagree stay finite and classes keep their names.
    """
    if not len(counts) or counts.sum() == 0:
        return 2.0, np.tile(np.array([-1.0, 0.0, 0.5]), (patterns.shape[1] if patterns.ndim > 1 else 0, 1))
    one = np.eye(3)[patterns]  # pattern, rule, vote
    good, bad = (patterns == 2).sum(1), (patterns == 0).sum(1)
    p = (good + 1.0) / (good + 2.0 * bad + 1.5)
    prior_good, prior_bad = np.array([0.2, 1.0, 4.0]), np.array([2.0, 1.0, 1.0])
    odds, ratio = 0.0, None
    for _ in range(rounds):
        a = np.einsum("p,prv->rv", counts * p, one) + prior_good
        b = np.einsum("p,prv->rv", counts * (1 - p), one) + prior_bad
        ratio = np.log(a / a.sum(1, keepdims=True)) - np.log(b / b.sum(1, keepdims=True))
        ratio[:, 0], ratio[:, 2] = np.minimum(ratio[:, 0], 0), np.maximum(ratio[:, 2], 0)  # no rule may speak against itself
        share = np.clip((counts @ p + 1) / (counts.sum() + 2), 0.02, 0.98)
        odds = float(np.log(share / (1 - share)))
        p = 1 / (1 + np.exp(-np.clip(odds + np.einsum("rv,prv->p", ratio, one), -50, 50)))
    return odds, ratio


def fit(features: DataFrame) -> Column:
    """The posterior probability of good, as a column over FEATURES, fitted on all rows that pass base_failed()."""
    votes = rules()
    table = features.filter(~base_failed()).groupBy(*[v.alias(k) for k, v in votes.items()]).count().collect()  # at most 3 ** 8 rows
    patterns = np.array([[r[k] for k in votes] for r in table], dtype=int).reshape(-1, len(votes))
    odds, ratio = estimate(patterns, np.array([r["count"] for r in table], dtype=float))
    logit = F.lit(odds)
    for i, v in enumerate(votes.values()):
        logit = logit + F.when(v == 0, float(ratio[i, 0])).when(v == 2, float(ratio[i, 2])).otherwise(float(ratio[i, 1]))
    return 1 / (1 + F.exp(-logit))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, FEATURES, base_failed, posterior, kept.

    Null or empty text: no words, so it fails the base rules. Other columns are ignored; repeated rows are
    judged alike; empty docs give no rows.
    """
    f = materialize(with_features(docs, ["doc_id"]), "features")
    p = fit(f)
    return f.withColumn("base_failed", base_failed()).withColumn("posterior", p).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def filter_documents(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' columns. Texts pass Python twice, not the shuffle.

    Rows without words go; repeated rows are judged alike; empty docs give no rows.
    """
    p = fit(with_features(docs, ["doc_id"]))
    out = with_features(boxed(docs), ["doc_id", "text", "rest"])
    return unboxed(out.filter(~base_failed() & (p >= least)), docs.columns)
