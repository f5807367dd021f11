"""Toxicity by a weighted lexicon (operator 13).

Texts are folded (letters of other scripts that look like Latin ones, full-width forms, digits and signs inside words
that stand for letters, case), and the lexicon is found in them by an Aho-Corasick automaton at the starts of words. A term
is a word or what words begin with; its weight is the log ratio of how often toxic and other documents have it.
Exception phrases (the word itself, or it with the word before or after) undo a hit. A text's score is a logistic function of its weight
and of its weight by length.

Lexicon, exceptions and coefficients are learned from labels. They are fitted on at most `sample` labelled rows, of which near copies
(same least hash of five words in a row) count once; all documents are scored, over their whole texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm import kernels as K
from pairloom.llm.common import arrow_batches, materialize, release

# Letters that look like Latin ones (Cyrillic and Greek), and signs that stand for letters.
LOOKALIKES = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_FOLD = {ord(c): x for a, x in LOOKALIKES.items() for c in (a, a.upper()) if len(c) == 1 and c != x and not c.isascii()} | {0x130: "i"}
_FOLD |= {c: unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFF5F)}
_FOREIGN = re.compile("[" + "".join(map(re.escape, map(chr, _FOLD))) + "]")
_SIGN = "[" + re.escape("".join(STANDS_FOR)) + "]"
_LETTER = r"[^\W\d_]"
#: One or two signs between letters, or before the first letter of a word.
_HIDDEN = re.compile(rf"(?:(?<={_LETTER})|(?<![\w@$!])){_SIGN}{{1,2}}(?={_LETTER})")
_WORDS = re.compile(_LETTER + "+")
_SIGNS = str.maketrans(STANDS_FOR)

#: Characters of a text that are looked at together, and of its neighbourhood that is seen beside them.
PIECE, MARGIN = 1 << 20, 256
#: Labelled rows that the lexicon is fitted on; terms and exceptions that are considered.
SAMPLE, MOST = 20_000, 4000
SHORTEST, LONGEST = 3, 12


def fold(text: str) -> str:
    """The text as it reads, character by character: its length does not change."""
    if _FOREIGN.search(text):
        text = text.translate(_FOLD)
    text = text.lower()
    return _HIDDEN.sub(lambda m: m[0].translate(_SIGNS), text)


def _pieces(text: str) -> Iterator[tuple[str, int, int]]:
    """(folded piece with its neighbourhood, where the piece itself begins and ends in it); cut at white space where there is some."""
    a = 0
    while a < len(text):
        b = min(len(text), a + PIECE)
        if b < len(text):
            gap = max(text.rfind(c, a + PIECE - MARGIN, b) for c in " \n\t")
            b = gap + 1 if gap > a else b
        low = max(0, a - MARGIN)
        yield fold(text[low : b + MARGIN]), a - low, b - low
        a = b


class Model(NamedTuple):
    """weights: of terms (what words begin with, or a word and a space); exceptions: phrases; coefficients: of features()."""

    weights: dict[str, float]
    exceptions: frozenset[str]
    coefficients: tuple[float, ...]


class Matcher:
    def __init__(self, terms: dict[str, float], exceptions: frozenset[str] = frozenset()):
        self.exceptions, self.automaton = exceptions, ahocorasick.Automaton()
        for t, w in terms.items():
            self.automaton.add_word(t.rstrip(" "), (t, len(t.rstrip(" ")), w))  # of a term and its whole word, one is in a lexicon
        if terms:
            self.automaton.make_automaton()
        self.terms = len(terms)

    def hits(self, text: str) -> Iterator[tuple[str, float, tuple[str, str, str]]]:
        """(term, weight, (word, word with the one before, word with the one after)) of each hit that is no exception."""
        for piece, a, b in _pieces(text) if self.terms else ():
            for end, (term, size, weight) in self.automaton.iter(piece):
                x, y = end + 1 - size, end + 1
                if not a <= x < b or (x and piece[x - 1].isalpha()):
                    continue
                if y < len(piece) and piece[y].isalpha():
                    if term[-1] == " ":
                        continue
                    y = _WORDS.match(piece, x).end()
                word = piece[x:y]
                before, after = _WORDS.findall(piece[max(0, x - 64) : x]), _WORDS.search(piece, y, y + 64)
                phrases = (word, f"{before[-1]} {word}" if before else word, f"{word} {after[0]}" if after else word)
                if self.exceptions.isdisjoint(phrases):
                    yield term, weight, phrases


def features(text: str | None, matcher: Matcher) -> tuple[float, float]:
    """Weight of all hits, and weight by a hundred words (texts of few words count as of 10 more), on a logarithmic scale."""
    mass = sum(w for _, w, _ in matcher.hits(text)) if text else 0.0
    words = sum(len(text[a : a + PIECE].split()) for a in range(0, len(text), PIECE)) if mass else 0
    return float(np.log1p(mass)), float(np.log1p(100 * mass / (words + 10)))


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most `sample` labelled rows that are not held out, near copies once."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` pairs of numbers are broadcast

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = K.column_bytes(b.column("text"))
            h, at = K.row_words(data, off)
            keys = [int(K.rolling(h[x:y], min(5, y - x)).min(initial=K.U(2**64 - 1)) >> K.U(1)) if y > x else 0 for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(b.column(c) for c in ("doc_id", "text", "toxic"))], ["key", "doc_id", "text", "toxic"])

    kind = T.StructType([T.StructField("key", T.LongType()), *(rows.schema[c] for c in ("doc_id", "text", "toxic"))])
    one = rows.select("doc_id", "text", "toxic").mapInArrow(keyed, kind).groupBy("key").agg(F.min(F.struct("doc_id", "text", "toxic")).alias("x"))
    return materialize(one.select("x.text", F.col("x.toxic").cast("int").alias("toxic")), "training")


def _counted(rows: DataFrame, found) -> DataFrame:
    """(name, toxic, other): how many toxic and other documents have each of the names that found(text) gives."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[str, list[int]] = {}
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                for name in found(text or ""):
                    count.setdefault(name, [0, 0])[0 if toxic else 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), *(pa.array([c[i] for c in count.values()], pa.int64()) for i in (0, 1))], ["name", "toxic", "other"])

    return rows.mapInArrow(go, "name string, toxic long, other long").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _words(text: str) -> set[str]:
    return {w for piece, a, b in _pieces(text) for w in _WORDS.findall(piece[a:b])}


def _log_ratio(toxic: float, other: float, all_toxic: int, all_other: int) -> float:
    return float(np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((other + 0.5) / (all_other + 1)))


def _candidates(words: DataFrame, share: float, least: float = 25.0) -> dict[str, tuple[int, int]]:
    """The MOST word beginnings (and whole words, ending in a space) that speak most for toxic documents, by their likelihood ratio."""
    lengths = F.sequence(F.lit(SHORTEST), F.least(F.length("name"), F.lit(LONGEST)))
    forms = F.concat(F.transform(lengths, lambda n: F.substring(F.col("name"), F.lit(1), n)), F.array(F.concat("name", F.lit(" "))))
    got = words.filter(F.length("name") >= SHORTEST).select(F.explode(forms).alias("term"), "toxic", "other").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * p))).otherwise(0.0)
    got = got.withColumn("n", F.col("t") + F.col("o")).withColumn("g", 2 * (part(F.col("t"), share) + part(F.col("o"), 1 - share)))
    got = got.filter((F.col("g") >= least) & (F.col("t") >= 3) & (F.col("t") * (1 - share) > 4 * share * (F.col("o") + 0.5)))
    return {r.term: (r.t, r.o) for r in got.orderBy(F.desc("g"), "term").limit(MOST).collect()}


def lexicon(found: dict[str, tuple[int, int]]) -> list[str]:
    """The shortest beginnings that speak for toxic documents, each made as long as it loses none of its hits; none begins with another."""
    closed: dict[str, tuple[int, int]] = {}
    for term in sorted(found, key=lambda x: (len(x), x)):
        t, o = found[term]
        longer = [x for x in found if x != term and x.startswith(term) and found[x][0] >= 0.95 * t]
        best = max(longer, key=lambda x: (len(x), x), default=term)
        closed[best] = found[best]
    out: list[str] = []
    for term in sorted(closed, key=lambda x: (-closed[x][0] / (closed[x][1] + 1) ** 0.5, len(x), x)):
        bare = term.rstrip(" ")
        if not any(term.startswith(x) or x.rstrip(" ").startswith(bare) for x in out):
            out.append(term)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Coefficients of a constant and the columns of x; no column may speak for a clean text."""
    x = np.column_stack((np.ones(len(x)), x))
    b = np.zeros(x.shape[1])
    hold = np.zeros(x.shape[1], bool)
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        free = ~hold
        a = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + np.diag(penalty[free])
        step = np.linalg.solve(a, x[:, free].T @ (y - p) - penalty[free] * b[free])
        b[free] += np.clip(step, -4, 4)
        hold[1:] |= b[1:] < 0
        b[hold] = 0
    return tuple(b.tolist())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: frozenset[str] = frozenset()) -> Model:
    """The model of labels (doc_id, toxic 0 or 1; nulls and held-out rows left out). `exceptions`: further phrases, of folded words, that are no hits.

    Without toxic rows the lexicon is empty, and every text has the share of toxic rows, smoothed, as its score.
    """
    rows = _training(docs, labels, sample)
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    terms: list[str] = []
    if toxic and other:
        terms = lexicon(_candidates(_counted(rows, _words), toxic / (toxic + other)))
    if not terms:
        release(rows)
        return Model({}, exceptions, (float(np.log((toxic + 1) / (other + 1))), 0.0, 0.0))
    bare = Matcher(dict.fromkeys(terms, 1.0), exceptions)
    weights = dict.fromkeys(terms, 0.0)
    for r in _counted(rows, lambda text: {h[0] for h in bare.hits(text)}).collect():  # a row for each term
        weights[r.name] = max(0.0, _log_ratio(r.toxic, r.other, toxic, other))
    near = _counted(rows, lambda text: {p for h in bare.hits(text) for p in h[2]})
    clean = near.filter((F.col("other") >= 3) & (F.col("toxic") * other < F.col("other") * toxic)).orderBy(F.desc("other"), "name").limit(MOST)
    exceptions = exceptions | {r.name for r in clean.collect()}
    matcher = Matcher({t: w for t, w in weights.items() if w > 0}, exceptions)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t, matcher) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([v[i] for v in f], pa.float64()) for i in (0, 1)), b.column("toxic")], ["a", "b", "toxic"])

    got = rows.mapInArrow(measured, "a double, b double, toxic int").orderBy("toxic", "a", "b").toArrow()  # at most `sample` rows
    x = np.column_stack([got.column(c).to_numpy() for c in ("a", "b")])
    model = Model({t: w for t, w in weights.items() if w > 0}, exceptions, _logistic(x, got.column("toxic").to_numpy().astype(float)))
    release(rows)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= threshold, else 0).

    Null and empty texts have no hits and get the score of such texts. Repeated rows are scored alike, null ids are carried, and
    columns other than doc_id and text are not looked at; empty docs give no rows. Texts are read in pieces of PIECE characters.
    """
    arrow_batches(docs.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, (c, a, d) = Matcher(model.weights, model.exceptions), model.coefficients
        for b in batches:
            f = np.array([features(t.as_py(), matcher) for t in b.column("text")], dtype=float).reshape(-1, 2)
            p = 1 / (1 + np.exp(-np.clip(c + f @ np.array([a, d]), -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(go, T.StructType([src.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def judge_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """score() of all documents by a model fitted on the labels that are not held out: doc_id, held_out, score, predicted."""
    arrow_batches(docs.sparkSession)
    out = score(docs, fit(docs, labels, sample), threshold)
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
