"""Whitening, prefix trie and toxicity: against plain versions, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import prefix_trie, toxicity, whitening

SF = "/root/testdata/sf0.001"


# whitening


def plain_whitening(rows, k=32):
    ids = [i for i, _ in rows]
    x = np.floor(64 * np.array([e for _, e in rows], dtype=float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = np.array([[float(Fraction(int(v)) - Fraction(int(t), n)) for v, t in zip(r, s)] for r in x])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return ids, n, [sum((n * int(v) - int(t)) ** 2 for v, t in zip(r, s)) for r in x], c @ u / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_whitening_against_a_plain_version(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whitening.whiten(t).toPandas().sort_values(["vec_id", "component"])
    rows = sorted((r.vec_id, r.embedding) for r in t.collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding))
    ids, n, dev, z, share = plain_whitening(rows)
    k = got.component.max()
    z = z[:, :k]
    assert got.vec_id.tolist() == [i for i in ids for _ in range(k)]
    assert (got.n == n).all() and got.deviation.tolist() == [d for d in dev for _ in range(k)]
    w = got.whitened.to_numpy().reshape(-1, k)
    assert np.allclose(np.abs(w), np.abs(z), atol=1e-8) and np.allclose(w * np.sign((w * z).sum(axis=0)), z, atol=1e-8)
    assert np.allclose(got.explained.to_numpy().reshape(-1, k)[0], share[:k], rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_products_are_exact_to_double_double():
    x = np.random.default_rng(3).normal(size=(2500, 3)) * 1e7 + 1e12
    low = np.random.default_rng(4).normal(size=x.shape) * 1e-6
    high, low = whitening.two_sum(x, low)
    got = whitening.product((high, low), (high, low))
    for i in range(3):
        for j in range(3):
            want = sum((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(d)) for a, b, c, d in zip(high[:, i], low[:, i], high[:, j], low[:, j]))
            assert abs((Fraction(got[0][i, j]) + Fraction(got[1][i, j]) - want) / want) < 2**-95


def test_eigenvectors_of_a_badly_scaled_matrix():
    r = np.random.default_rng(5)
    q = np.linalg.qr(r.normal(size=(12, 12)))[0]
    e = 10.0 ** -np.arange(12)
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, x = whitening.eigen((v, np.zeros_like(v)))
    exact = [[sum(Fraction(x[k, i]) * Fraction(v[k, m]) * Fraction(x[m, j]) for k in range(12) for m in range(12)) for j in range(12)] for i in range(12)]
    off = max(abs(float(exact[i][j])) / math.sqrt(values[i] * values[j]) for i in range(12) for j in range(12) if i != j)
    assert off < 1e-4 and np.allclose(x.T @ x, np.eye(12), atol=1e-14) and (np.diff(values) < 0).all()


def test_whitening_of_odd_rows(spark):
    kind = "vec_id long, embedding array<float>, label int, component string, n string"
    odd = [(1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [7.0, 7.0, 7.0]), (None, [0.5, 1.0]), (8, [0.25, -1.0]), (8, [0.25, -1.0]), (9, [3.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame([(i, e, 0, "x", "y") for i, e in odd], kind)).collect()
    assert collections.Counter(r.vec_id for r in got) == {None: 2, 8: 4, 9: 2}  # one vector of width 3 has no variance
    assert {r.n for r in got} == {4} and all(math.isfinite(r.whitened) for r in got)
    same = [(r.component, r.whitened) for r in got if r.vec_id == 8]
    assert len(set(same)) == 2
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, "", "")], kind)).collect() == []
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0], 0, "", ""), (2, [0.0, 1.0], 0, "", "")], kind)).collect()
    assert {(r.component, r.deviation) for r in huge} == {(1, None)} and {round(r.whitened, 9) for r in huge} == {1.0, -1.0}


# prefix trie


def plain_trie(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(said[0])}:{said[0]}{said[1]}".encode()).digest(), said))
    built = {}
    for c in convs:
        convs[c].sort()
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        built[c] = [x[3] for x in convs.get(base, [])[:h] + own[h:]]
    nodes, kids, leaves, saved = collections.defaultdict(list), collections.Counter(), collections.Counter(), collections.Counter()
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]] += 1
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] += 0 if kids[k] else 1
        saved[k] += (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    ends = {k: ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))) for k, m in nodes.items()}
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in nodes.items())


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


KIND = "conv_id long, turn long, role string, text string, depth string, length string, k1 int"


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], KIND)


@pytest.mark.parametrize("block", [2, 4096])
def test_trie_against_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = [(int(c), int(t), "user" if t % 2 == 0 else "assistant", "é" * int(rng.integers(0, 3))) for c in rng.permutation(60) for t in range(int(rng.integers(1, 14)))]
    rows += [(100 + c, t, "user", "same") for c in range(30) for t in range(25)]  # copies of one long conversation
    rows += [(200 + c, t, "user", "same" if t < c else f"own {c}") for c in range(12) for t in range(14)]  # each leaves the others a turn later
    assert trie_rows(prefix_trie.build_trie(_turns(spark, rows))) == plain_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, 1, "user", None), (7, 1, "user", None), (7, 1, "", "tie"), (-3, 0, "user", "a"), (0, 5, None, "b"), (3, 2, "user", "x" * 100_000), (12345, 0, "r", ""), (12346, 0, "r", ""), (12347, 0, "r", "")]
    assert trie_rows(prefix_trie.build_trie(_turns(spark, rows))) == plain_trie(rows)
    assert prefix_trie.build_trie(_turns(spark, [])).collect() == []
    assert prefix_trie.build_trie(_turns(spark, [(None, 0, "user", "lost")])).collect() == []


def test_a_node_on_which_most_chains_hang(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT", 20)
    rows = [(5 * c, 0, "user", "hello") for c in range(80)] + [(5 * c, 1, "user", str(c // 2)) for c in range(80)]
    assert trie_rows(prefix_trie.build_trie(_turns(spark, rows))) == plain_trie(rows)


# toxicity


def test_folding():
    assert toxicity.fold("You 1d10t, ｍoron, tr4sh мoron! 12.00 $5") == "you idiot, moron, trash moron! 12.00 $5"
    assert len(toxicity.fold("İ" * 5 + "ß1")) == 7


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.judge_toxicity(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] > 0.85 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) < 0.01 * n[0, 0]
    for r in got.limit(200).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)


def test_labels_of_held_out_rows_are_not_learned(spark):
    ids = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    docs = spark.createDataFrame([(i, f"plain words number {i} of many " + ("vile" if i % 2 else "kind")) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).weights == {}


def _learned(spark):
    rng = np.random.default_rng(2)
    filler = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(400)]
    rows = []
    for i in range(900):
        words = list(rng.choice(filler, 40))
        if i % 6 == 0:
            words[5:5] = ["scumbag", "filth" + rng.choice(filler)]
        if i % 6 in (1, 2):
            words[5:5] = ["no", "scumbag"]  # an exception phrase
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), filler


def test_beginnings_and_exceptions_are_learned(spark):
    docs, labels, filler = _learned(spark)
    m = toxicity.fit(docs, labels, exceptions=frozenset({"no scumbag"}))
    assert "filth" in m.weights
    body = " ".join(filler[:30])
    texts = [body, f"{body} filthy {body[:60]} FILTHx", f"{body} f1lth", f"{body} fіlthy", None, "", f"{body} unfilthy"]
    df = spark.createDataFrame([(i, t, "en", 1.5) for i, t in enumerate(texts)] + [(None, texts[1], "", 0.0)], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in toxicity.score(df, m).collect()}
    assert [got[i].predicted for i in range(7)] == [0, 1, 1, 1, 0, 0, 0]
    assert got[None].score == got[1].score and 0 <= got[4].score == got[5].score <= 1
    assert toxicity.score(df.limit(0), m).collect() == []


def test_exceptions_undo_hits():
    m = toxicity.Matcher({"trash ": 3.0, "scum": 2.0}, frozenset({"trash can", "the scum", "scumble"}))
    seen = lambda t: [h[0] for h in m.hits(t)]
    assert seen("Trash! trash can. the scum a scum scummy scumble trashy xscum") == ["trash ", "scum", "scum"]
    assert seen("") == []


def test_long_texts_are_matched_in_pieces(monkeypatch):
    m = toxicity.Matcher({"trash ": 3.0})
    text = "so much trash here, tra5h there. " * 200
    want = len(list(m.hits(text)))
    monkeypatch.setattr(toxicity, "PIECE", 100)
    monkeypatch.setattr(toxicity, "MARGIN", 40)
    assert len(list(m.hits(text))) == want == 400


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.judge_toxicity(docs, labels).collect()
    assert [r.predicted for r in got] == [0, 0] and all(r.score == 0.5 for r in got)
    assert toxicity.judge_toxicity(docs.limit(0), labels.limit(0)).collect() == []
    assert docs.select(toxicity.held_out().alias("h")).filter(F.col("h").isNull()).count() == 0


# audio in pieces, and tokenizers that do not treat words apart


def test_audio_in_pieces(monkeypatch):
    from pairloom.llm import audio

    pcm = np.random.default_rng(1).integers(-32768, 32768, 5000).astype(np.int16)
    body = np.random.default_rng(2).integers(0, 256, 40 * 192).astype(np.uint8).tobytes()
    whole = audio.feature(pcm), audio.resample(pcm, 16000, 8000), audio.resample(pcm, 8000, 11025), audio.ima_decode(body, 192)
    monkeypatch.setattr(audio, "PIECE", 97)
    monkeypatch.setattr(audio, "BLOCKS", 7)
    assert audio.feature(pcm) == whole[0] and (audio.resample(pcm, 16000, 8000) == whole[1]).all() and (audio.resample(pcm, 8000, 11025) == whole[2]).all() and (audio.ima_decode(body, 192) == whole[3]).all()
    x = pcm.astype(int)
    assert f"ms={(x * x).sum() // 5000};peak={np.abs(x).max()};zc={((x[1:] < 0) != (x[:-1] < 0)).sum()}" in whole[0]
    assert audio.read_wav(audio.resampled_wav(pcm, 16000, 8000).tobytes())[3] == whole[1].astype("<i2").tobytes()
    assert audio.binaries([b"ab", None, b"", b"c"]).to_pylist() == [b"ab", None, b"", b"c"] and audio.binaries([None, b"xy"]).to_pylist() == [None, b"xy"]


@pytest.mark.parametrize("token", [{"content": "green house"}, {"content": "Foo"}, {"content": "<|sep|>", "lstrip": True}])
def test_tokenizers_with_added_tokens_read_whole_texts(spark, tmp_path, token):
    import json

    from tokenizers import Tokenizer

    from pairloom.llm import packing

    d = json.load(open(packing.default_tokenizer()))
    d["added_tokens"].append({"id": 49500, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False} | token)
    path = str(tmp_path / "t.json")
    json.dump(d, open(path, "w"))
    text = "A green house, Foo and  <|sep|> Fool <|endoftext|>"
    out = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer=path).first()
    assert np.frombuffer(out.ids, "<u4").tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 0]


def test_lines_go_the_same_with_any_period(spark):
    from pairloom.llm import line_dedup

    rng = np.random.default_rng(9)
    shared = [[f"passage {p} line {i}" if i % 5 else "" for i in range(1, n)] for p, n in enumerate((4, 7, 13, 30))]
    rows = []
    for i in range(50):
        lines = [f"own {i} {j}" for j in range(int(rng.integers(0, 5)))]
        for p in rng.permutation(4)[: int(rng.integers(0, 4))]:
            a, b = sorted(rng.integers(0, len(shared[p]) + 1, 2)) if i % 3 else (0, len(shared[p]))
            lines += shared[p][a:b] + [""] * int(rng.integers(0, 2))
        rows.append((i, "\n".join(lines)))
    d = spark.createDataFrame([*rows, (90, "\n".join(["x"] * 40)), (91, " \n\n"), (92, None)], "doc_id long, text string")
    got = [sorted((r.doc_id, r.text or "", r.n_removed) for r in line_dedup.dedup_lines(d, period=p).collect()) for p in (1, 2, 4, 1000)]
    assert got[0] == got[1] == got[2] == got[3]
    lined = line_dedup._chunked(line_dedup._lines(d.withColumnRenamed("doc_id", "rid")), 2)
    whole = line_dedup._again(d.withColumnRenamed("doc_id", "rid"), line_dedup._chunks(lined))
    assert whole.count() > 20  # chunks alone carry a good part


def test_chunks_cover_all_lines_from_the_first_with_a_word(spark):
    from pairloom.llm import line_dedup

    text = "\n\n" + "\n".join(f"w{i % 7} {i % 3}" if i % 4 else "" for i in range(60)) + "\n"
    d = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one")], "rid long, text string")
    for r in line_dedup._chunked(line_dedup._lines(d), 3).collect():
        spans = [(c.c >> 32, c.c & (2**32 - 1)) for c in r.chunks]
        said = [i for i, x in enumerate(r.lines) if x.strip()]
        assert [x for s, n in spans for x in range(s, s + n)] == (list(range(said[0], len(r.lines))) if said else [])
        assert [z.c >> 32 for z in r["at"]] == [max(s for s, _ in spans if s <= i) for i in said]
