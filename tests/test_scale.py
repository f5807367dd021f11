"""Matching by auction, the Hamming join, training kept between rounds, and the sweep as one plan: against plain ways."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pairloom.operators import assign, auction, dense, hamming, stats
from pairloom.plans import pairing, sweep
from pairloom.plans.training import Training

LETTERS = np.array(list("ACDEFGHIKLMNPQRSTVWY-"))


def sequences(rng, n: int, width: int, families: int = 5, changes: int = 5) -> list[str]:
    base = rng.choice(LETTERS, (families, width))
    base[:, width * 2 // 3 :] = "-"  # gap-rich sites
    out = []
    for i in range(n):
        x = base[i % families].copy()
        at = rng.choice(width, int(rng.integers(0, changes)), replace=False)
        x[at] = rng.choice(LETTERS, len(at))
        out.append("".join(x))
    return out


def near_pairs(seqs, most):
    u = sorted(set(seqs))
    return {(a, b): d for i, a in enumerate(u) for b in u[i + 1 :] if (d := sum(p != q for p, q in zip(a, b))) <= most}


def test_hamming_join_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    seqs = sequences(rng, 150, 30)
    seqs += seqs[:10]
    rows = spark.createDataFrame(list(enumerate(seqs)), "row_id long, seq string")
    for block, most in ((2048, 6), (8, 4), (2048, 0)):
        monkeypatch.setattr(hamming, "BLOCK", block)
        assert {(r.a, r.b): r.d for r in stats.similar_pairs(rows, 30, most).collect()} == near_pairs(seqs, most)
    assert stats.similar_pairs(rows.limit(0), 30, 4).collect() == []
    # more segments than sites: some are empty, and all pairs meet there
    short = ["AC", "AD", "EE"]
    got = stats.similar_pairs(spark.createDataFrame(list(enumerate(short)), "row_id long, seq string"), 2, 2)
    assert {(r.a, r.b): r.d for r in got.collect()} == near_pairs(short, 2)


def test_segments_share_the_entropy_of_sites():
    h = np.array([3.0, 0, 0, 0, 2.9, 0, 0, 0, 3.1, 0, 0, 0])
    parts = hamming.segments(h, 3)
    assert sorted(s for p in parts for s in p) == list(range(12)) and all(h[p].sum() > 2.5 for p in parts)
    x = np.random.default_rng(2).integers(0, 256, (50, 13)).astype(np.uint8)
    y = np.where(np.random.default_rng(3).random(x.shape) < 0.5, x, 0).astype(np.uint8)
    assert (hamming.distances(x, y) == (x != y).sum(axis=1)).all()


def test_auction_equals_the_matrix_way(spark):
    rng = np.random.default_rng(4)
    seqs = sequences(rng, 9, 8, 9, 4) + ["AAAACCCC"] * 2 + ["DDDDEEEE"]
    rows = spark.createDataFrame([(i, "S", s) for i, s in enumerate(seqs)] + [(50, "T", "AAAACCCC"), (60, None, "AAAACCCC")], "row_id long, species string, seq string")
    table = rng.normal(size=(4, 21, 4, 21))
    scores = lambda a, b: dense.score_block(a, b, table)
    got = auction.block_match(rows, scores, 4, block=5, tolerance=1e-3).toPandas()
    want = dense.match_small(rows.filter("species IS NOT NULL"), scores, 4).toPandas()
    spread = scores(dense.code_matrix(seqs)[:, :4], dense.code_matrix(seqs)[:, 4:])
    assert sorted(got.hk) == sorted(got.rr) == [*range(12), 50]
    for s in ("S", "T"):
        assert abs(got[got.species == s].score.sum() - want[want.species == s].score.sum()) <= 1e-3 * (spread.max() - spread.min()) + 1e-9
    both = got.merge(want, on=["species", "hk", "rr"])
    slack = 3e-3 * (spread.max() - spread.min())
    assert (both.gap_x >= both.gap_y - slack).all() and (both.gap_low <= both.gap_y + slack).all()


def test_large_groups_go_to_the_auction(spark):
    rng = np.random.default_rng(5)
    pairs = spark.createDataFrame([("S", h, r, float(rng.integers(0, 50))) for h in range(5) for r in range(10, 15)] + [("T", h, r, float(h * r)) for h in (1, 2) for r in (3, 4)], "species string, hk long, rr long, score double")
    small, large = assign.assign_groups(pairs, ["species"]), assign.assign_groups(pairs, ["species"], most=3)
    totals = lambda df: {r.species: round(r.t, 4) for r in df.groupBy("species").agg(F.sum("score").alias("t")).collect()}
    assert totals(small) == totals(large) and large.count() == 7
    assert large.filter("species = 'S'").select("rr").distinct().count() == 5


def _aligned(spark, n=60):
    rng = np.random.default_rng(6)
    halves = sequences(rng, n, 8, n, 1)
    return spark.createDataFrame([(i, f"S{i % 12}", s + s[::-1]) for i, s in enumerate(halves)], "row_id long, species string, seq string")


def test_training_by_differences_equals_training_anew(spark):
    rng = np.random.default_rng(7)
    seqs = sequences(rng, 60, 12, 4, 4)
    rows = spark.createDataFrame(list(enumerate(seqs)), "row_id long, seq string")
    learnt = Training(rows, 12, 6, 2)
    for keep in (range(0, 40), range(10, 60), list(range(10, 30)) * 2, []):
        now = spark.createDataFrame([(i, seqs[j]) for i, j in enumerate(keep)], "row_id long, seq string")
        meff = learnt.update(now.select("seq"))
        w = stats.sequence_weights(now, 12, 2)
        anew = dense.pair_sums(now.join(w, "row_id").select("seq", "w"), 12, 6)
        assert np.allclose(learnt.sums.two, anew.two, atol=1e-12) and np.allclose(learnt.sums.one, anew.one, atol=1e-12)
        assert abs(meff - sum(r.w for r in w.collect())) < 1e-9


def test_sweep_equals_runs_one_by_one(spark):
    rows = _aligned(spark)
    out = {(r.n_start, r.replicate, r.iter): r for r in sweep.run(rows, 16, 8, [10, 100], 2, 3, 2, 1).collect()}
    assert len(out) == 8
    for n, r in ((10, 1), (10, 2), (100, 1)):
        seed = sweep.seed_of(n, r)
        log = pairing.iterate(rows, 16, 8, 3, 2, 1, seed, pairing.draw_start(rows, n, seed))[1]
        for x in log.collect():
            y = out[n, r, x["round"]]
            assert (x.n_train, x.tp, x.n, x.tp_train) == (y.n_train, y.tp, y.n, y.tp_train) and abs(x.meff - y.meff) < 1e-9
        six = pairing.round_log(log)
        assert six.columns == ["n_train", "meff", "tp_all", "fp_all", "tp_train", "fp_train"] and all(s.tp_all + s.fp_all == 60 and s.fp_train >= 0 for s in six.collect())


def test_repeated_halves_are_matched_as_kinds(spark):
    from pairloom.operators import transport

    rng = np.random.default_rng(8)
    for t in range(40):
        c = rng.integers(0, 5, (int(rng.integers(1, 6)), int(rng.integers(1, 6)))).astype(float) if t % 2 else rng.normal(size=rng.integers(1, 6, 2))
        k = int(rng.integers(max(c.shape), 12))
        left, right = (np.concatenate((np.arange(n), rng.integers(0, n, k - n))) for n in c.shape)
        m = c[left][:, right]
        col, got, gap = transport.match(lambda i, c=c: c[i], left, right, *c.shape, rng)
        want, u, v, _ = assign.solve(m)
        assert sorted(col) == list(range(k)) and np.isclose(got.sum(), m[np.arange(k), want].sum()) and np.allclose(got, m[np.arange(k), col])
        if k > 1:
            assert np.allclose(np.sort(gap), np.sort(assign._gaps(m, want, u, v)), atol=1e-8)
    # 20,000 rows of few kinds: a matrix of rows would hold 400 million scores
    seqs = sequences(rng, 30, 8, 30, 4)
    rows = spark.createDataFrame([(i, "S", seqs[i % 30][:4] + seqs[i // 30 % 30][4:]) for i in range(20_000)], "row_id long, species string, seq string")
    got = dense.match_groups(rows, dense.TableScores(rng.normal(size=(4, 21, 4, 21))), 4)
    assert got.agg(F.count_distinct("hk"), F.count_distinct("rr"), F.max("gap")).first()[:] == (20_000, 20_000, 0.0)


def test_small_groups_are_enumerated_together(spark):
    rng = np.random.default_rng(9)
    seqs = sequences(rng, 60, 8, 60, 4)
    rows = spark.createDataFrame([(i, f"S{i // 3 if i < 45 else i}", s) for i, s in enumerate(seqs)], "row_id long, species string, seq string")
    scores = dense.TableScores(rng.normal(size=(4, 21, 4, 21)))
    got = {r.hk: r for r in dense.match_groups(rows, scores, 4).collect()}
    codes = dense.code_matrix(seqs)
    assert len(got) == 60
    for x in [*range(0, 45, 3), *range(45, 60)]:
        part = codes[x : x + 3] if x < 45 else codes[x : x + 1]
        s = scores(part[:, :4], part[:, 4:])
        col, gap = assign.assign(s, np.random.default_rng(0))
        assert np.isclose(sum(got[x + k].score for k in range(len(part))), s[np.arange(len(s)), col].sum())
        assert np.allclose([got[x + k].gap for k in range(len(part))], gap)


def test_sequences_meet_without_sets_of_sites(spark, monkeypatch):
    rng = np.random.default_rng(10)
    seqs = sequences(rng, 120, 8, 6, 5) + ["AAAACCCC"] * 3
    rows = spark.createDataFrame(list(enumerate(seqs)), "row_id long, seq string")
    far = lambda a, b: sum(p != q for p, q in zip(a, b))
    for most in (0, 1, 2):
        assert hamming.masked(8, most)
        w = {r.row_id: r.w for r in stats.sequence_weights(rows, 8, most).collect()}
        assert all(np.isclose(w[i], 1 / sum(far(x, y) <= most for y in seqs)) for i, x in enumerate(seqs)) and len(w) == len(seqs)
        got = hamming.masked_pairs(rows.select("seq").distinct(), 8, most).collect()
        assert {(r.a, r.b): r.d for r in got} == near_pairs(seqs, most) and len(got) == len(near_pairs(seqs, most))
    q, r = sorted(set(seqs[:40])), sorted(set(seqs[40:]))
    both = [spark.createDataFrame([(x,) for x in t], "seq string") for t in (q, r)]
    best = {x.seq: x.d for x in hamming.best_agreement(*both, 8).collect()}
    assert best == {x: min(far(x, y) for y in r) for x in q}


def test_summary_of_scores_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(11)
    seqs = sequences(rng, 50, 8, 50, 4)
    rows = spark.createDataFrame([(i, f"S{i % 3}", seqs[i * i % 50]) for i in range(80)] + [(99, None, seqs[0])], "row_id long, species string, seq string")
    scores = dense.TableScores(rng.normal(size=(4, 21, 4, 21)))
    monkeypatch.setattr(dense, "PART", 4)
    got = {r.species: r for r in dense.score_summary(rows, scores, 4).collect()}
    for r in dense.score_groups(rows, scores, 4).groupBy("species").agg(F.count("*").alias("n"), F.sum("score").alias("t"), F.max("score").alias("b")).collect():
        g = got.pop(r.species)
        assert g.pairs == r.n and np.isclose(g.total, r.t) and np.isclose(g.best, r.b)
    assert not got


def test_a_large_group_takes_few_exchanges(monkeypatch):
    from pairloom.operators import transport

    rng = np.random.default_rng(12)
    n, m = 120, 150
    c = rng.normal(size=(n, 4)) @ rng.normal(size=(4, m))
    left, right = np.concatenate((np.arange(n), rng.integers(0, n, 280))), np.concatenate((np.arange(m), rng.integers(0, m, 250)))
    steps, enter = [], transport.Tree.enter
    monkeypatch.setattr(transport.Tree, "enter", lambda *a: (steps.append(1), enter(*a)))
    col, got, gap = transport.match(lambda i: c[i], left, right, n, m, rng)
    whole = c[left][:, right]
    want, u, v, _ = assign.solve(whole)
    assert sorted(col) == list(range(400)) and np.isclose(got.sum(), whole[np.arange(400), want].sum()) and np.allclose(got, whole[np.arange(400), col])
    assert np.allclose(np.sort(gap), np.sort(assign._gaps(whole, want, u, v)), atol=1e-8)
    assert len(steps) < 3 * (n + m)
    # prices from every k-th row, or none that are of use, give the same
    for k in (m * 10, 1):
        monkeypatch.setattr(transport, "SMOOTHED", k)
        assert np.isclose(transport.match(lambda i: c[i], left, right, n, m, rng)[1].sum(), got.sum())
    same = transport.match(lambda i: np.ones((n, m))[i] * np.array([0.0, 1e6])[(np.arange(m) % 2)], left, right, n, m, rng)
    assert np.isclose(same[1].sum(), 1e6 * (right % 2).sum())


def test_training_counts_short_sequences_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(13)
    seqs = sequences(rng, 80, 8, 6, 5)
    far = lambda a, b: sum(p != q for p, q in zip(a, b))
    monkeypatch.setattr(hamming, "near", None)
    rows = spark.createDataFrame(list(enumerate(seqs)), "row_id long, seq string")
    learnt = Training(rows, 8, 4, 1)
    for keep in (range(0, 40), range(10, 80), list(range(10, 30)) * 2, []):
        now = [seqs[j] for j in keep]
        meff = learnt.update(spark.createDataFrame([(x,) for x in now], "seq string"))
        assert abs(meff - sum(1 / sum(far(x, y) <= 1 for y in now) for x in now)) < 1e-9


def test_short_sequences_are_counted_in_each_run(spark):
    rng = np.random.default_rng(13)
    seqs = sequences(rng, 80, 8, 6, 5)
    rows = spark.createDataFrame([(i % 2, seqs[i]) for i in range(80)] + [(2, seqs[0])], "cfg long, seq string")
    got = {(r.cfg, r.seq): r for r in sweep._counted(rows, 8, 1).collect()}
    far = lambda a, b: sum(p != q for p, q in zip(a, b))
    for k in range(3):
        mine = [r.seq for r in rows.collect() if r.cfg == k]
        for x in set(mine):
            r = got.pop((k, x))
            assert r.c == mine.count(x) and np.isclose(r.w, mine.count(x) / sum(far(x, y) <= 1 for y in mine))
    assert not got


def test_sweep_rounds_start_from_the_prices_found(spark, monkeypatch):
    from pairloom.operators import transport

    monkeypatch.setattr(transport, "PRICED", 1)
    rows = _aligned(spark)
    kept, found = [], sweep._matched

    def watched(*args):
        kept.append(args[-1])
        return found(*args)

    monkeypatch.setattr(sweep, "_matched", watched)
    out = {(r.n_start, r.iter): r for r in sweep.run(rows, 16, 8, [10], 1, 3, 3, 1).collect()}
    assert [p is None for p in kept] == [True, False, False]
    seed = sweep.seed_of(10, 1)
    for x in pairing.iterate(rows, 16, 8, 3, 3, 1, seed, pairing.draw_start(rows, 10, seed))[1].collect():
        y = out[10, x["round"]]
        assert (x.n_train, x.tp, x.n, x.tp_train) == (y.n_train, y.tp, y.n, y.tp_train) and abs(x.meff - y.meff) < 1e-9
