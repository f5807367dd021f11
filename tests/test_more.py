"""Matching, models, logs and files against plain versions."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom import catalog, catalog_more
from pairloom.functions import symbols as S
from pairloom.models import evaluate, rbm, train
from pairloom.operators import dense, geometry, groups, sampling, stats
from pairloom.plans import pairing
from pairloom.sources import files, logs

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ == catalog_more.__name__ and n in catalog.ORACLES] + ["bootstrap_cdf", "assign_k2"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "labels", "orders", "customer", "lineitem", "events", "embeddings", "nation", "part", "supplier"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, con, name):
    df, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda rows: sorted((tuple(r[c] for c in cols) for r in rows), key=repr)
    assert key([r.asDict() for r in df.collect()]) == key([dict(zip(want.columns, r)) for r in want.fetchall()])


@pytest.mark.parametrize("name", [n for n, f in catalog.QUERIES.items() if f.__module__ == catalog_more.__name__ and n not in catalog.ORACLES])
def test_models_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def aligned(spark, n=60, width=12, seed=1, species=7):
    rng = np.random.default_rng(seed)
    left = ["".join(rng.choice(list("ACDE-"), width // 2)) for _ in range(n)]
    return spark.createDataFrame([(i, f"S{i % species}", x + x[::-1]) for i, x in enumerate(left)], "row_id long, species string, seq string")


def test_dense_tables_equal_the_relational_ones(spark):
    a = aligned(spark)
    w = stats.sequence_weights(a, 12, 1)
    t = dense.pmi_table(a.join(w, "row_id").select("seq", "w"), 12, 6)
    for r in stats.pmi(stats.long_form(a), 12, 6, w).collect():
        assert np.isclose(r.pmi, t[r.i - 1, r.a - 1, r.j - 7, r.b - 1])
    c = dense.count_table(a, 12, 6)
    for r in stats.pmi_counts(stats.long_form(a), 12, 6, 60).collect():
        assert np.isclose(r.pmi, c[r.i - 1, r.a - 1, r.j - 7, r.b - 1])
    unweighted = dense.pmi_table(a.select("seq", F.lit(1.0).alias("w")), 12, 6)
    codes = {r.row_id: dense.code_matrix([r.seq]) for r in a.collect()}
    for r in stats.pair_scores(a, stats.pmi(stats.long_form(a), 12, 6), 6).collect():
        both = np.hstack((codes[r.hk][:, :6], codes[r.rr][:, 6:]))
        assert np.isclose(r.score, dense.score_matrix(both, unweighted, 6)[0, 0])
    assert dense.pmi_table(a.filter("false").select("seq", F.lit(1.0).alias("w")), 12, 6).shape == (6, 21, 6, 21)


def test_pairing_learns_and_starts_stay(spark):
    a = aligned(spark, 80, 16, 3)
    start = pairing.draw_start(a, 60, 5)
    assert start.count() == 60 and sorted(r.row_id for r in start.collect()) == sorted(r.row_id for r in pairing.draw_start(a, 60, 5).collect())
    found, log = pairing.iterate(a, 16, 8, 5, 3, seed=4, start=start)
    rows = sorted(map(tuple, log.collect()))
    assert [r[:2] for r in rows] == [(1, 60), (2, 65), (3, 70)] and all(r[3] == 80 for r in rows)
    assert rows[-1][2] > 40  # by chance 7 of 80
    out = pairing.sweep(a, 16, 8, [40], 2, 5, 2, 1)
    assert out.count() == 4 and out.agg(F.min("tp")).first()[0] > 0.2


def test_groups_too_large_for_a_task_are_an_error(spark, monkeypatch):
    from pairloom.operators import assign

    monkeypatch.setattr(assign, "MOST", 3)
    with pytest.raises(ValueError, match="at most 3"):
        assign.check_size(4, "S1")


def test_exact_orders_and_sums(spark):
    rows = spark.range(1000).select((F.col("id") * 7).alias("row_id")).repartition(5)
    k = {r.row_id: r.k for r in sampling.ranked(rows, 3).collect()}
    assert sorted(k.values()) == list(range(1, 1001))
    for n in (0, 1, 250, 1000, 2000):
        got = {r.row_id for r in sampling.first_n(rows, n, 3).collect()}
        assert got == {x for x, i in k.items() if i <= n}
    w = rows.withColumn("w", 1.0 / (1 + F.col("row_id") % 5))
    at = 0.0
    for r in sampling.cumulative(w, 16).orderBy("row_id").collect():
        at += r.w
        assert np.isclose(r.hi, at) and np.isclose(r.lo, at - r.w)
    b = sampling.minibatches(rows, 1, 0, 5000).collect()
    assert len(b) == 1000 and {r.batch for r in b} == {0}


def test_hidden_units_and_pseudolikelihood_by_enumeration(spark):
    m = catalog_more.fixed_rbm(3)
    v = np.array([[0, 5, 20], [3, 3, 3]])
    for x, p in zip(v, m.pseudolikelihood(v)):
        total = 0.0
        for i in range(3):
            f = []
            for a in range(21):
                y = x.copy()
                y[i] = a
                f.append(np.exp(-m.free_energy(y[None])[0]))
            total += np.log(f[x[i]] / sum(f))
        assert np.isclose(p, total / 3)
    rows = spark.createDataFrame([(k, (x + 1).tolist()) for k, x in enumerate(v)], "row_id long, codes array<int>")
    got = {(r.row_id, r.unit): r.h for r in rbm.hidden(rows, m).collect()}
    assert all(np.isclose(got[k, u + 1], m.mean_hidden(v)[k, u]) for k in range(2) for u in range(2))
    gv, gh, gw = rbm.moments(rows, m)
    one = np.eye(21)[v]
    assert np.allclose(gv, one.mean(0)) and np.allclose(gh, m.mean_hidden(v).mean(0)) and np.allclose(gw, np.einsum("nia,nm->iam", one, m.mean_hidden(v)) / 2)


def test_chains_depend_on_rows_only_and_reach_the_distribution(spark):
    rng = np.random.default_rng(0)
    m = rbm.RBM(rng.normal(size=(2, 2)), rng.normal(size=1), rng.normal(size=(2, 2, 1)))
    start = rbm.fresh_chains(spark, m, 4000, 1)
    a = {r.row_id: r.codes for r in rbm.sample(start.repartition(7), m, 8, 2).collect()}
    assert a == {r.row_id: r.codes for r in rbm.sample(start.coalesce(1), m, 8, 2).collect()}
    p = {v: np.exp(-m.free_energy(np.array([v]))[0]) for v in itertools.product(range(2), repeat=2)}
    for v, x in p.items():
        assert abs(x / sum(p.values()) - sum(tuple(c - 1 for c in y) == v for y in a.values()) / 4000) < 0.04
    held = rbm.sample(start, m, 3, 2, fixed=[2]).join(start.withColumnRenamed("codes", "old"), "row_id")
    assert held.filter(held.codes[1] != held.old[1]).count() == 0


def test_training_moves_only_what_is_free(spark):
    a = aligned(spark, 200, 6).select("row_id", S.codes(F.col("seq")).alias("codes"))
    left, right = catalog_more.fixed_rbm(3), catalog_more.fixed_rbm(3, 3)
    seen = []
    m, log = train.train(a, train.joint(left, right, 2), 3, batch=60, clip=0.5, frozen=(left, right), callback=lambda k, *_: seen.append(k), save_every=2, saved=lambda k, m: seen.append(-k))
    assert seen == [1, 2, -2, 3] and len(log) == 3 and train.drift(m, left, right) == {"g": 0.0, "theta": 0.0, "w": 0.0}
    assert np.abs(m.w[:, :, 4:] - train.joint(left, right, 2).w[:, :, 4:]).max() > 0 and not m.w[3:, :, :2].any()
    moved = rbm.RBM(m.g + 1, m.theta, m.w, 3)
    with pytest.raises(RuntimeError, match="frozen"):
        train.assert_frozen(moved, left, right)
    free, _ = train.train(a, rbm.RBM.start(6, 21, 2), 30, rate=0.05)
    assert free.pseudolikelihood(np.array([r.codes for r in a.collect()]) - 1).mean() > rbm.RBM.start(6, 21, 2).pseudolikelihood(np.array([r.codes for r in a.collect()]) - 1).mean()
    one = sum(train.batch_of(a, 200, e, 60, 0).count() for e in range(3))
    assert one == 200


def test_adam_and_alignment():
    opt = train.Adam(0.1, clip=1.0)
    step = opt.step({"g": np.array([3.0, 4.0])})["g"]
    assert np.allclose(step, [0.1, 0.1])
    got = train.alignment(np.array([0.0, 1, 2, 3]), np.array([1.0, 3, 5, 7]))
    assert np.isclose(got["r"], 1) and np.isclose(got["slope"], 2) and np.isclose(got["intercept"], 1) and np.isclose(got["max_abs_diff"], 4)
    assert np.isnan(train.alignment(np.ones(3), np.arange(3))["r"])
    checks = {c for c, _, _ in train.diagnostics(catalog_more.fixed_rbm(4), np.zeros((5, 4), int), np.ones((5, 4), int), 2, heldout=np.zeros((2, 4), int), grad={"w": np.ones((4, 21, 2))})}
    assert checks == {"vh", "h", "v", "ab", "ab_val", "lpl_val", "firing_data", "firing_model", "wn", "gn"}


def test_other_models(spark):
    images = spark.createDataFrame([(i, i % 3, [float((i + k) % 2) for k in range(4)]) for i in range(30)], "row_id long, label int, pixels array<double>")
    kept = evaluate.train_class_pair(images, 0, 2, 2, 10)
    assert sorted(kept) == evaluate.log_spaced(10) and kept[10].w.shape == (4, 2, 2)
    teacher = catalog_more.fixed_rbm(3)
    rows = aligned(spark, 40, 6).select(S.codes(F.substring("seq", 1, 3)).alias("codes"), S.codes(F.substring("seq", 4, 3)).alias("teacher_codes"))
    assert evaluate.train_aligned(rows, teacher, 2, 2).w.shape == (3, 21, 2)
    codes = np.array([r.codes for r in rows.collect()]) - 1
    assert set(evaluate.sampler_checks(teacher, codes, 2, 20)) == {"cold", "warm", "long", "many_calls"}
    a = aligned(spark, 40, 6).select("row_id", S.codes(F.col("seq")).alias("codes"))
    assert evaluate.null_model(a, 6, 21, 2, 1).w.shape == (6, 21, 2)
    joint = train.joint(teacher, catalog_more.fixed_rbm(3, 3), 1)
    rep = evaluate.half_report(a, rbm.sample(a, joint, 1), joint, teacher, slice(0, 3), slice(0, 2))
    assert rep["weights_moved"] == 0


def test_novelty_by_all_pairs(spark):
    a = aligned(spark, 40, 10, 9)
    rows = [(r.row_id, r.seq) for r in a.collect()]
    want = {i: max(sum(x == y for x, y in zip(s, t)) / 10 for j, t in rows if j >= 20) for i, s in rows if i < 20}
    got = {r.row_id: r.identity for r in geometry.best_identity(a.filter("row_id < 20"), a.filter("row_id >= 20"), S.GAP_FIRST).collect()}
    assert all(np.isclose(got[i], want[i]) for i in want) and len(got) == 20


def test_fasta_ids_meet_split_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">A|x|Q_9BACL/1-2 more words\nAC-\nDE\n>B\nACXDE\n>C second\nACDEF\n>D\nCCCCC\n")
    rows = files.read_fasta(spark, str(tmp_path / "a.fasta"), full_header=True, species=S.species_mnemonic)
    assert [(r.row_id, r.header, r.species) for r in rows.orderBy("row_id").collect()] == [(1, "A|x|Q_9BACL/1-2 more words", "9BACL"), (2, "B", "B"), (3, "C second", "C second"), (4, "D", "D")]
    assert tuple(files.rejected(rows).first()) == (4, 3, 1)
    assert [r.row_id for r in files.read_fasta(spark, str(tmp_path / "a.fasta"), clean=True).orderBy("row_id").collect()] == [1, 3, 4]
    (tmp_path / "h.txt").write_text(">one >two\nACD\n>three\n")
    assert [tuple(r) for r in files.read_headers(spark, str(tmp_path / "h.txt")).orderBy("row_id").collect()] == [(1, "one"), (2, "three")]
    many = spark.createDataFrame([(i, "train" if i % 3 else "test") for i in range(1, 10)], "row_id long, split string")
    files.write_split(many, str(tmp_path / "split"))
    assert sorted(map(tuple, files.read_split(spark, str(tmp_path / "split")).collect())) == sorted(map(tuple, many.collect()))
    big = spark.range(0, 1000, 1, 7).select("id")
    assert files.numbered(big).filter("row_id <> id + 1").count() == 0


def test_small_files(spark, tmp_path):
    rounds = spark.createDataFrame([(2, 0.5), (1, 0.25), (10, 1.0)], "iter int, tp double")
    files.write_row(rounds, "iter", "tp", str(tmp_path / "row"))
    assert [r.value for r in spark.read.text(str(tmp_path / "row")).collect()] == ["0.25\t0.5\t1.0"]
    files.write_report(spark.createDataFrame([(2, "AB 3 1 1 0.3 3 0 0 3 0"), (1, "code k correct correct_null chance n_train n_val n_unused n_paired_train n_paired_other"), (3, "x=1")], "n int, line string"), "n", str(tmp_path / "rep"))
    assert [tuple(r) for r in files.read_report(spark, str(tmp_path / "rep")).collect()] == [("AB", 3, 1)]
    made = []
    get = lambda: files.cached(spark, str(tmp_path / "c"), {"k": 5, "seed": 1, "off": None}, lambda: made.append(1) or rounds)
    assert get().count() == get().count() == 3 and made == [1]
    assert S.config_text({"b": 1, "a": 2, "c": None}) == "a=2_b=1"
    for name in ("rbm_A_N_ITERS=100.hdf5", "rbm_A_N_ITERS=300.hdf5", "rbm_A_N_ITERS=900_iter=250.hdf5", "rbm_A_N_ITERS=900_iter=700.hdf5", "rbm_B_N_ITERS=280.hdf5"):
        (tmp_path / name).write_text("x")
    best = files.find_resumable(spark, str(tmp_path), "rbm_A_N_ITERS=", 299, "*.hdf5")
    assert best[1] == 250 and best[0].endswith("_iter=250.hdf5")
    assert files.find_resumable(spark, str(tmp_path), "rbm_C_", 299, "*.hdf5") is None


def test_rounds_are_written_and_read(spark, tmp_path):
    rounds = spark.createDataFrame([(1, 2.5)], "n_train int, meff double")
    files.write_rounds(rounds, rounds, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "out/rounds")).collect()] == [("1", "2.5")]


def test_logs(spark):
    lines = spark.createDataFrame([("iter=100 mean_abs_diff=1.5f-2 max_abs_diff=0.1 r=0.9 slope=1.0 intercept=NaN mean_h_data=Float32[0.1, 0.99] mean_h_model=[]",), ("iter=200 status=ok drift_before_reset=(w = 1e-3, v = 0.0) drift_after_reset=()",), ("FINAL status=frozen drift_after_reset=(w = 0.0)",)], "line string")
    r = logs.vh(lines).orderBy("iter").first()
    assert (r.iter, r.r, r.mean_abs_diff, r.mean_h_data, r.mean_h_model) == (100, 0.9, 0.015, [0.1, 0.99], [])
    f = {x.iter: x for x in logs.freeze(lines).collect()}
    assert f[200].status == "ok" and f[200].max_before == 1e-3 and f[200].max_after is None
    assert logs.final_status(lines).first()[0] == "frozen" and logs.final_status(lines.filter("false")).first()[0] == "n/a"
    assert [tuple(x) for x in logs.lpl(spark.createDataFrame([(1, "-1.5"), (2, "-1.25")], "row_id long, line string")).collect()] == [(100, -1.5), (200, -1.25)]
    assert logs.norms(lines).columns == ["iter", "mean_norm", "max_norm", "min_norm", "norms"] and logs.firing(lines).count() == 2
    assert logs.numbered_lines(lines).count() == 3 and logs.correlation(lines.filter("false")).count() == 0


def test_clamped_report_of_a_perfect_generator(spark):
    long = stats.long_form(aligned(spark, 30, 8), "species")
    made = evaluate.tiled(long.select("row_id", "pos", "code"), 3)
    rep = {r.bucket: r for r in evaluate.clamped_report(made, long, long).collect()}
    assert rep[0].n_sites == 8 and rep[0].true_single == rep[0].true_mode == 1.0 and rep[0].wrong_single == rep[0].real_to_real < 1


def test_clamped_modes_agree_with_the_long_form_without_joins_of_chains(spark):
    rows = aligned(spark, 90, 8).withColumn("codes", S.codes(F.col("seq")))
    model, keep = catalog_more.fixed_rbm(), [1, 2, 3, 4]
    long = evaluate.clamped(rows, model, keep, 3, 2)
    want = {(r.row_id, r.pos): r.code for r in evaluate.majority(long, ["row_id", "pos"]).collect()}
    first = {(r.row_id, r.pos): r.code for r in long.filter("replica = 1").collect()}
    found = evaluate.clamped_modes(rows, model, keep, 3, 2)
    got = found.collect()
    assert len(got) == 90 and len(want) == 90 * 4
    assert {(r.row_id, p): r["mode"][p - 1] for r in got for p in range(5, 9)} == want
    assert {(r.row_id, p): r.single[p - 1] for r in got for p in range(5, 9)} == first
    assert all(r.single[:4] == r["mode"][:4] == r.codes[:4] for r in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    right = stats.long_form(rows, "species").filter("pos > 4")
    a, b = ({r.bucket: r for r in x.collect()} for x in (evaluate.clamped_report(long, right, right), evaluate.clamped_mode_report(found, rows, keep)))
    assert a == b and a[0].n_sites == 4


def test_draws_of_free_sites_alone(spark):
    ids, model = np.arange(40), catalog_more.fixed_rbm()
    whole, part = rbm.Noise(ids, 3), rbm.Noise(ids, 3)
    assert np.array_equal(whole.gumbel((40, 8, 21))[:, [5, 7]], part.gumbel((40, 8, 21), np.array([5, 7])))
    assert np.array_equal(whole.random((40, 2)), part.random((40, 2)))
    v = np.random.default_rng(1).integers(0, 21, (40, 8))
    mask = np.arange(8) < 4
    x, noise, y = v, rbm.Noise(ids, 5), model.gibbs(v, 3, rbm.Noise(ids, 5), mask)
    for _ in range(3):
        x = model.gibbs(x, 1, noise)
        x[:, mask] = v[:, mask]
    assert np.array_equal(x, y)


def test_lookup_counts_misses(spark):
    left, right = spark.createDataFrame([("a",), ("b",)], "header string"), spark.createDataFrame([(5, "a"), (3, "a")], "row_id long, header string")
    assert {r.header: r.found_row for r in groups.lookup(left, right, "header").collect()} == {"a": 3, "b": None}


def test_order_statistics_by_sorting(spark):
    rng = np.random.default_rng(2)
    x = np.round(np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.exponential(1e6, 500)]), 3)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(6)
    ranks = [1, 2, 700, 2750, 4000, 5499, 5500]
    assert sampling.order_statistics(df, "v", ranks, few=50) == [float(np.sort(x)[k - 1]) for k in ranks]


def test_ranks_in_a_hot_group(spark):
    rows = spark.range(3000).select((F.col("id") * 13 % 3001).alias("row_id"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("s"), F.col("id") % 5)).alias("species")).repartition(5)
    plain = {}
    for r in rows.collect():
        plain.setdefault(r.species, []).append(r.row_id)
    want = {x: sorted(v)[i - 1] for v in plain.values() for i, x in enumerate(sorted(v))}
    assert {r.row_id: r.partner for r in groups.shift_partner(rows).collect()} == want
    pairs = groups.scramble_pairs(rows, 3).collect()
    for s, v in plain.items():
        if s is not None:
            got = [(r.hk, r.rr) for r in pairs if r.species == s]
            assert sorted(a for a, _ in got) == sorted(b for _, b in got) == sorted(v)


def test_queries_that_pair_read_the_alignment_once(spark, monkeypatch):
    rng = np.random.default_rng(14)
    rows = [(i, f"S{i % 4}", "".join(rng.choice(list("ACDE"), 8))) for i in range(60)]
    read = spark.sparkContext.accumulator(0)

    def go(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    kinds = "row_id long, species string, seq string"
    monkeypatch.setattr(catalog, "alignment", lambda s, d: s.createDataFrame(rows, kinds).mapInArrow(go, kinds))
    monkeypatch.setattr(catalog_more, "alignment", catalog.alignment)
    for name in ("assign_k2", "assign_k3", "predict_k3", "one_shot_pairing", "matched_comparison", "free_energy_pairing", "clamped_generation", "flagship"):
        before = read.value
        assert catalog.QUERIES[name](spark, "").count() and (name, read.value - before) == (name, 60)


def test_the_sweep_makes_all_published_rounds(spark, monkeypatch):
    rng = np.random.default_rng(21)
    rows = [(i, f"S{i % 12}", "".join(rng.choice(list("ACDE"), 8))) for i in range(60)]
    monkeypatch.setattr(catalog_more, "alignment", lambda s, d: s.createDataFrame(rows, "row_id long, species string, seq string"))
    monkeypatch.setattr(catalog_more, "STARTS", [1, 20])
    monkeypatch.setattr(catalog_more, "REPLICATES", 2)
    out = {(r.n_start, r["iter"]): r for r in catalog.QUERIES["replicate_sweep"](spark, "").collect()}
    assert sorted(out) == [(n, k) for n in (1, 20) for k in range(1, 6)] and all(0 <= r.tp_mean <= 1 and r.tp_std >= 0 for r in out.values())


def test_batches_take_each_row_once_a_pass(spark, monkeypatch):
    rows = spark.range(70).select(F.col("id").alias("row_id"), F.array(*[((F.col("id") / 5**k).cast("int") % 5 + 1).cast("int") for k in range(3)]).alias("codes"))
    want = sorted((np.array(r.codes) - 1).tolist() for r in rows.collect())

    def three_passes(table):
        dealt = rbm.batches(table, 3, 7, 4)
        return np.concatenate([next(dealt) for _ in range(30)]).reshape(3, 70, 3).tolist()

    once = three_passes(rows)
    assert all(sorted(p) == want for p in once) and once[0] != once[1] and three_passes(rows.repartition(5)) == once
    monkeypatch.setattr(rbm, "HELD", 50)  # five parts, which are read anew in each pass
    assert all(sorted(p) == want for p in three_passes(rows))
    wide = rbm.batches(rows, 3, 150, 4)  # more than there are rows
    assert len(next(wide)) == 150 and np.isclose(np.mean(np.concatenate([next(wide) for _ in range(13)]) == 0), np.mean(np.array(want) == 0), atol=0.02)
    assert next(rbm.batches(rows.filter("false"), 3, 7, 4)).shape == (0, 3)
    v, m = np.array(want), catalog_more.fixed_rbm(3)
    assert all(np.allclose(a, b) for a, b in zip(rbm.batch_moments(v, m), rbm.moments(rows, m)))


def test_clamped_generation_trains_for_all_published_steps(spark, monkeypatch):
    rng = np.random.default_rng(22)
    rows = [(i, f"S{i % 4}", h * 8) for i, h in enumerate(rng.choice(list("AC"), 80).tolist())]
    monkeypatch.setattr(catalog_more, "alignment", lambda s, d: s.createDataFrame(rows, "row_id long, species string, seq string"))
    given, train = [], rbm.train

    def shorter(table, model, iterations, **more):
        given.append((iterations, more["batch"]))
        return train(table, model, 2000, **more)

    monkeypatch.setattr(rbm, "train", shorter)
    out = {r.bucket: r for r in catalog.QUERIES["clamped_generation"](spark, "").collect()}
    assert given == [(10_000, 256)]
    assert out[0].true_mode > 0.4 and out[0].true_single > 0.4  # after two steps about one in 21
    monkeypatch.setattr(catalog_more, "STEPS", 3)
    monkeypatch.setattr(catalog_more, "BATCH", 16)
    catalog.QUERIES["clamped_generation"](spark, "").collect()
    assert given[1] == (10, 16)  # two passes over 80 rows
