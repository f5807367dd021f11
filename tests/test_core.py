import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom import catalog
from pairloom.functions import symbols as S
from pairloom.models.rbm import RBM, load, save
from pairloom.operators import assign, cluster
from pairloom.sources import files
from pairloom.streaming.logs import windowed_metric

SF = "/root/testdata/sf0.001"
FAST = ["seq_encode", "species_rules", "species_groups", "dedup_first_global", "weights_hamming", "pmi", "pair_scores", "coupling_strength", "consensus", "match_rates", "conservation_quartiles", "best_median_worst", "tail_mean", "hit_miss", "near_dup_pairs", "components", "species_target_split", "nn_distance", "coverage", "log_mining"]


@pytest.mark.parametrize("name", FAST)
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "orders", "customer", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda rows: sorted((tuple(r[c] for c in cols) for r in rows), key=repr)
    assert key([r.asDict() for r in df.collect()]) == key([dict(zip(want.columns, r)) for r in want.fetchall()])


@pytest.mark.parametrize("k", [2, 3, 5, 6])
def test_assignment_and_gaps_against_all_permutations(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        s = rng.normal(size=(k, k))
        col, gap = assign.assign(s, rng)
        totals = {p: s[np.arange(k), list(p)].sum() for p in itertools.permutations(range(k))}
        best = max(totals.values())
        assert np.isclose(s[np.arange(k), col].sum(), best)
        for i in range(k):
            without = max(v for p, v in totals.items() if p[i] != col[i])
            assert np.isclose(gap[i], best - without)


def test_assignment_edge_cases():
    rng = np.random.default_rng(0)
    assert assign.assign(np.array([[-2.0]]), rng)[1][0] == 2.0
    col, gap = assign.assign(np.ones((4, 4)), rng)
    assert sorted(col) == [0, 1, 2, 3] and not gap.any()


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">A|x|Q_9BACL/1-2 more\nAC-\nDE\n>B\nACXDE\n>C\nACDEF\n")
    rows = files.read_fasta(spark, str(tmp_path))
    assert [(r.header, r.seq) for r in rows.orderBy("row_id").collect()] == [("A|x|Q_9BACL/1-2", "AC-DE"), ("B", "ACXDE"), ("C", "ACDEF")]
    assert files.read_fasta(spark, str(tmp_path), clean=True).count() == 2
    assert files.check_width(rows) == 5


def test_replicates_and_splits(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/N10_r1.txt").write_text("0.5\t0.75\n")
    (tmp_path / "r/N10_r2.txt").write_text("0.25\t0.25\n")
    (tmp_path / "r/other.txt").write_text("9\n")
    wide = files.summarise_replicates(files.read_replicates(spark, str(tmp_path / "r")), 2).collect()
    assert [tuple(r) for r in wide] == [(10, 2, 0.375, 0.5)]
    (tmp_path / "s.txt").write_text("1 2 3\n4,5\n")
    assert sorted(tuple(r) for r in files.read_split(spark, str(tmp_path / "s.txt")).collect()) == [(1, "train"), (2, "train"), (3, "train"), (4, "test"), (5, "test")]
    assert files.read_log(spark, str(tmp_path / "none")).count() == 0


def test_grouped_split_against_a_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(5)
    names = ["HOT"] * 40 + ["WARM"] * 30 + ["9BACT", "UNKA", None] * 4 + [f"S{i % 9}" for i in range(18)]
    seqs = ["".join(rng.choice(list("ACDEFGHIKLMN"), 8)) for _ in names]
    for i in (70, 73, 85):
        seqs[i] = seqs[0][:7] + "W"
    rows = list(zip(range(len(names)), names, seqs))
    label = list(range(len(rows)))
    for _ in rows:
        for i, s, x in rows:
            for j, t, y in rows:
                if sum(a != b for a, b in zip(x, y)) <= 1 or (s == t and s not in ("9BACT", "UNKA", None)):
                    label[i] = label[j] = min(label[i], label[j])
    target = {"train": len(rows) * 7 // 10, "val": len(rows) // 5}
    have, want = {"train": 0, "val": 0}, {}
    for c in sorted(set(label), key=lambda c: (-label.count(c), c)):
        train, val = (have[s] < target[s] for s in ("train", "val"))
        if train and (not val or have["train"] / target["train"] <= have["val"] / target["val"]):
            want[c] = "train"
        else:
            want[c] = "val" if val else "unused"
        if want[c] in have:
            have[want[c]] += label.count(c)
    assert want[label[40]] == "val" and label.count(label[40]) > target["val"] and label[85] == 0
    monkeypatch.setattr(catalog, "alignment", lambda s, d: spark.createDataFrame(rows, "row_id long, species string, seq string"))
    assert {r.row_id: r.split for r in catalog.QUERIES["grouped_split"](spark, SF).collect()} == {i: want[c] for i, c in enumerate(label)}


def test_pairing_goes_on_until_all_predictions_are_learnt_from(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, f"S{i % 3}", "".join(rng.choice(list("ACDE"), 8))) for i in range(10)]
    monkeypatch.setattr(catalog, "alignment", lambda s, d: spark.createDataFrame(rows, "row_id long, species string, seq string"))
    got = sorted(tuple(r)[:2] for r in catalog.QUERIES["pairing_rounds"](spark, SF).collect())
    assert got == [(1, 10), (2, 2), (3, 4), (4, 6), (5, 8), (6, 10)]


def test_free_energy_by_enumeration():
    m = RBM.start(3, 2, 2, 1)
    m.g[:] = np.random.default_rng(2).normal(size=m.g.shape)
    for v in itertools.product(range(2), repeat=3):
        z = sum(np.exp(sum(m.g[i, a] for i, a in enumerate(v)) + sum(h[k] * (m.theta[k] + sum(m.w[i, a, k] for i, a in enumerate(v))) for k in range(2))) for h in itertools.product((0, 1), repeat=2))
        assert np.isclose(m.free_energy(np.array([v]))[0], -np.log(z))


def test_rbm_round_trip(spark, tmp_path):
    m = RBM.start(2, 3, 2, 4)
    save(spark, m, str(tmp_path / "m"))
    assert np.allclose(load(spark, str(tmp_path / "m")).w, m.w)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(50).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), F.concat(F.lit("iter=1 r="), (F.col("id") % 7).cast("string")).alias("line"))
    rows.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_metric(src, "r").writeStream.outputMode("complete").format("memory").queryName("metric").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("metric").collect())) == sorted(map(tuple, windowed_metric(rows, "r").collect()))
    assert rows.select(S.kv_scalar(F.lit("a=6.7f-5"), "a")).first()[0] == 6.7e-5
