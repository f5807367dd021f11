"""What a trained model is held against: chains and their traces, clamped generation, strengths, overlaps, reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.models import rbm as M
from pairloom.models.train import Adam, alignment, train
from pairloom.operators import groups, rank, stats
from pairloom.storage import materialize


def tiled(rows: DataFrame, replicas: int) -> DataFrame:
    """Each row `replicas` times, with replica 1, 2, .."""
    return rows.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicas))))


def majority(long: DataFrame, by: list[str]) -> DataFrame:
    """(by, code): the commonest code of each cell, the least of equal ones."""
    n = long.groupBy(*by, "code").agg(F.count("*").alias("n"))
    best = n.groupBy(*by).agg(F.max(F.struct("n", (-F.col("code")).alias("c"))).alias("b"))
    return best.select(*by, (-F.col("b.c")).alias("code"))


def free_energy_trace(chain: DataFrame) -> DataFrame:
    """(sweep, mean, std) of chains(row_id, sweep, free_energy)."""
    return chain.groupBy("sweep").agg(F.avg("free_energy").alias("mean"), F.stddev_samp("free_energy").alias("std"))


def convergence(chain: DataFrame, data: DataFrame, model: M.RBM, units: slice = slice(None)) -> list[tuple[int, float, float, float]]:
    """(sweep, r_h, r_v, r_hv): how the means of h, v and v h of chains agree with data's, at each point of the trace."""
    v, h, vh = M.moments(data, model)
    out = []
    for s in [r["sweep"] for r in chain.select("sweep").distinct().orderBy("sweep").collect()]:  # as many as were asked for
        cv, ch, cvh = M.moments(chain.filter(F.col("sweep") == s), model)
        out.append((s, alignment(h[units], ch[units])["r"], alignment(v, cv)["r"], alignment(vh[:, :, units], cvh[:, :, units])["r"]))
    return out


def clamped(rows: DataFrame, model: M.RBM, keep: list[int], replicas: int, sweeps: int, seed: int = 0) -> DataFrame:
    """(row_id, replica, pos, code) of the sites that are not in `keep`, generated with those held to the row's."""
    nested = lambda v: [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * replicas), M.code_lists(v.reshape(-1, v.shape[2])))]
    made = _generated(rows, model, keep, replicas, sweeps, seed, "made array<array<int>>", nested)
    out = made.select("row_id", F.posexplode("made").alias("replica", "codes")).select("row_id", (F.col("replica") + 1).alias("replica"), F.posexplode("codes").alias("pos", "code")).withColumn("pos", F.col("pos") + 1)
    return out.filter(~F.col("pos").isin(keep))


def clamped_modes(rows: DataFrame, model: M.RBM, keep: list[int], replicas: int, sweeps: int, seed: int = 0) -> DataFrame:
    """(row_id, codes, single, mode): rows(row_id, codes) with what clamped() generates, as codes of all sites.

    single is replica 1, mode the commonest code of each site over all replicas (the least of equal ones). A row's replicas are one
    array, so nothing is shuffled.
    """

    def most(v: np.ndarray) -> list[pa.Array]:
        count = (v[:, :, :, None] == np.arange(model.g.shape[1])).sum(axis=1)
        return [M.code_lists(v[:, 0]), M.code_lists(count.argmax(axis=2))]

    return _generated(rows, model, keep, replicas, sweeps, seed, "single array<int>, mode array<int>", most)


def _generated(rows: DataFrame, model: M.RBM, keep: list[int], replicas: int, sweeps: int, seed: int, kinds: str, give: Callable[[np.ndarray], list[pa.Array]]) -> DataFrame:
    """(row_id, codes) and the columns of `kinds`, which `give` makes of codes from 0 by row, replica and site."""
    chain = lambda r: F.xxhash64("row_id", r)
    drawn = lambda r, i: (F.pmod(F.xxhash64(chain(r), i, F.lit(seed)), F.lit(model.g.shape[1])) + 1).cast("int")
    each = F.sequence(F.lit(1), F.lit(replicas))
    start = F.flatten(F.transform(each, lambda r: F.transform("codes", lambda c, i: F.when((i + 1).isin(keep), c).otherwise(drawn(r, i)))))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = M.held(model, keep)
        step = max(1, 500 // replicas)
        for whole in batches:
            for x in range(0, whole.num_rows, step):
                b = whole.slice(x, step)
                ids, v = b.column("chain").flatten().to_numpy(), b.column("start").flatten().to_numpy().astype(np.int64) - 1
                v = model.gibbs(v.reshape(len(ids), -1), sweeps, M.Noise(ids, seed), mask)
                made = give(v.reshape(b.num_rows, replicas, -1))
                yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("codes"), *made], ["row_id", "codes", *(k.split()[0] for k in kinds.split(", "))])

    return rows.select("row_id", "codes", F.transform(each, chain).alias("chain"), start.alias("start")).mapInArrow(go, f"row_id long, codes array<int>, {kinds}")


def clamped_report(made: DataFrame, truth: DataFrame, reference: DataFrame) -> DataFrame:
    """(bucket, n_sites, true_single, true_mode, wrong_single, wrong_mode, consensus, real_to_real): shares of sites that agree.

    made(row_id, replica, pos, code) is held against truth(row_id, species, pos, code): the row's own and its
    predecessor's in its species (the wrong partner), and against the consensus of reference(pos, code).
    bucket: 0 for all sites, 1 to 4 by quartiles of the reference's conservation.
    """
    partner = groups.shift_partner(truth.select("row_id", "species").distinct())
    own = truth.select("row_id", "pos", F.col("code").alias("own"))
    wrong = partner.join(truth.select(F.col("row_id").alias("partner"), "pos", F.col("code").alias("wrong")), "partner").select("row_id", "pos", "wrong")
    mode = majority(made, ["row_id", "pos"]).withColumnRenamed("code", "mode")
    single = made.filter("replica = 1").select("row_id", "pos", F.col("code").alias("single"))
    return _agreement(single.join(mode, ["row_id", "pos"]).join(own, ["row_id", "pos"]).join(wrong, ["row_id", "pos"]), rank.consensus(reference))


def clamped_mode_report(made: DataFrame, rows: DataFrame, keep: list[int]) -> DataFrame:
    """clamped_report() of clamped_modes() against rows(row_id, species, codes) and their own consensus, over the sites that are not in `keep`.

    A row meets its wrong partner as a whole, not site by site; sites are counted where the rows meet.
    """
    partner = groups.shift_partner(rows.select("row_id", "species").distinct())
    # file sizes are far below what such arrays take in memory, so none may be broadcast by them
    wrong = partner.join(rows.select(F.col("row_id").alias("partner"), F.col("codes").alias("wrong")).hint("merge"), "partner").select("row_id", "wrong")
    names = ["single", "mode", "own", "wrong"]
    whole = made.withColumnRenamed("codes", "own").hint("merge").join(wrong, "row_id").select(F.posexplode(F.arrays_zip(*names)).alias("pos", "x"))
    cells = whole.select((F.col("pos") + 1).alias("pos"), *[F.col(f"x.{c}").alias(c) for c in names])
    free = lambda long: long.filter(~F.col("pos").isin(keep))
    reference = rows.select(F.posexplode("codes").alias("pos", "code")).withColumn("pos", F.col("pos") + 1)
    return _agreement(free(cells), rank.consensus(free(reference)))


def _agreement(cells: DataFrame, cons: DataFrame) -> DataFrame:
    """The report from cells(pos, single, mode, own, wrong) and the consensus; cells are counted by site, a table of as many rows as sites."""
    sites = rank.quartiles(materialize(cons, "consensus"), "conservation").select("pos", F.col("code").alias("common"), "bucket")
    pairs = {"true_single": ("single", "own"), "true_mode": ("mode", "own"), "wrong_single": ("single", "wrong"), "wrong_mode": ("mode", "wrong"), "consensus": ("common", "own"), "real_to_real": ("own", "wrong")}
    same = cells.join(F.broadcast(sites), "pos").groupBy("pos", "bucket").agg(F.count("*").alias("n"), *[F.count_if(F.col(a) == F.col(b)).alias(k) for k, (a, b) in pairs.items()])
    both = same.withColumn("bucket", F.explode(F.array(F.lit(0), "bucket")))
    return both.groupBy("bucket").agg(F.count("*").alias("n_sites"), *[(F.sum(k) / F.sum("n")).alias(k) for k in pairs])


def strengths_report(named: dict[str, DataFrame], width: int, width_a: int, share: float) -> DataFrame:
    """(source, r, overlap, hits, missed, false_alarms): coupling strengths of each source's rows (row_id, seq) against those of the first.

    r: of the strengths of all pairs of sites; the rest: of the strongest `share` of them.
    """
    made = {k: materialize(stats.coupling_strength(stats.connected_corr(stats.long_form(v), width, width_a)), "strengths") for k, v in named.items()}
    first = next(iter(made))
    top = {k: materialize(rank.top_share(v, share), "top") for k, v in made.items()}
    out = None
    for k in made:
        both = made[first].select("i", "j", F.col("strength").alias("x")).join(made[k].select("i", "j", F.col("strength").alias("y")), ["i", "j"])
        cat = rank.hit_miss(top[first], top[k], made[first])
        n = cat.agg(*[F.count_if(F.col("category") == c).alias(a) for c, a in ((1, "hits"), (2, "missed"), (3, "false_alarms"))])
        one = both.agg(stats.safe_r("x", "y").alias("r")).crossJoin(rank.overlap(top[first], top[k]).select(F.col("share").alias("overlap"))).crossJoin(n).select(F.lit(k).alias("source"), "*")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def half_report(data: DataFrame, chain: DataFrame, joint: M.RBM, half: M.RBM, sites: slice, units: slice) -> dict[str, float]:
    """How well a half's moments survive inside the joint model: r of v, h and v h between data(codes) and chains(codes) of the joint model."""
    v, h, vh = M.moments(data, joint)
    cv, ch, cvh = M.moments(chain, joint)
    kept = float(np.abs(joint.w[sites, :, units] - half.w).max(initial=0))
    return {"r_v": alignment(v[sites], cv[sites])["r"], "r_h": alignment(h[units], ch[units])["r"], "r_hv": alignment(vh[sites, :, units], cvh[sites, :, units])["r"], "weights_moved": kept}


def sampler_checks(model: M.RBM, data: np.ndarray, sweeps: int, chains: int = 200, seed: int = 0) -> dict[str, float]:
    """r of the site means with data's (codes from 0) after cold and warm starts, one long call and many short ones."""
    rng = np.random.default_rng(seed)
    states = model.g.shape[1]
    mean = lambda v: np.eye(states)[v].mean(0)
    cold, warm = rng.integers(0, states, (chains, data.shape[1])), data[rng.integers(0, len(data), chains)]
    many = cold
    for _ in range(sweeps):
        many = model.gibbs(many, 1, rng)
    out = {"cold": model.gibbs(cold, sweeps, rng), "warm": model.gibbs(warm, sweeps, rng), "long": model.gibbs(cold, 4 * sweeps, rng), "many_calls": many}
    return {k: alignment(mean(data), mean(x))["r"] for k, x in out.items()}


def null_model(rows: DataFrame, sites: int, states: int, units: int, iterations: int, seed: int = 0) -> M.RBM:
    """A model of both halves that learns from scratch, with nothing carried over."""
    return train(rows, M.RBM.start(sites, states, units, seed), iterations, seed=seed)[0]


def class_pair_rows(images: DataFrame, a: int, b: int, least: float = 0.5) -> DataFrame:
    """(row_id, label, codes): images(row_id, label, pixels) of two classes; a pixel of at least `least` is state 2, else 1."""
    return images.filter(F.col("label").isin(a, b)).select("row_id", "label", F.transform("pixels", lambda x: F.when(x >= least, 2).otherwise(1)).alias("codes"))


def class_pairs(images: DataFrame) -> DataFrame:
    """(a, b), a < b, of the classes that occur."""
    c = images.select("label").distinct()  # of classes, not of rows
    return c.select(F.col("label").alias("a")).join(c.select(F.col("label").alias("b")), F.col("a") < F.col("b"))


def log_spaced(last: int, per_decade: int = 4) -> list[int]:
    """Whole numbers from 1 to last, evenly spaced in their logarithm."""
    n = max(1, round(per_decade * np.log10(max(last, 1))))
    return sorted({int(round(last ** (k / n))) for k in range(n + 1)})


def train_class_pair(images: DataFrame, a: int, b: int, units: int, iterations: int, seed: int = 0) -> dict[int, M.RBM]:
    """Models of one pair of classes, kept at log-spaced iterations."""
    rows = class_pair_rows(images, a, b)
    width = rows.select(F.size("codes").alias("n")).first()
    want, kept = set(log_spaced(iterations)), {}
    train(rows, M.RBM.start(width["n"] if width else 1, 2, units, seed), iterations, seed=seed, callback=lambda k, m, *_: kept.update({k: m}) if k in want else None)
    return kept


def train_aligned(rows: DataFrame, teacher: M.RBM, units: int, iterations: int, share: float = 0.5, rate: float = 0.01, chains: int = 200, steps: int = 1, seed: int = 0) -> M.RBM:
    """A student of rows(row_id, codes, teacher_codes) whose hidden units follow a teacher's: gradient (1 - share) dv + share dh ** 2.

    dv is the usual gradient given the rows; dh that given the teacher's hidden means of the partner's
    codes, which needs as many units as the teacher has. Chains move on in each iteration.
    """
    if units != len(teacher.theta):
        raise ValueError("student and teacher need equally many hidden units")
    sites, states = rows.select(F.size("codes")).first()[0], teacher.g.shape[1]
    model, opt, rng = M.RBM.start(sites, states, units, seed), Adam(rate), np.random.default_rng(seed)
    x = rng.integers(0, states, (chains, sites))
    _, target, _ = M.moments(rows.select(F.col("teacher_codes").alias("codes")), teacher)
    for _ in range(iterations):
        gv, gh, gw = M.moments(rows, model)
        x = model.gibbs(x, steps, rng)
        one, h = np.eye(states)[x], model.mean_hidden(x)
        field = model.g[None] + np.einsum("iam,m->ia", model.w, target)[None]
        top = np.exp(field - field.max(axis=2, keepdims=True))[0]
        led = top / top.sum(axis=1, keepdims=True)
        mv, mh, mw = one.mean(0), h.mean(0), np.einsum("nia,nm->iam", one, h) / chains
        dh = {"g": led - mv, "theta": target - mh, "w": led[:, :, None] * target - mw}
        dv = {"g": gv - mv, "theta": gh - mh, "w": gw - mw}
        moved = opt.step({k: (1 - share) * dv[k] + share * dh[k] ** 2 for k in dv})
        model = replace(model, **{k: getattr(model, k) + v for k, v in moved.items()})
    return model
