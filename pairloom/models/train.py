"""Training of restricted Boltzmann machines by persistent contrastive divergence, and what is watched meanwhile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame

from pairloom.models.rbm import RBM, moments

BLOCKS = ("g", "theta", "w")


@dataclass
class Adam:
    """Adam over the parameter blocks; with b1 = 0 only the scale of each gradient is followed. clip bounds a block's norm."""

    rate: float = 1e-3
    b1: float = 0.0
    b2: float = 0.999
    clip: float | None = None
    n: int = 0
    m: dict[str, np.ndarray] = field(default_factory=dict)
    s: dict[str, np.ndarray] = field(default_factory=dict)

    def step(self, grad: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.n += 1
        out = {}
        for k, g in grad.items():
            size = float(np.sqrt((g * g).sum()))
            if self.clip is not None and size > self.clip:
                g = g * (self.clip / size)
            self.m[k] = self.b1 * self.m.get(k, 0.0) + (1 - self.b1) * g
            self.s[k] = self.b2 * self.s.get(k, 0.0) + (1 - self.b2) * g * g
            out[k] = self.rate * (self.m[k] / (1 - self.b1**self.n)) / (np.sqrt(self.s[k] / (1 - self.b2**self.n)) + 1e-8)
        return out


def project(model: RBM, left: RBM, right: RBM) -> RBM:
    """The joint model with both halves' parameters put in place, and weights of one half to the other's hidden units 0.

    Hidden units: the left half's, the right half's, then the joint model's own, which alone may learn.
    """
    a, ha, hb = len(left.g), len(left.theta), len(right.theta)
    g, theta, w = model.g.copy(), model.theta.copy(), model.w.copy()
    g[:a], g[a:], theta[:ha], theta[ha : ha + hb] = left.g, right.g, left.theta, right.theta
    w[:a, :, :ha], w[a:, :, ha : ha + hb] = left.w, right.w
    w[a:, :, :ha], w[:a, :, ha : ha + hb] = 0, 0
    return replace(model, g=g, theta=theta, w=w)


def joint(left: RBM, right: RBM, more: int, seed: int = 0) -> RBM:
    """A model of both halves with `more` hidden units of its own, at their start."""
    sites = len(left.g) + len(right.g)
    out = RBM.start(sites, left.g.shape[1], len(left.theta) + len(right.theta) + more, seed)
    return project(replace(out, split=len(left.g)), left, right)


def drift(model: RBM, left: RBM, right: RBM) -> dict[str, float]:
    """The largest difference to the frozen blocks, by block."""
    want = project(model, left, right)
    return {k: float(np.abs(getattr(model, k) - getattr(want, k)).max(initial=0)) for k in BLOCKS}


def assert_frozen(model: RBM, left: RBM, right: RBM, most: float = 1e-6) -> None:
    moved = {k: x for k, x in drift(model, left, right).items() if not x <= most}
    if moved:
        raise RuntimeError(f"frozen parameters moved: {moved}")


def batch_of(rows: DataFrame, n: int, epoch: int, size: int, seed: int) -> DataFrame:
    """About `size` of n rows, another part of them in each epoch; no more than there are. Decided by each row's own hash."""
    from pyspark.sql import functions as F

    parts = max(1, round(n / max(1, size)))
    h = F.xxhash64("row_id", F.lit(seed), F.lit(epoch // parts))
    return rows.filter(F.pmod(h, F.lit(parts)) == epoch % parts)


def train(
    rows: DataFrame, model: RBM, iterations: int, rate: float = 0.01, steps: int = 5, chains: int = 200, reg: float = 1e-3, seed: int = 0, batch: int | None = None,
    clip: float | None = None, frozen: tuple[RBM, RBM] | None = None, reset: bool = True, callback: Callable[[int, RBM, np.ndarray, dict], None] | None = None, save_every: int = 0, saved: Callable[[int, RBM], None] | None = None,
) -> tuple[RBM, list[tuple[int, float]]]:
    """The trained model and (iteration, log pseudolikelihood of the chains) of each.

    frozen: models of the two halves whose parameters stay: their gradients are 0 and, with `reset`, they are put
    back after each step; drift is an error. Without it the model learns from scratch (the null model).
    callback(iteration, model, chains, gradients); saved(iteration, model) every `save_every` iterations.
    """
    rng, opt, n = np.random.default_rng(seed), Adam(rate, clip=clip), rows.count() if batch else 0
    sites, states, _ = model.w.shape
    x, log = rng.integers(0, states, (chains, sites)), []
    for k in range(1, iterations + 1):
        gv, gh, gw = moments(batch_of(rows, n, k - 1, batch, seed) if batch else rows, model)
        x = model.gibbs(x, steps, rng)
        one, h = np.eye(states)[x], model.mean_hidden(x)
        grad = {"g": gv - one.mean(0), "theta": gh - h.mean(0), "w": gw - np.einsum("nia,nm->iam", one, h) / chains - reg * model.w}
        if frozen:
            free = project(replace(model, g=np.ones_like(model.g), theta=np.ones_like(model.theta), w=np.ones_like(model.w)), *(replace(z, g=z.g * 0, theta=z.theta * 0, w=z.w * 0) for z in frozen))
            grad = {b: v * getattr(free, b) for b, v in grad.items()}
        moved = opt.step(grad)
        model = replace(model, **{b: getattr(model, b) + v for b, v in moved.items()})
        if frozen:
            if reset:
                model = project(model, *frozen)
            assert_frozen(model, *frozen)
        log.append((k, float(model.pseudolikelihood(x).mean())))
        if callback:
            callback(k, model, x, grad)
        if saved and save_every and k % save_every == 0:
            saved(k, model)
    return model, log


def alignment(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """r, slope and intercept of y on x, and the mean and largest absolute difference; nan where x or y is constant."""
    x, y = np.ravel(x).astype(float), np.ravel(y).astype(float)
    dx, dy = x - x.mean(), y - y.mean()
    vx, vy = (dx * dx).mean(), (dy * dy).mean()
    slope = (dx * dy).mean() / vx if vx else np.nan
    return {"r": (dx * dy).mean() / np.sqrt(vx * vy) if vx and vy else np.nan, "slope": slope, "intercept": y.mean() - slope * x.mean(), "mean_abs_diff": np.abs(x - y).mean(), "max_abs_diff": np.abs(x - y).max(initial=0)}


def connected(v: np.ndarray, states: int, split: int) -> np.ndarray:
    """Joint less product of means of all states of left and right sites."""
    one = np.eye(states)[v].reshape(len(v), -1)
    a, b = one[:, : split * states], one[:, split * states :]
    return a.T @ b / len(v) - np.outer(a.mean(0), b.mean(0))


def diagnostics(model: RBM, data: np.ndarray, chains: np.ndarray, split: int, added: int = 0, heldout: np.ndarray | None = None, grad: dict | None = None) -> list[tuple[str, str, float]]:
    """(check, name, value) of data and chains (codes from 0): vh, h, v, ab, ab_val, firing, norms and pseudolikelihood.

    added: hidden units from this one on are looked at.
    """
    states = model.g.shape[1]
    hd, hm = model.mean_hidden(data)[:, added:], model.mean_hidden(chains)[:, added:]
    vd, vm = np.eye(states)[data], np.eye(states)[chains]
    out = []

    def add(check: str, values: dict[str, float]) -> None:
        out.extend((check, k, float(x)) for k, x in values.items())

    add("vh", alignment(np.einsum("nia,nm->iam", vd, hd) / len(data), np.einsum("nia,nm->iam", vm, hm) / len(chains)))
    add("h", alignment(hd.mean(0), hm.mean(0)))
    add("v", alignment(vd.mean(0), vm.mean(0)))
    add("ab", alignment(connected(data, states, split), connected(chains, states, split)))
    if heldout is not None:
        add("ab_val", alignment(connected(heldout, states, split), connected(chains, states, split)))
        add("lpl_val", {"mean": model.pseudolikelihood(heldout).mean()})
    for name, rates in (("firing_data", firing(hd)), ("firing_model", firing(hm))):
        add(name, {str(added + k): r for k, r in enumerate(rates)})
    for check, w in (("wn", model.w), ("gn", None if grad is None else grad["w"])):
        if w is not None:
            norms = np.sqrt((w**2).sum(axis=(0, 1)))[added:]
            add(check, {"mean_norm": norms.mean(), "max_norm": norms.max(), "min_norm": norms.min()} | {f"norm_{added + k}": x for k, x in enumerate(norms)})
    return out


def firing(h: np.ndarray) -> np.ndarray:
    """Share of rows in which each unit is on."""
    return (h > 0.5).mean(axis=0)
