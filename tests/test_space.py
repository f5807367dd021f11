"""Neighbours, components of vectors and of graphs, and order statistics: against plain ways."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import cluster, geometry, sampling


def _vectors(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("block", [7, 4096])
def test_neighbours_are_exact_and_few_pairs_are_measured(spark, monkeypatch, block):
    monkeypatch.setattr(geometry, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 12)) * np.linspace(3, 0.2, 12)
    x[7] = x[3]
    v = _vectors(spark, x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {r.vec_id: r.distance for r in geometry.nearest(v, v).collect()}
    assert np.allclose([got[i] for i in range(60)], d.min(axis=1), atol=1e-9)
    some = geometry.nearest(v.filter("vec_id < 9"), v.filter("vec_id >= 20"), exclude_self=False)
    assert np.allclose([r.distance for r in some.orderBy("vec_id").collect()], d[:9, 20:].min(axis=1), atol=1e-9)
    assert geometry.nearest(v.limit(1), v.limit(1)).count() == 0 and geometry.nearest(v, v.limit(0)).count() == 0
    if block == 4096:
        assert geometry.measured_share(v, v) < 0.5


def test_wide_components_agree_with_the_covariance(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) @ (rng.normal(size=(5, 80)) * np.array([9, 6, 4, 2, 1])[:, None]) + 0.01 * rng.normal(size=(300, 80)) + 5
    v = _vectors(spark, x).repartition(3)
    a, b = geometry.principal_components(v, 4).collect(), geometry.wide_components(v, 4).collect()
    for p, q in zip(a, b):
        assert abs(p.explained - q.explained) < 1e-9 and np.allclose(p.loadings, q.loadings, atol=1e-6) and np.allclose(p.mean, q.mean)
    flat = geometry.wide_components(_vectors(spark, np.ones((4, 6))), 2).collect()
    assert all(r.explained < 1e-12 for r in flat)
    assert geometry.wide_components(v.limit(0), 2).collect() == []


def test_components_of_paths_hubs_and_pieces(spark, monkeypatch):
    rng = np.random.default_rng(3)
    path = [(i, i + 1) for i in range(400)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    edges = [path[i] for i in rng.permutation(len(path))] + hub + [(2000, 2001), (2001, 2000), (3, 3), (None, 5)]
    for held in (5, 500_000):
        monkeypatch.setattr(cluster, "HELD", held)
        e = spark.createDataFrame(edges, "a long, b long").repartition(5)
        nodes = spark.createDataFrame([(i,) for i in [*range(401), *range(1000, 1300), 2000, 2001, 7777]], "v long")
        got = {r.v: r.component for r in cluster.components(nodes, e).collect()}
        assert len(got) == 401 + 300 + 3
        assert all(got[i] == 0 for i in range(401)) and all(got[1000 + i] == 1000 for i in range(300)) and got[2001] == 2000 and got[7777] == 7777
    assert cluster.components(nodes, e.limit(0)).filter("v <> component").count() == 0


def test_order_statistics_with_ties_and_tight_brackets(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=5000), 2)
    df = spark.createDataFrame([(float(c),) for c in x] + [(None,)], "v double")
    ranks = [1, 2, 1250, 2500, 4999, 5000]
    for few in (3, 100_000):
        assert sampling.order_statistics(df, "v", ranks, few=few) == [float(np.sort(x)[k - 1]) for k in ranks]
    whole = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert sampling.order_statistics(whole, "v", [500, 1, 1000]) == [499, 0, 999]


def test_nearest_of_close_and_of_huge_vectors(spark):
    rng = np.random.default_rng(12)
    for scale, shift in ((1e-4, 1000.0), (1e18, 0.0)):  # differences below single precision's steps; squares beyond its range
        x = rng.normal(size=(60, 8)) * scale + shift
        v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        got = {r.vec_id: r.distance for r in geometry.nearest(v, v).collect()}
        assert len(got) == 60 and all(np.isclose(got[i], d[i].min(), rtol=1e-6) for i in got)
