"""Models advanced together, restarts, one divisive tree and neighbour layouts, against plain numpy and Spark's own fits."""

import math

import numpy as np
import pytest
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from dosepath.operators import cluster, layout, lloyd, validity


def blobs(n, k, d, seed, apart=6.0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(k, d))[rng.integers(0, k, size=n)] * apart + rng.normal(size=(n, d))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "person_id long, z array<double>").repartition(6).cache()


def plain(x, centres, rounds):
    for _ in range(rounds):
        at = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[at == i].mean(axis=0) if (at == i).any() else centres[i] for i in range(len(centres))])
    d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    return centres, np.bincount(d.argmin(axis=1), minlength=len(centres)), d.min(axis=1).sum()


def test_models_advanced_together_equal_each_alone(spark):
    x = blobs(700, 5, 4, 1)
    starts = [x[:2], x[5:9], np.vstack([x[:3], x[0]]), x[10:16]]  # one start twice the same: an empty cluster
    found = lloyd.advanced(frame(spark, x), "z", starts, rounds=6, tolerance=-1.0)
    for m, start in zip(found, starts, strict=True):
        centres, n, cost = plain(x, start, 6)
        assert np.allclose(m.centres, centres) and (m.n == n).all() and math.isclose(m.cost, cost, rel_tol=1e-9)


def test_rounds_read_the_rows_once_for_all_models(spark, monkeypatch):
    x, scans = blobs(200, 3, 3, 2), []
    real = lloyd._gathered
    monkeypatch.setattr(lloyd, "_gathered", lambda *a: scans.append(1) or real(*a))
    lloyd.advanced(frame(spark, x), "z", [x[:k] for k in (2, 3, 4, 5, 6)], rounds=3, tolerance=-1.0)
    assert len(scans) == 4  # three rounds and the costs
    scans.clear()
    rows = frame(spark, x / np.linalg.norm(x, axis=1)[:, None]).withColumn("features_cosine", array_to_vector("z"))
    found = cluster.silhouette_grid(rows, range(2, 7), 1)
    assert [k for k, _, _ in found] == [2, 3, 4, 5, 6] and len(scans) <= cluster.ROUNDS + 3


@pytest.mark.parametrize("n_init", [1, 10])
def test_restarts_are_no_worse_than_one(spark, n_init):
    x = blobs(600, 8, 3, 3, apart=4.0)
    found = lloyd.restarted(frame(spark, x), "z", [4, 8], n_init=n_init, seed=5)
    for k, models in found.items():
        costs = [m.cost for m in models]
        assert len(costs) == n_init and costs == sorted(costs)
        again = lloyd.restarted(frame(spark, x), "z", [k], n_init=1, seed=5)[k][0]
        assert costs[0] <= again.cost * (1 + 1e-9)


def test_index_table_equals_indices_of_its_labels(spark):
    x = blobs(500, 4, 3, 4)
    rows = frame(spark, x)
    table = validity.index_table(rows, "z", [2, 4, 6], seed=3)
    best = lloyd.restarted(rows, "z", [2, 4, 6], n_init=10, seed=3)
    for k, inertia, ch, db in table:
        labelled = best[k][0].labelled(rows, "z", "c").select("c", *[F.col("z")[i].alias(f"z{i}") for i in range(3)])
        assert np.allclose((ch, db), validity.cluster_indices(labelled, "c", ["z0", "z1", "z2"]), rtol=1e-6)
        assert math.isclose(inertia, best[k][0].cost)
    assert max(table, key=lambda r: r[2])[0] == 4 and min(table, key=lambda r: r[3])[0] == 4  # the true number
    same = frame(spark, np.ones((5, 2)))
    assert all(math.isnan(r[2]) for r in validity.index_table(same, "z", [2]))
    assert validity.index_table(rows.limit(0), "z", [2, 3]) == []


@pytest.mark.parametrize("shares", [None, 0.4])
def test_silhouettes_equal_the_evaluator(spark, shares):
    x = blobs(400, 4, 5, 6, apart=1.5)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = frame(spark, x)
    models = {k: m[0] for k, m in lloyd.restarted(rows, "z", [2, 3, 5], n_init=2).items()}
    share = None if shares is None else {k: np.full(k, shares) for k in models}
    found = lloyd.cosine_silhouettes(rows, "z", models, share=share, row=F.col("person_id"), seed=9)
    for k, m in models.items():
        own = m.labelled(rows, "z", "c").withColumn("f", array_to_vector("z"))
        if shares is not None:
            own = own.where(F.pmod(F.xxhash64("person_id", F.lit(9)), F.lit(1 << 40)) / F.lit(float(1 << 40)) < shares)
        want = ClusteringEvaluator(featuresCol="f", predictionCol="c", metricName="silhouette", distanceMeasure="cosine").evaluate(own)
        assert math.isclose(found[k], want, rel_tol=1e-6)
    one = lloyd.cosine_silhouettes(rows, "z", {1: lloyd.Model(x[:1])})
    assert math.isnan(one[1])


def test_one_tree_gives_every_level(spark):
    x = blobs(900, 8, 4, 7, apart=5.0)
    rows = frame(spark, x)
    tree = lloyd.divisive(rows, "z", 8, seed=1)
    assert [k for k, _ in tree.curve] == list(range(1, 9))
    costs = [c for _, c in tree.curve]
    assert all(a > b for a, b in zip(costs, costs[1:]))
    vectors = rows.withColumn("f", array_to_vector("z"))
    for k, cost in tree.curve:
        at = tree.route(x, k)
        assert len(set(at)) == k
        assert math.isclose(cost, sum(((x[at == i] - x[at == i].mean(axis=0)) ** 2).sum() for i in set(at)), rel_tol=1e-6)
        if k > 1:
            separate = BisectingKMeans(k=k, seed=1, maxIter=20, featuresCol="f").fit(vectors).summary.trainingCost
            assert cost <= 1.2 * separate, (k, cost, separate)


def test_trees_of_few_or_equal_rows(spark):
    same = np.ones((50, 3))
    assert [k for k, _ in lloyd.divisive(frame(spark, same), "z", 4).curve] == [1]
    two = np.vstack([np.ones((30, 3)), np.zeros((20, 3))])
    assert [k for k, _ in lloyd.divisive(frame(spark, two), "z", 5).curve] == [1, 2]
    assert lloyd.divisive(frame(spark, two).limit(0), "z", 5).curve == []


def test_a_leaf_that_the_sample_misses(spark, monkeypatch):
    monkeypatch.setattr(lloyd.sampled, "__defaults__", (3,))
    x = blobs(300, 6, 3, 8)
    assert len(lloyd.divisive(frame(spark, x), "z", 6).curve) == 6


def trustworthiness(x, y, k=12):
    """1 where no row has new neighbours in the layout, by how far away they are in ``x``."""
    n = len(x)
    far = lambda v: ((v[:, None] - v[None]) ** 2).sum(axis=2) + np.diag(np.full(n, np.inf))
    rank = far(x).argsort(axis=1).argsort(axis=1) + 1
    near = far(y).argsort(axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, axis=1) - k, 0).sum()


@pytest.mark.parametrize("shape", ["roll", "blobs"])
def test_layout_keeps_neighbours_better_than_principal_components(spark, shape):
    rng = np.random.default_rng(2)
    if shape == "roll":  # a strip rolled up in space
        t = rng.uniform(1.5 * np.pi, 4.5 * np.pi, size=900)
        x = np.c_[t * np.cos(t), t * np.sin(t), rng.uniform(0, 4, size=900), rng.normal(size=(900, 3)) * 0.05]
    else:
        x = blobs(900, 7, 9, 4, apart=2.5)
    df = frame(spark, x)
    got = layout.neighbour_layout(df, "z", keep=["person_id"]).orderBy("person_id").collect()
    y = np.array([[r.at_1, r.at_2] for r in got])
    centred = x - x.mean(axis=0)
    pca = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert trustworthiness(x, y) > trustworthiness(x, pca), (trustworthiness(x, y), trustworthiness(x, pca))
    again = np.array([[r.at_1, r.at_2] for r in layout.neighbour_layout(df.repartition(3), "z", keep=["person_id"]).orderBy("person_id").collect()])
    assert np.allclose(y, again, atol=1e-6)


def test_layout_of_few_rows(spark):
    assert layout.neighbour_layout(frame(spark, np.ones((4, 2))), "z", keep=["person_id"]).select("at_1", "at_2").distinct().collect() == [(0.0, 0.0)]
    assert layout.neighbour_layout(frame(spark, np.eye(3)), "z").count() == 3
    assert layout.neighbour_layout(frame(spark, np.eye(3)).limit(0), "z").count() == 0


def test_power_iteration_equals_eigenvectors():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(60, 30))
    m = a @ a.T
    values, vectors = layout.leading(m, 3)
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:3]) and np.allclose(m @ vectors, vectors * values, atol=1e-3)
