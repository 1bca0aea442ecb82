import math

import pytest

from pyspark.sql import functions as F

from dosepath.functions.columns import jaccard_distance
from dosepath.operators import cluster, validity


def test_jaccard_distance(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], []), ([1], None), ([1, 1], [1])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(jaccard_distance("a", "b")).collect()] == [pytest.approx(2 / 3), 0.0, 1.0, 0.0]


def test_adjusted_rand_index(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b")], "x int, y string")
    assert validity.adjusted_rand_index(df, "x", "y").collect()[0].ari == 1.0
    mixed = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b")], "x int, y string")
    assert validity.adjusted_rand_index(mixed, "x", "y").collect()[0].ari == pytest.approx(-0.5)


def test_cluster_indices_equal_definitions(spark):
    pts = [(0, 0.0, 0.0), (0, 0.0, 2.0), (1, 10.0, 0.0), (1, 10.0, 2.0), (2, 0.0, 20.0), (2, 2.0, 20.0)]
    ch, db = validity.cluster_indices(spark.createDataFrame(pts, "g int, x double, y double"), "g", ["x", "y"])
    cs = {0: (0, 1), 1: (10, 1), 2: (1, 20)}
    mean = (sum(p[1] for p in pts) / 6, sum(p[2] for p in pts) / 6)
    between = sum(2 * math.dist(c, mean) ** 2 for c in cs.values())
    assert ch == pytest.approx((between / 2) / (6 / 3))
    assert db == pytest.approx(sum(max(2 / math.dist(cs[a], cs[b]) for b in cs if b != a) for a in cs) / 3)


def test_anova_of_separate_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 6.0)], "g string, x double")
    (r,) = validity.anova(df, "g", ["x"]).collect()
    assert r.eta_squared == pytest.approx(16 / 17) and r.f_value == pytest.approx(32)


def test_scaled_centroids_and_sales(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0)], "g string, x double")
    assert {r.g: r.scaled for r in validity.scaled_centroids(df, "g", ["x"]).collect()} == {"a": 0.0, "b": 1.0, "c": 0.5}
    users = spark.createDataFrame([("N06", 2020, "f", 10.0), ("N06", 2021, "f", 10.0)], "atc_group string, year int, sex string, value double")
    doses = users.selectExpr("atc_group", "year", "sex", "value * (year - 2019) as value")
    assert {r.year: r.index_to_base for r in validity.sales_measures(users, doses, 2020).collect()} == {2020: 100.0, 2021: 200.0}


def test_elbow(spark):
    curve = spark.createDataFrame([(2, 10.0), (3, 4.0), (4, 3.0), (5, 2.5)], "k int, value double")
    assert cluster.kneedle(curve).collect()[0].k == 3
    assert [r.second_difference for r in cluster.second_differences(curve).orderBy("k").collect()] == [5.0, 0.5]


def test_sampled_silhouette_is_near_the_full_one(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(i % 3, Vectors.dense([math.cos(i % 3 * 2 + i % 7 / 50), math.sin(i % 3 * 2 + i % 7 / 50)])) for i in range(3000)]
    df = spark.createDataFrame(rows, ["trajectory_cluster", "features_cosine"])
    full = cluster.silhouette(df, 1)
    assert abs(full - cluster.silhouette(df, 1, sample_from=1000)) < 0.02 and full > 0.9
    assert math.isnan(cluster.silhouette(df.where("trajectory_cluster = 0"), 1))


def test_tail_of_the_f_distribution():
    # closed forms: two degrees between, and one within
    for f in (0.01, 0.5, 1.0, 3.7, 40.0):
        for n in (1, 2, 7, 300):
            assert validity.f_tail(f, 2, n) == pytest.approx((1 + 2 * f / n) ** (-n / 2), rel=1e-9)
        assert validity.f_tail(f, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(math.sqrt(f)), rel=1e-9)
    assert validity.f_tail(0.0, 3, 9) == 1.0 and validity.f_tail(math.inf, 3, 9) == 0.0
    assert validity.f_tail(3.1, 4, 60) == pytest.approx(1 - validity.f_tail(1 / 3.1, 60, 4), rel=1e-9)


def test_anova_leaves_out_nulls_of_a_feature(spark):
    rows = [("a", 1.0, None), ("a", 2.0, 5.0), ("b", 4.0, 1.0), ("b", 5.0, 2.0), ("c", None, 9.0)]
    got = {r.feature: r for r in validity.anova_p_values(validity.anova(spark.createDataFrame(rows, "g string, x double, y double"), "g", ["x", "y"])).collect()}
    assert (got["x"].df_between, got["x"].df_within) == (1, 2) and got["x"].f_value == pytest.approx(18.0)
    assert (got["y"].df_between, got["y"].df_within) == (2, 1)
    assert got["x"].p_value == pytest.approx(validity.f_tail(18.0, 1, 2))


def test_sales_changes_pair_first_and_last_year(spark):
    rows = [("A", 2000, "Male", 10.0), ("A", 2000, "Female", 30.0), ("A", 2010, "male", 20.0), ("A", 2010, "Kvinder", 30.0), ("B", 2000, "men", 0.0), ("B", 2010, "Men", 5.0), ("C", 2005, "Women", 4.0)]
    doses = spark.createDataFrame([*rows, ("A", 1990, "Male", 99.0)], "atc_group string, year int, sex string, value double")  # no users in 1990
    users = spark.createDataFrame(rows, "atc_group string, year int, sex string, value double")
    got = {r.atc_group: r for r in validity.sales_changes(users, doses).collect()}
    assert {(r.base_year, r.recent_year) for r in got.values()} == {(2000, 2010)}
    assert (got["A"].base_volume, got["A"].recent_volume, got["A"].change_all, got["A"].change_men, got["A"].change_women) == (20.0, 25.0, 25.0, 100.0, 0.0)
    assert (got["B"].base_volume, got["B"].recent_volume, got["B"].change_all, got["B"].change_men, got["B"].change_women) == (0.0, 5.0, None, None, None)
    assert (got["C"].base_volume, got["C"].recent_volume, got["C"].change_all) == (None, None, None)
    volumes = validity.sales_volumes(users, doses, 2000)
    assert {(r.atc_group, r.year): r.index_to_base for r in volumes.collect()} == {("A", 2000): 100.0, ("A", 2010): 125.0, ("B", 2000): None, ("B", 2010): None, ("C", 2005): None}
    shares = {r.year: tuple(r)[1:] for r in validity.share_pivot(volumes, ["A", "B", "X"]).collect()}
    assert shares == {2000: (1.0, 0.0, 0.0), 2010: (25 / 30, 5 / 30, 0.0)}


@pytest.mark.parametrize("error", [0.005, 0.05])
def test_sketched_quantiles_keep_their_rank(spark, error):
    """Distinct values by the hundred thousand: ranks stay within the error."""
    df = spark.range(300_000).select(F.when(F.col("id") % 7 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double")).alias("t")).repartition(12)
    for r in validity.sketched_quantiles(df, "t", [0.0, 0.1, 0.5, 0.99, 1.0], error).collect():
        assert r.rank_low - error <= r.p <= r.rank_high + error
    ties = spark.range(1000).select(F.lit(2.0).alias("t"))
    assert {(r.value, r.rank_low, r.rank_high) for r in validity.sketched_quantiles(ties, "t", [0.1, 0.9]).collect()} == {(2.0, 0.0, 1.0)}
    assert [r.value for r in validity.sketched_quantiles(ties.limit(0), "t", [0.5]).collect()] == [None]


def test_elbow_of_a_literal_curve(spark):
    curve = spark.createDataFrame([(2, 100.0), (3, 60.0), (4, 38.0), (5, 30.0), (6, 26.0), (7, 24.0)], "k int, value double")
    assert [(r.k, round(r.bend, 6)) for r in cluster.kneedle(curve).collect()] == [(4, 0.415789)]
    assert {r.k: r.second_difference for r in cluster.second_differences(curve).collect()} == {3: 18.0, 4: 14.0, 5: 4.0, 6: 2.0}


@pytest.mark.parametrize("f, a, b", [(0.5, 3, 40), (4.0, 3, 40), (1.0, 1, 5), (30.0, 6, 738), (2.2, 7, 7)])
def test_f_tail_equals_numeric_integration(f, a, b):
    """The density of Fisher's distribution, summed by Simpson's rule on t = 1 / (1 + x)."""
    log_c = math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2) + a / 2 * math.log(a / b)
    density = lambda x: math.exp(log_c + (a / 2 - 1) * math.log(x) - (a + b) / 2 * math.log1p(a * x / b))
    top, n = 1 / (1 + f), 200_000
    h = top / n
    value = lambda t: 0.0 if t <= 0 else density(1 / t - 1) / t**2
    total = sum((4 if i % 2 else 2) * value(i * h) for i in range(1, n)) + value(0) + value(top)
    assert math.isclose(validity.f_tail(f, a, b), total * h / 3, rel_tol=1e-4, abs_tol=1e-12)


def test_silhouette_of_many_rows_is_of_all_of_them(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    angle = np.array([i % 3 * 2 + i % 997 / 600 for i in range(20_000)])
    x, g = np.c_[np.cos(angle), np.sin(angle)], np.arange(20_000) % 3
    df = spark.createDataFrame([(int(k), Vectors.dense(v)) for k, v in zip(g, x, strict=True)], ["trajectory_cluster", "features_cosine"])
    n = np.bincount(g)
    away = 1 - (x @ np.array([x[g == k].sum(axis=0) for k in range(3)]).T) / n
    rows = np.arange(len(x))
    a, b = away[rows, g] * n[g] / (n[g] - 1), np.where(np.arange(3) == g[:, None], np.inf, away).min(axis=1)
    assert abs(cluster.silhouette(df, 1) - ((b - a) / np.maximum(a, b)).mean()) < 1e-9
