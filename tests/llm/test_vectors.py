import numpy as np
import pytest
from pyspark.sql import functions as F

from dosepath.llm import neighbours, topk

BAD = [(900, None), (1000, [1.0, None, 1.0, 1.0]), (1100, [float("nan"), 1.0, 1.0, 1.0]), (1200, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (1300, [1.0, 2.0])]


def vectors(n=150, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 4)).round(3)
    v[10:60] = v[100]  # a hot vector: ties
    return [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1)).repartition(5)


def by_hand(rows, every, k, score):
    """A query's candidates are all rows of its length but its own."""
    out = []
    for i, (q, a) in enumerate(rows):
        if q is None or q % every:
            continue
        found = sorted(((-score(a, b), c) for j, (c, b) in enumerate(rows) if i != j and len(a) == len(b)))[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(found)]
    return sorted(out)


def ints(a, b):
    return int(sum(np.floor(1024 * np.float64(x)) * np.floor(1024 * np.float64(y)) for x, y in zip(a, b, strict=True)))


def real(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


@pytest.mark.parametrize("k", [1, 7, 200])
def test_top_k_equals_brute_force(spark, k):
    rows = vectors()
    got = topk.exact_top_k(frame(spark, rows + BAD), F.col("vec_id") % 50 == 0, k=k)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 50, k, ints)


@pytest.mark.parametrize("k", [1, 7, 200])
def test_nearest_equals_brute_force(spark, k):
    rows = vectors(seed=2)
    got = neighbours.nearest(frame(spark, [*rows, *BAD, (1400, [0.0] * 4)]), F.col("vec_id") % 50 == 0, k=k)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 50, k, real)


def test_many_query_blocks(spark, monkeypatch):
    from dosepath.llm import vectors as v

    monkeypatch.setattr(v, "QUERY_BLOCK", 8)
    rows = vectors()
    got = topk.exact_top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, k=3)
    assert sorted(map(tuple, got.collect())) == by_hand(rows, 5, 3, ints)


@pytest.mark.parametrize("search", [topk.exact_top_k, neighbours.nearest])
def test_empty_and_lonely(spark, search):
    assert search(frame(spark, []), F.col("vec_id") % 2 == 0).count() == 0
    assert search(frame(spark, [(0, [1.0, 2.0, 3.0, 4.0])]), F.col("vec_id") % 2 == 0).count() == 0
    twice = search(frame(spark, [(0, [1.0] * 4), (0, [1.0] * 4), (1, [1.0] * 4), (1, [1.0] * 4)]), F.col("vec_id") % 2 == 0)
    # two queries of one id: the other row of the id is a candidate of each
    assert sorted((r.query_id, r.rank, r.vec_id) for r in twice.collect()) == [(0, 1, 0), (0, 1, 0), (0, 2, 1), (0, 2, 1), (0, 3, 1), (0, 3, 1)]


def test_top_k_of_huge_components(spark):
    """Products beyond long are held at its bounds; others stay exact, also above 2^60."""
    rows = vectors(seed=4)[:60]
    rows += [(60, [3e15, 0.0, 0.0, 1.0]), (61, [-3e38, 3e38, 1.0, 0.0]), (65, [1e6, 2e6, -1e6, 5e5]), (66, [1e6, 2e6, -1e6, 5e5]), (70, [2e6, 1.0, 0.0, 3.0]), (71, [1.1e6, 1e6, 0.0, 3.0])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]

    def held(a, b):
        total = sum(int(np.floor(1024 * x)) * int(np.floor(1024 * y)) for x, y in zip(a, b, strict=True))
        return max(-(2**63) + 1, min(2**63 - 1, total))

    for k in (1, 6, 100):
        got = topk.exact_top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, k=k)
        assert sorted(map(tuple, got.collect())) == by_hand(rows, 5, k, held)
    most = float(np.finfo(np.float64).max)
    wide = spark.createDataFrame([(0, [most, 1.0]), (1, [most, 0.0]), (2, [-most, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(wide, F.col("vec_id") == 0, k=3)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2 * 1024**2), (0, 3, 2, -(2**63) + 1)]


@pytest.mark.parametrize("search, score", [(topk.exact_top_k, ints), (neighbours.nearest, real)])
def test_repeated_ids_and_other_lengths(spark, search, score):
    rng = np.random.default_rng(5)
    rows = [(i % 40, [float(np.float32(x)) for x in rng.normal(size=4 if i % 3 else 6).round(2)]) for i in range(160)]
    rows += [rows[0], rows[0], rows[20]]  # a query's row again
    for k in (1, 5, 300):
        assert sorted(map(tuple, search(frame(spark, rows), F.col("vec_id") % 20 == 0, k=k).collect())) == by_hand(rows, 20, k, score)


@pytest.mark.parametrize("d", [16, 1040, 3000])
@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
@pytest.mark.parametrize("grid", [False, True])
def test_quantisation_bounds_hold(d, scale, grid):
    rng = np.random.default_rng(3)
    draw = (lambda *n: rng.integers(-127, 128, size=n).astype(float)) if grid else (lambda *n: rng.normal(size=n))
    a, b = draw(40, d) * scale, draw(50, d) * scale * 100
    norm = lambda v: np.linalg.norm(v, axis=1)
    about, slack = neighbours.bounded(neighbours.quantise(a), norm(a), neighbours.quantise(b), norm(b))
    score = np.stack([neighbours.products(np.repeat(x[None], len(b), axis=0), b) for x in a])
    assert (np.abs(about - score) <= slack).all()
