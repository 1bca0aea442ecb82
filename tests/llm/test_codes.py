"""Vector codes against Lloyd's rounds with every distance made."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosepath.llm import queries, vector_codes

BAD = [(900, None, 1), (901, [1.0, None, 1.0, 1.0], 1), (902, [float("nan")] * 8, None), (903, [float("inf")] * 8, 2)]


def lloyd(rows, parts=4, entries=256, rounds=4):
    """{length: (codes and errors in the order of (id, vector), codebooks)} in plain integers."""
    out = {}
    for d in {len(v) for _, v, _ in rows}:
        own = sorted(((i is None, i or 0, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if len(v) == d))
        width = -(-d // parts)
        x = [[(v + [0] * 8)[p * width : (p + 1) * width] if d else [] for p in range(parts)] for _, _, v in own]
        x = [[q[: max(0, d - p * width)] + [0] * (width - len(q[: max(0, d - p * width)])) for p, q in enumerate(row)] for row in x]
        book = [[row[p] for row in x[:entries]] for p in range(parts)]
        far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
        near = lambda row: [min(range(len(book[p])), key=lambda e: (far(row[p], book[p][e]), e)) for p in range(parts)]
        for _ in range(rounds):
            codes = [near(r) for r in x]
            for p in range(parts):
                for e in range(len(book[p])):
                    held = [r[p] for r, c in zip(x, codes, strict=True) if c[p] == e]
                    if held:
                        book[p][e] = [sum(c) // len(held) for c in zip(*held, strict=True)]
        codes = [near(r) for r in x]
        errors = [sum(far(r[p], book[p][c[p]]) for p in range(parts)) for r, c in zip(x, codes, strict=True)]
        out[d] = [(None if no else i, "".join(f"{c:02x}" for c in code), e) for (no, i, _), code, e in zip(own, codes, errors, strict=True)], book
    return out


def rows_of(n, d, seed, grid):
    rng = np.random.default_rng(seed)
    v = rng.integers(-2, 3, size=(n, d)) / 1024 if grid else rng.normal(size=(n, d)).round(3)
    v[n // 4 : n // 2] = v[0]  # a hot vector: ties and equal entries
    return [(i if i % 17 else None, [float(np.float32(x)) for x in r], i % 3 if i % 5 else None) for i, r in enumerate(v)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumns({c: F.lit("clash") for c in ("codes", "upper", "lower", "unit", "_label", "n", "d")}).repartition(5)


@pytest.mark.parametrize("entries, rounds, grid", [(256, 4, True), (16, 4, True), (16, 4, False), (3, 7, False), (16, 0, False)])
def test_codes_equal_plain_lloyd(spark, monkeypatch, entries, rounds, grid):
    monkeypatch.setattr(vector_codes, "ROWS", 37)
    rows = rows_of(220, 8, 1, grid) + rows_of(40, 6, 2, grid) + [(5, [], 1)] + rows_of(3, 8, 4, grid)
    found = vector_codes.compressed(frame(spark, rows + BAD), entries=entries, rounds=rounds)
    want = lloyd(rows, entries=entries, rounds=rounds)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for d, (codes, book) in want.items():
        got = [(r.vec_id, r.code, r.error) for r in found.rows.where(F.col("n_components") == d).collect()]
        assert sorted(got, key=key) == sorted(codes, key=key)
        assert found.books[d].tolist() == book
    first = found.rows.where("n_components = 6").first()
    assert len(found.decoded(first.code, 6)) == 6


def test_query_and_its_digest(spark, tmp_path):
    rows = rows_of(120, 8, 3, False)
    frame(spark, rows + BAD).write.parquet(f"{tmp_path}/embeddings.parquet")
    codes, book = lloyd(rows)[8]
    label = {r[0]: r[2] for r in rows if r[0] is not None}
    digest = hashlib.sha256(",".join(str(c) for p in book for e in p for c in e).encode()).hexdigest()
    got = queries.op12_vector_codes(spark, str(tmp_path)).collect()
    assert {r.codebooks_sha256 for r in got} == {digest} and len(got) == len(rows)
    error = {i: e for i, _, e in codes}
    for r in got:
        if r.vec_id is not None:
            assert r.error == error[r.vec_id]
    nulls = {r.label_error for r in got if r.vec_id is not None and label[r.vec_id] is None}
    assert len(nulls) == 1
    assert sum({(r.label_error) for r in got}) == sum(e for _, _, e in codes)


def test_empty_single_and_far_values(spark):
    assert vector_codes.compressed(frame(spark, [])).rows.count() == 0
    assert vector_codes.compressed(frame(spark, BAD)).rows.count() == 0
    one = vector_codes.compressed(frame(spark, [(7, [1.0, 2.0, 3.0, 4.0], None)])).rows.collect()
    assert [(r.vec_id, r.code, r.error) for r in one] == [(7, "00000000", 0)]
    far = vector_codes.compressed(frame(spark, [(1, [3e38, -3e38, 0.0, 1.0], 1), (2, [1.0] * 4, 1)])).rows.collect()
    assert sorted((r.vec_id, r.error) for r in far) == [(1, 0), (2, 0)]


def test_bounds_prune_and_stay_true():
    """Few distances are made once entries settle, and every bound holds."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-900, 900, size=(64, 16))
    x = (centres[rng.integers(0, 64, size=3000)] + rng.integers(-40, 41, size=(3000, 16))).astype(np.int64)
    book = vector_codes.Book.of(x[:256].copy())
    own, upper, lower = vector_codes.first_assigned(x, book)
    made = []
    for _ in range(5):
        sums = np.zeros((256, 16), np.int64)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=256)
        entries = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], book.entries)
        book = vector_codes.Book.of(entries, book.entries)
        counted = []
        pairs = vector_codes._pairs
        vector_codes._pairs = lambda x, e, r, c: (counted.append(len(r)), pairs(x, e, r, c))[1]
        try:
            unit, packed = vector_codes._packed(lower)
            own, upper, lower = vector_codes.assigned(x, book, own, upper, packed * unit[:, None].astype(float))
        finally:
            vector_codes._pairs = pairs
        made.append(sum(counted))
        d = vector_codes.squares(x, entries)
        assert (own == d.argmin(axis=1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(x)), own])).all() and (lower <= np.sqrt(d)).all()
    assert made[0] < 0.25 * x.shape[0] * 256 and made[-1] < 0.05 * x.shape[0] * 256, made
