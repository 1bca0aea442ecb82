"""Periodic runs against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosepath.llm import periodic, queries


def by_hand(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            smaller = any(all(w[k] == w[k + d] for k in range(s, s + length - d)) for d in range(1, q))
            if length >= max(least, exponent * q) and not smaller:
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def noise(n, seed):
    r, out = random.Random(seed), []
    for _ in range(n):
        k = r.choice([1, 2, 3, 30])
        w = [r.choice("abcdefghijklmnopqrstuvwxyzàéîõü0123")[:k] + str(r.randrange(k)) for _ in range(r.randint(0, 60))]
        if w and r.random() < 0.6:
            a = r.randrange(len(w))
            p = 1 + r.randrange(max(1, (len(w) - a) // 3))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        out.append(r.choice([" ", "\n", "\t \x0b"]).join(w))
    return out


EDGES = [None, "", " \n\t", "a a a a a", "a a a a a a", "a b " * 3, "a b " * 4, "x " + "a b " * 4 + "a y", "a b a b a b a b a b a b", "a\x1ca " * 6, "a a b " * 40, ("a " * 6 + "b ") * 4, "Ünï 😀 " * 9]


@pytest.mark.parametrize("least, exponent", [(6, 4), (1, 3), (12, 5)])
def test_runs_equal_brute_force(spark, least, exponent):
    texts = EDGES + noise(250, 7)
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(3, texts[10]), (3, texts[10])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "collapsed", "start")}).repartition(5)
    got = periodic.periodic_runs(df, least=least, exponent=exponent)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = by_hand(w, least, exponent)
        want.append((str(i), runs, collapsed(w, runs)))
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()) == sorted(want)


def test_empty_table_and_too_few_periods(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), exponent=2)


@pytest.mark.parametrize("stream", [1, 50, 1000])
def test_runs_do_not_depend_on_the_stream(spark, monkeypatch, stream):
    texts = noise(60, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {r.doc_id: (r.runs, r.collapsed) for r in periodic.periodic_runs(df).collect()}
    monkeypatch.setattr(periodic, "STREAM", stream)
    assert {r.doc_id: (r.runs, r.collapsed) for r in periodic.periodic_runs(df).collect()} == want


def test_long_texts_of_few_words():
    n = 60_000
    one = np.zeros(n, np.int64)
    assert periodic.runs_of(np.r_[one, -1], np.array([n])) == [(0, n, 1)]
    blocks = np.tile(np.r_[np.zeros(99, np.int64), 1], n // 100)
    found = periodic.runs_of(np.r_[blocks, -1], np.array([n]))
    assert (0, n, 100) in found and sum(r[2] == 1 for r in found) == n // 100 and len(found) == n // 100 + 1
    long = np.arange(n) % (n // 4)
    assert periodic.runs_of(np.r_[long, -1], np.array([n])) == [(0, n, n // 4)]


def test_query_gives_tails_and_digests(spark, tmp_path):
    texts = EDGES + noise(120, 5) + ["w%d " % i * 3 + " ".join(f"x{k}" for k in range(90)) for i in range(60)]
    rows = [(i if i != 2 else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    tails = 0
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w, tails = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))], tails + 1
        runs = by_hand(w)
        r = got[i]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, (r.start, r.length, r.period)) == (len(runs), best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert tails > 5
