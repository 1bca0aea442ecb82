"""Decontamination against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from dosepath.llm import decontamination, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def by_hand(text, items, n):
    """Words hit and items of one text."""
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        own = words(t)
        size = min(n, len(own))
        wins = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in wins:
                hit |= set(range(k, k + size))
                ids |= {str(i)} if i is not None else set()
    return len(w), hit, sorted(ids)


def corpus(seed, n=10):
    r = random.Random(seed)
    vocab = ["a", "b", "C", "Été", "naïve", "x1", "9", "漢字", "İ", "ſ", "Word"]
    text = lambda k: "".join(r.choice(vocab) + r.choice([" ", ", ", "\n", "-", "_", "\x00", "...", "  "]) for _ in range(k))
    items = [(i, text(r.choice([1, 3, n - 1, n, n + 1, 40]) if r.random() < 0.3 else 3 * n)) for i in range(14)] + [(3, "repeated item of its own id"), (3, "repeated item of its own id"), (None, text(n + 2)), (90, None), (91, " ... "), (100, "Zeta")]
    docs = [None, "", "...", "zeta", "Zeta zetaz", items[0][1]]
    for _ in range(120):
        t = text(r.randint(0, 60))
        if r.random() < 0.5:
            own = words(r.choice(items)[1])
            k = r.randint(0, max(0, len(own) - 1))
            t += r.choice(["; ", " x "]) + " ".join(own[k : k + r.randint(n - 2, n + 9)]).title() + ". " + text(3)
        docs.append(t)
    return docs, items


def frames(spark, docs, items):
    rows = [(i if i % 11 else None, t) for i, t in enumerate(docs)] + [(2, t) for t in docs[4:8]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = {c: F.lit("clash") for c in ("key", "w", "at", "n_hit", "hit_spans", "__text", "item", "items", "length", "spans")}
    return df.withColumns(clash).repartition(4), spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("w", "key", "words")}), rows


@pytest.mark.parametrize("block_bytes, n", [(32 << 20, 10), (900, 10), (32 << 20, 3)])
def test_hits_equal_brute_force(spark, monkeypatch, block_bytes, n):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    docs, items = corpus(block_bytes % 97 + n, n)
    df, bench, rows = frames(spark, docs, items)
    out = decontamination.marked(df, bench, n=n).collect()
    got = sorted((str(r.doc_id), r.text or "", r.n_words, sorted(k for s in r.hit_spans for k in range(s.start, s.end)), r.n_hit, r.hit_items) for r in out)
    want = sorted((str(i), t or "", c, sorted(hit), len(hit), ids) for i, t in rows for c, hit, ids in [by_hand(t, items, n)])
    assert got == want and any(w[4] for w in want) and any(w[2] and not w[4] for w in want)
    assert all(a.end < b.start for r in out for a, b in zip(r.hit_spans, r.hit_spans[1:]))


def test_spans_or_whole_texts_go(spark):
    docs, items = corpus(4)
    df, bench, rows = frames(spark, docs, items)
    clean = decontamination.cleaned(df, bench)
    assert clean.columns == df.columns and clean.count() == len(rows)
    left = sorted(r.text or "" for r in clean.collect())
    assert {r.n_hit for r in clean.collect()} == {"clash"}
    want = []
    for _, t in rows:
        _, hit, _ = by_hand(t, items, 10)
        gaps, own = re.split(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or ""), re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")
        want.append("".join(g + w for k, (g, w) in enumerate(zip(gaps, own)) if k not in hit) + gaps[-1])
    assert left == sorted(want)
    kept = decontamination.cleaned(df, bench, whole=True)
    assert sorted(r.text or "" for r in kept.collect()) == sorted(t or "" for _, t in rows if not by_hand(t, items, 10)[1])


def test_empty_tables(spark):
    docs, items = corpus(6)
    df, bench, rows = frames(spark, docs, items)
    for none in (bench.limit(0), bench.where("text is null")):
        assert {r.n_hit for r in decontamination.marked(df, none).collect()} == {0}
        assert sorted(r.text or "" for r in decontamination.cleaned(df, none).collect()) == sorted(t or "" for _, t in rows)
    assert decontamination.marked(df.limit(0), bench).count() == 0


def test_long_text_of_hits_and_a_very_common_passage(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    docs = [f"{passage} x " * 3000, *[f"{passage} {i}" for i in range(400)], *["clean text of nothing"] * 50]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(8)
    out = {r.doc_id: r for r in decontamination.marked(df, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert (out[0].n_words, out[0].n_hit) == (39_000, 36_000) and len(out[0].hit_spans) == 3000
    assert all(out[i].n_hit == 12 for i in range(1, 401)) and all(out[i].n_hit == 0 for i in range(401, 451))


def test_query(spark, tmp_path):
    docs, items = corpus(8)
    df, bench, rows = frames(spark, docs, items)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op13_decontamination(spark, str(tmp_path))
    assert not any("Python" in x or "Arrow" in x for x in got._jdf.queryExecution().executedPlan().toString().split())
    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    want = sorted((str(i), c, len(hit), len(ids), sha(ids), bool(hit)) for i, t in rows for c, hit, ids in [by_hand(t, items, 10)])
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want
