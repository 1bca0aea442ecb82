"""Sharding, mixing, packing, the quality classifier and the n-gram join against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dosepath.llm import components, mixing, ngram_join, packing, quality, sharding

DOC = "doc_id long, text string, source string"
ODD = [(None, "a null id", "x"), (7001, None, "x"), (7002, "", None), (7003, "  \t\n", "y"), (7004, "dup row here now", "x"), (7004, "dup row here now", "x"), (7005, "word " * 30_000, "z")]


def documents(n=120, seed=5):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(300)]
    out = []
    for i in range(n):
        if i % 4 == 3:  # a near copy of an earlier text
            text = out[r.randrange(len(out))][1].split()
            for _ in range(r.randint(0, 2)):
                text[r.randrange(len(text))] = r.choice(words)
        else:
            text = [r.choice(words) for _ in range(r.randint(1, 60))]
        out.append((i, " ".join(text), f"s{i % 5 if i % 3 else 0}"))
    return out


def frame(spark, rows):
    extra = {c: F.lit("clash") for c in ("size", "set", "n", "row_number", "shard", "key", "block", "_y", "quality_score", "copies", "root")}
    return spark.createDataFrame(rows, DOC).withColumns(extra).repartition(4)


def test_feistel_is_a_bijection_with_an_inverse():
    for n in (1, 2, 3, 16, 1000, 4097):
        p = sharding.permute(np.arange(n), n, 3)
        assert sorted(p.tolist()) == list(range(n))
        assert (sharding.permute(p, n, 3, back=True) == np.arange(n)).all()
    shard, slot = sharding.shard_slot(np.arange(1000), 1000, 16, 9)
    assert (sharding.row_at(shard, slot, 1000, 16, 9) == np.arange(1000)).all()


def test_sharding(spark):
    rows = documents() + ODD
    got = sharding.shard_rows(frame(spark, rows), shards=16).collect()
    again = sharding.shard_rows(frame(spark, rows).repartition(9), shards=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard_rows(frame(spark, [])).count() == 0


def test_flight_keeps_both_totals():
    r = random.Random(1)
    size = [float(r.randint(0, 900)) for _ in range(500)]
    part = mixing.flight(size, [0.37] * 500, "k")
    assert sum(0 < p < 1 for p in part) <= 2
    assert sum(part) == pytest.approx(500 * 0.37) and sum(s * p for s, p in zip(size, part, strict=True)) == pytest.approx(sum(size) * 0.37)
    assert set(mixing.landing(size, part)) <= {0.0, 1.0}


def test_inclusion_probabilities_are_respected():
    size = [float(1 + i % 7) for i in range(30)]
    taken = np.mean([mixing.landing(size, mixing.flight(size, [0.4] * 30, k)) for k in range(800)], axis=0)
    assert np.abs(taken - 0.4).max() < 0.09


def test_targets_stop_at_twice_the_size_and_share_the_excess():
    got = mixing.targets([100, 10, 50], [5, 2, 1], 240, 2.0)
    assert got == pytest.approx([550 / 3, 20, 110 / 3])
    assert mixing.targets([0, 10], [5, 2], 15, 2.0) == [0, 15]


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 32)  # several levels
    rows = documents() + ODD
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, rows).repartition(7)).collect()))
    count = lambda t: len((t or "").split())
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, count(t)) for d, t, _ in rows)
    names = sorted({s for _, _, s in rows if s}) + [None]
    sizes = [sum(count(t) for _, t, s in rows if s == n) for n in names]
    goal = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2.0)
    for n, size, g in zip(names, sizes, goal, strict=True):
        own = [r for r in got if r.source == n]
        assert {r.source_size for r in own} == {size} and all(r.target == pytest.approx(g) for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
        assert abs(sum(r.taken for r in own) - g) <= 2 * max(r.size for r in own)
    assert mixing.mix(frame(spark, [])).count() == 0


TEXTS = ["", " ", "Hello, world's  end\n\n\tok", "naïve café 東京 😀😀", "<|endoftext|> 1234567 3.14", "a" * 3000, "word " * 9000, None]


def test_packing_is_whole_and_equals_the_tokenizer(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(100 + d, t, s) for d, t, s in documents(80)] + [(None, "no id", "s"), (5, "same id", "s")]
    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = packing.pack(frame(spark, rows), *files, max_segments=8).collect()
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    want = Counter()
    for d, t, _ in rows:
        want[(d, zlib.crc32(np.array([*reference.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()))] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048 and len(s) <= 8
    ids = {(d, t): [*reference.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in rows}
    for (d, t), x in ids.items():
        own = sorted((p.start, p.length, p.ids_crc32) for p in pieces[(d, len(x))])
        assert sum(n for _, n, _ in own) % len(x) == 0
        for start, n, crc in own:
            assert crc in {zlib.crc32(np.array(y[start : start + n], "<u4").tobytes()) for (e, _), y in ids.items() if e == d}, (d, t)
    assert sum(r.length for r in got) == sum(len([*reference.encode(t or "", add_special_tokens=False).ids, 1]) for _, t, _ in rows)
    assert packing.pack(frame(spark, []), *files).count() == 0


def test_special_tokens_of_a_text_are_those_of_the_tokenizer(spark, tmp_path):
    from dosepath.llm import queries

    texts = [*TEXTS, "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x <|endoftext|", "  <|endoftext|>  \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = defaultdict(list)
    for r in queries.op10_vector_packing(spark, str(tmp_path)).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, t in enumerate(texts):
        ids = [*reference.encode(t or "", add_special_tokens=False).ids, 1]
        assert sum(n for _, n, _, _ in got[d]) == len(ids)
        for start, n, crc, total in got[d]:
            assert (crc, total) == (zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids))


def test_ids_equal_the_tokenizers_on_all_documents():
    import pyarrow.parquet as pq

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        encode, _ = packing.byte_bpe(f.read(), public_tokenizers.PATTERN, packing.SPECIAL)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert encode(texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def packed_by_hand(examples, limits, window, cut):
    """The heuristic in plain Python. examples: lists of 0 and 1, the loss of each token."""
    out, waiting, left, offset, sequence, fresh = [], [], list(limits), 0, 0, 1

    def demand(w):
        return len(w[2]), 1, sum(w[2])

    def place():
        nonlocal left, offset, sequence, fresh
        found = [(sum(n / m * (x / m) for n, m, x in zip(demand(w), limits, left, strict=True)), -k) for k, w in enumerate(waiting) if all(n <= x for n, x in zip(demand(w), left, strict=True))]
        if found:
            most = max(x for x, _ in found)
            k, size = min(-i for x, i in found if x > most - 1e-12), None
        else:
            heads = []
            for k, (_, _, loss) in enumerate(waiting):
                n = max(n for n in range(min(left[0], len(loss) - 1) + 1) if sum(loss[:n]) <= left[2])
                heads.append((-n, len(loss) if len(loss) > left[0] else 10**9, k))
            n, _, k = min(heads)
            if not cut or not n or not left[0] or not left[1]:
                sequence, fresh, left, offset = fresh, fresh + 1, list(limits), 0
                return
            size = -n
        item, start, loss = waiting[k]
        size = size or len(loss)
        out.append((item, sequence, offset, start, size))
        left = [left[0] - size, left[1] - 1, left[2] - sum(loss[:size])]
        offset += size
        if size == len(loss):
            waiting[k] = waiting[-1]
            waiting.pop()
        else:
            waiting[k] = (item, start + size, loss[size:])

    for i, loss in enumerate(examples):
        start = 0
        while len(loss) >= limits[0] or sum(loss) > limits[2]:
            n = max(n for n in range(min(limits[0], len(loss)) + 1) if sum(loss[:n]) <= limits[2])
            out.append((i, fresh, 0, start, n))
            fresh, start, loss = fresh + 1, start + n, loss[n:]
        if loss:
            waiting.append((i, start, loss))
            while len(waiting) > window:
                place()
    while waiting:
        place()
    return out


@pytest.mark.parametrize("limits, cut", [((100, 5, 60), True), ((64, 64, 64), True), ((100, 50, 30), False), ((50, 3, 7), True)])
def test_every_placement_is_the_best(limits, cut):
    r = random.Random(2)
    examples = [[int(r.random() < share) for _ in range(r.choice([1, 3, 10, 40, 59, 100, 230]))] for share in (0.1, 0.5, 1.0) for _ in range(60)]
    r.shuffle(examples)
    packer, got = packing.Packer(limits, 20, cut), []
    for i, x in enumerate(examples):
        got += packer.put(i, np.r_[0, np.cumsum(x)])
    got += packer.end()
    assert got == packed_by_hand(examples, limits, 20, cut)
    use, seen = defaultdict(lambda: [0, 0, 0]), defaultdict(list)
    for i, sequence, offset, start, size in got:
        assert offset == use[sequence][0]
        use[sequence] = [use[sequence][0] + size, use[sequence][1] + 1, use[sequence][2] + sum(examples[i][start : start + size])]
        seen[i].append((start, size))
    assert all(n <= m for u in use.values() for n, m in zip(u, limits, strict=True))
    for i, x in enumerate(examples):
        at = 0
        for start, size in sorted(seen[i]):
            assert start == at
            at += size
        assert at == len(x)


def test_packer_fills_sequences_and_keeps_limits():
    r = random.Random(2)
    packer, out = packing.Packer((100, 5, 60), 20, True), []
    total = 0
    for i in range(400):
        n = r.randint(1, 59)
        total += n
        bears = [0] * n
        for k in r.sample(range(n), r.randint(0, n)):
            bears[k] = 1
        out += packer.put(i, np.r_[0, np.cumsum(bears)])
    out += packer.end()
    assert sum(x[4] for x in out) == total
    by = defaultdict(list)
    for item, sequence, offset, start, length in out:
        by[sequence].append(length)
    assert all(sum(x) <= 100 and len(x) <= 5 for x in by.values())


def test_nothing_is_cut_on_request():
    packer = packing.Packer((100, 50, 100), 10, False)
    out = [x for i in range(50) for x in packer.put(i, np.zeros(31 + i, int))] + list(packer.end())
    assert sorted((x[0], x[4]) for x in out) == [(i, 30 + i) for i in range(50)]


def test_short_documents_fill_sequences(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "concat('two ', id) as text").repartition(2)
    got = packing.pack(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(x.n for x in got) / (2048 * len(got)) > 0.95


def test_answers_bear_loss_and_their_limit_binds(spark):
    rows = [(x.conv_id, x.turn, x.role, x.text or "") for x in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()]
    examples = defaultdict(lambda: ["", []])
    for conv, _, role, text in rows:
        e = examples[conv]
        if role == "assistant":
            e[1].append((len(e[0]), len(e[0]) + len(text)))
        e[0] += text + "\n"
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(examples.values())], "doc_id long, text string, answers array<struct<start:int,end:int>>").repartition(2)
    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    got = packing.pack(df, *files, max_loss_tokens=500, max_segments=16, loss="answers").collect()
    use = defaultdict(lambda: [0, 0, 0])
    for x in got:
        u = use[x.sequence_id]
        use[x.sequence_id] = [u[0] + x.length, u[1] + 1, u[2] + x.loss_tokens]
    assert all(a <= 2048 and b <= 16 and c <= 500 for a, b, c in use.values())
    assert any(c > 450 for _, _, c in use.values())  # it binds
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, (text, spans) in enumerate(examples.values()):
        offsets = reference.encode(text, add_special_tokens=False).offsets
        bears = [any(a <= s < b for a, b in spans) for s, _ in offsets]
        own = sum(x.loss_tokens for x in got if x.doc_id == i)
        if text.isascii():  # offsets inside a code point differ
            assert own == sum(bears) + (bears[-1] if bears else 0)


def test_loss_of_odd_spans():
    span = lambda a, b: {"start": a, "end": b}
    assert packing.loss_of("é b", [span(0, 1), None, span(2, 99), span(2, 1), span(None, 3)], [2, 1, 1]).tolist() == [True, False, True, True]
    assert packing.loss_of("", [span(0, 5)], []).tolist() == [False] and packing.loss_of("ab", None, [1, 1]).tolist() == [False] * 3


def test_quality_learns_and_scores_everything(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = [r.choice(words) for _ in range(r.randint(5, 200))]
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in text) + ".", "s"))
        labels.append((i, 0 if bad else 1))
    labels += [(8, None), (99999, 1), (9, 3)]
    mark = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = frame(spark, rows + ODD)
    model = quality.fit(quality.features(docs), mark, learn_from=~quality.held_out(F.col("_id")))
    got = quality.scored(docs, model).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= x.quality_score <= 1 for x in got)
    y = dict(labels[:600])
    assert all((x.quality_score >= 0.5) == (y[x.doc_id] == 1) for x in got if x.doc_id in y)
    # the closed form, with numpy
    features = {x.doc_id: np.array([x[f"__x_{n}"] for n in quality.FEATURES]) for x in quality.featured(docs, [docs.doc_id]).collect()}
    odds = []
    for mean, factor, constant in zip(model.means, model.factors, model.constant, strict=True):
        full = np.tril(np.array([[*f] for f in factor]))
        odds.append({d: constant - 0.5 * ((full @ (x - np.array(mean))) ** 2).sum() for d, x in features.items()})
    for x in got:
        if x.doc_id in y:
            want = 1 / (1 + np.exp(model.cut - np.arcsinh(odds[1][x.doc_id] - odds[0][x.doc_id])))
            assert x.quality_score == pytest.approx(want, abs=1e-6)
    for kept, score in (((0,), 0.0), ((1,), 1.0), ((), 0.5)):
        one = quality.fit(quality.features(docs), mark.where(F.col("quality").isin(*kept) if kept else F.lit(False)))
        assert {x.quality_score for x in quality.scored(docs, one).collect()} == {score}
    assert quality.scored(frame(spark, []), model).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def joined_by_hand(rows):
    sets = [(d, shingles(t)) for d, t, _ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        least[find(i)].append(d)
    return Counter((d, len(s), min((x for x in least[find(i)] if x is not None), default=None) if s else d) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("hot", [64, 2])
def test_join_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)  # 2: most columns are frequent, so the blocks of whole sets do the work
    monkeypatch.setattr(ngram_join, "DENSE", 300)
    r = random.Random(8)
    rows = documents(200, seed=hot) + ODD
    base = [f"w{r.randrange(1000)}" for _ in range(60)]
    for i in range(60):  # a group of near copies in which many pairs do not link
        text = list(base)
        for _ in range(r.randint(0, 4)):
            text[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((9000 + i, " ".join(text).upper() if i % 2 else "  ".join(text), "s"))
    got = ngram_join.similar_components(frame(spark, rows))
    assert Counter(map(tuple, got.collect())) == joined_by_hand(rows)


def test_join_of_nothing(spark):
    assert ngram_join.similar_components(frame(spark, [])).count() == 0
    got = ngram_join.similar_components(frame(spark, [(1, None, "s"), (2, "", "s"), (3, " ", "s")]))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_hashes_tell_sets_apart():
    hasher = ngram_join.Hasher(5)
    texts = [b"a b c d e f", b"A  b\tc d e f", b"b c d e f a", b"", b"a b", b"a b\x0b"]
    t, h = hasher.sets(texts)
    own = [set(h[t == i].tolist()) for i in range(6)]
    assert own[0] == own[1] and own[0] != own[2] and not own[3] and own[4] == own[5] and len(own[4]) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70), (70, 70), (None, 3), (200, 201), (201, 200)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    want = {i: 1 for i in range(1, 41)} | {50: 50, 70: 50, 100: 50, 200: 200, 201: 200}
    assert dict(map(tuple, got.collect())) == want and got.count() == len(want)
