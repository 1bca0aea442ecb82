"""The stages on small tables, each against plain Python on its own input."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage_of(name):
    return dict(corpus_pipeline.STAGES)[name]


def frame(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i else None, len(t) if t else 0) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1))


def test_the_stages_run_in_turn(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(function(spark, docs, SF), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen.append(docs.count())
    assert seen[0] > seen[1] == seen[2] > 0
    packed = corpus_pipeline.packing_stage(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_one_document_of_a_group_stays(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:59], "other"]
    texts = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words[::-1])), (9, " ".join(words[::-1])), (None, " ".join(words)), (7, None), (8, "")]
    got = stage_of("near_duplicates")(spark, frame(spark, texts), SF).collect()
    assert Counter(r.doc_id for r in got) == Counter([3, 9, None, 7, 8])
    assert stage_of("near_duplicates")(spark, frame(spark, texts[:2]), SF).count() == 1


def near(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    both = len(sets[0] & sets[1])
    return both > 0 and 100 * both >= 75 * len(sets[0] | sets[1])


def test_rows_of_one_id_are_decided_one_by_one(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(40):
        body = [word() for _ in range(50)]
        for _ in range(r.randint(1, 4)):
            own = list(body)
            own[r.randrange(50)] = word()
            texts.append((r.choice([None, *range(12)]), " ".join(own)))
    texts += texts[:5] + [(3, ""), (3, None)]
    got = [(x.doc_id, x.text) for x in stage_of("near_duplicates")(spark, frame(spark, texts), SF).collect()]
    want, seen = [], set()
    for i in range(len(texts)):  # groups by search
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            x = todo.pop()
            new = {j for j in range(len(texts)) if j not in group and near(texts[x][1], texts[j][1])}
            group |= new
            todo += new
        seen |= group
        ids = [texts[j][0] for j in group if texts[j][0] is not None]
        want.append((min(ids, default=None), [texts[j] for j in group]))
    left = Counter(got)
    for least, rows in want:
        own = [x for x in rows if x[0] is None] if len(rows) > 1 else rows
        left -= Counter(own)
        if least is not None and len(rows) > 1:
            one = [x for x in set(rows) if x[0] == least and left[x]]
            assert one, (least, rows)
            left[one[0]] -= 1
    assert not +left


def test_texts_are_sanitised(spark):
    got = {r.doc_id: r for r in stage_of("pii")(spark, frame(spark, [(1, "write a@b.co now"), (2, "clean"), (3, None)]), SF).collect()}
    assert (got[1].text, got[1].n_chars) == ("write <EMAIL> now", 17)
    assert got[2].text == "clean" and got[3].text is None


def test_the_mix_takes_copies(spark):
    texts = [(i, "one two three " * (i + 1)) for i in range(12)] + [(50, "")]
    docs = frame(spark, texts)
    got = Counter(r.doc_id for r in stage_of("mixing")(spark, docs, SF).collect())
    from dosepath.llm import mixing

    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies if r.size else 1
    assert got == +want and got[50] == 1


def test_the_mix_takes_rows_not_ids(spark):
    texts = [(i % 200 if i % 5 else None, " ".join(["w"] * (1 + i * 37 % 61)) + f" t{i}") for i in range(600)]
    texts += [texts[7]] * 9 + [(4, "")] * 3
    docs = spark.createDataFrame([(i, t, "en", f"s{n % 3}", len(t)) for n, (i, t) in enumerate(texts)], SCHEMA)
    got = stage_of("mixing")(spark, docs, SF)
    from dosepath.llm import mixing

    mixed = mixing.mix(docs).collect()
    words = Counter()
    for r in got.collect():
        words[r.source] += len(r.text.split())
    for source in ("s0", "s1", "s2"):
        own = [r for r in mixed if r.source == source]
        assert words[source] == sum(r.taken for r in own)
        assert abs(words[source] - own[0].target) <= 61
    assert got.where("text = ''").count() == 3


def test_the_quality_stage_equals_its_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = frame(spark, [(None, None), (10**9, ""), (10**9, "")]).drop("extra")
    docs = docs.select(*corpus_pipeline.COLUMNS).unionByName(odd)
    from dosepath.llm import quality

    model = quality.fit(quality.features(docs), spark.read.parquet(f"{SF}/labels.parquet"), learn_from=~quality.held_out(F.col("_id")))
    want = quality.scored(docs, model).where("quality_score >= 0.5").select(*corpus_pipeline.COLUMNS)
    got = stage_of("quality")(spark, docs, SF)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_packing_has_all_tokens_of_all_rows(spark):
    got = stage_of("packing")(spark, frame(spark, [(1, "a b"), (1, "a b"), (None, None), (2, "")]), SF).collect()
    assert Counter((r.doc_id, r.length, r.doc_tokens) for r in got) == Counter({(1, 3, 3): 2, (None, 1, 1): 1, (2, 1, 1): 1})


def test_a_run_leaves_nothing_but_its_result(spark, tmp_path, monkeypatch):
    import os

    from dosepath.plans import staging

    monkeypatch.setattr(staging, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(os.listdir(tmp_path)) == len(corpus_pipeline.STAGES)


def test_empty_tables(spark):
    empty = frame(spark, [])
    for name, function in corpus_pipeline.STAGES:
        assert function(spark, empty, SF).count() == 0, name
