import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from dosepath.operators import intervals

DAY = dt.date(2020, 1, 1)
ERAS = "person_id bigint, ingredient_concept_id bigint, era_start_date date, era_end_date date"


def day(n):
    return DAY + dt.timedelta(days=n)


def merged_by_hand(rows, gap, distinct_starts):
    out = {}
    for p, i, s, e in sorted(rows):
        islands = out.setdefault((p, i), [])
        if islands and s <= islands[-1][1] + gap:
            last = islands[-1]
            last[2] += 1 if not distinct_starts or s != last[3] else 0
            last[1], last[3] = max(last[1], e), s
        else:
            islands.append([s, e, 1, s])
    return sorted((p, i, day(s), day(e), n) for (p, i), xs in out.items() for s, e, n, _ in xs)


rows = st.lists(st.tuples(st.integers(1, 2), st.integers(1, 2), st.integers(0, 60), st.integers(0, 20)).map(lambda t: (t[0], t[1], t[2], t[2] + t[3])), max_size=25)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(intervals_=rows, gap=st.integers(0, 10), distinct_starts=st.booleans())
def test_gap_merge_equals_a_loop(spark, intervals_, gap, distinct_starts):
    df = spark.createDataFrame([(p, i, day(s), day(e)) for p, i, s, e in intervals_], ERAS)
    out = intervals.gap_merged(df, gap, distinct_starts=distinct_starts)
    got = sorted((r.person_id, r.ingredient_concept_id, r.era_start_date, r.era_end_date, r.drug_exposure_count) for r in out.collect())
    assert got == merged_by_hand(intervals_, gap, distinct_starts)


def test_merge_is_idempotent_and_leaves_wider_gaps(spark):
    df = spark.createDataFrame([(1, 1, day(s), day(s + 4)) for s in (0, 3, 34, 70, 71)], ERAS)
    once = intervals.gap_merged(df, 30)
    assert sorted((r.era_start_date, r.era_end_date) for r in once.collect()) == [(day(0), day(38)), (day(70), day(75))]
    assert sorted(tuple(r)[:4] for r in intervals.gap_merged(once, 30).collect()) == sorted(tuple(r)[:4] for r in once.collect())


def test_a_start_on_the_gap_merges(spark):
    df = spark.createDataFrame([(1, 1, day(0), day(0)), (1, 1, day(30), day(30)), (1, 1, day(61), day(61))], ERAS)
    assert intervals.gap_merged(df, 30).count() == 2


def test_end_dates_are_imputed(spark):
    schema = "person_id bigint, drug_concept_id bigint, drug_exposure_start_date date, drug_exposure_end_date date, days_supply int"
    df = spark.createDataFrame([(1, 1, day(0), day(9), 5), (2, 1, day(0), None, 5), (3, 1, day(0), None, 0), (4, 1, day(5), day(0), 5), (5, 1, None, None, 5), (6, 1, day(0), None, None)], schema)
    got = {r.person_id: r.era_end_date for r in intervals.imputed_exposures(df).collect()}
    assert got == {1: day(9), 2: day(4), 3: day(0), 6: day(0)}


def test_raw_eras_count_rows_and_use_the_drug(spark):
    schema = "person_id bigint, drug_concept_id bigint, drug_exposure_start_date date, drug_exposure_end_date date"
    df = spark.createDataFrame([(1, 7, day(0), None), (1, 7, day(0), day(3)), (1, 7, day(20), day(22))], schema)
    (r,) = intervals.raw_drug_eras(df).collect()
    assert (r.ingredient_concept_id, r.era_end_date, r.drug_exposure_count, r.gap_days) == (7, day(22), 3, 0)


@pytest.mark.parametrize("distinct_starts", [True, False])
def test_hot_keys_in_pieces_equal_one_window(spark, distinct_starts):
    r = random.Random(4)
    rows = []
    for person, n, span in ((1, 3000, 2000), (2, 40, 300), (None, 2500, 40_000), (3, 2000, 1)):  # dense, small, null and of one day
        for _ in range(n):
            s = r.randrange(span)
            rows.append((person, r.choice([7, 8]), dt.date(2000, 1, 1) + dt.timedelta(s), dt.date(2000, 1, 1) + dt.timedelta(s + r.choice([0, 3, 40, 900 if r.random() < 0.01 else 5]))))
    df = spark.createDataFrame(rows, "person_id long, ingredient_concept_id long, era_start_date date, era_end_date date").repartition(5)
    want = sorted(map(str, intervals.gap_merged(df, 2, distinct_starts=distinct_starts).collect()))
    got = sorted(map(str, intervals.gap_merged(df, 2, distinct_starts=distinct_starts, hot_rows=500).collect()))
    assert got == want
    assert sorted(map(str, intervals.gap_merged(df, 2, distinct_starts=distinct_starts, hot_rows=10**6).collect())) == want


def test_equal_rows_of_a_hot_key_stay_in_one_island_whatever_the_order_of_staged_rows(spark, monkeypatch):
    staged = intervals.stage
    shuffled = lambda df, name: staged(df, name).repartition(5).sortWithinPartitions(*(["_fresh"] if name == "marked" else []), F.rand(3))
    monkeypatch.setattr(intervals, "stage", shuffled)
    df = spark.range(3000).select(F.lit(1).cast("long").alias("person_id"), F.lit(5).cast("long").alias("ingredient_concept_id"), F.date_add(F.lit(DAY), (F.col("id") % 300 * 4).cast("int")).alias("era_start_date"))
    df = df.withColumn("era_end_date", F.date_add("era_start_date", F.dayofmonth("era_start_date") % 2))  # ten rows of each start
    want = sorted(map(str, intervals.gap_merged(df, 1, distinct_starts=False).collect()))
    assert sorted(map(str, intervals.gap_merged(df, 1, distinct_starts=False, hot_rows=100).collect())) == want and len(want) == 300


def test_a_million_eras_of_one_person_go_over_several_tasks(spark):
    start = F.date_add(F.lit("1000-01-01").cast("date"), (F.pmod(F.xxhash64("id"), F.lit(2_500_000))).cast("int"))
    df = spark.range(1_000_000).select(F.lit(1).cast("long").alias("person_id"), F.lit(5).cast("long").alias("ingredient_concept_id"), start.alias("era_start_date"), F.date_add(start, 1).alias("era_end_date"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plain = intervals.gap_merged(df, 0)
        pieces = intervals.gap_merged(df, 0, hot_rows=100_000)
        digest = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("era_start_date", "era_end_date", "drug_exposure_count").cast("decimal(38,0)"))).first()
        assert digest(pieces) == digest(plain) and digest(plain)[0] > 100_000
        tasks = pieces.withColumn("_task", F.spark_partition_id()).groupBy("_task").count().collect()
        assert len(tasks) > 1 and max(t["count"] for t in tasks) < 0.6 * sum(t["count"] for t in tasks)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_tasks_of_a_merge_are_made_by_the_number_of_rows(spark, monkeypatch):
    from dosepath.plans import staging

    monkeypatch.setattr(staging, "ROWS", 100)
    df = spark.range(20_000).select((F.col("id") % 7001).alias("person_id"), F.lit(5).cast("long").alias("ingredient_concept_id"), F.date_add(F.lit(DAY), (F.col("id") % 997).cast("int")).alias("era_start_date"))
    df = df.withColumn("era_end_date", F.date_add("era_start_date", 2))
    plain, by_rows = intervals.gap_merged(df, 3), intervals.gap_merged(df, 3, rows=20_000)
    assert by_rows.exceptAll(plain).isEmpty() and by_rows.count() == plain.count()
    shuffles = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert ", 200), REPARTITION_BY_NUM" in shuffles(by_rows) and "REPARTITION" not in shuffles(intervals.gap_merged(df, 3, rows=100))


def test_tasks_of_eligibility_and_clipping_are_made_by_the_number_of_eras(spark, monkeypatch):
    from dosepath.operators import cohort
    from dosepath.plans import staging

    monkeypatch.setattr(staging, "ROWS", 100)
    start = F.date_add(F.lit(DAY), (F.col("id") % 997).cast("int"))
    eras = spark.range(20_000).select((F.col("id") % 1301).alias("person_id"), (F.col("id") % 3).alias("ingredient_concept_id"), start.alias("era_start_date"), F.date_add(start, 40).alias("era_end_date"), F.lit(1).cast("long").alias("drug_exposure_count"), F.lit(30).cast("long").alias("gap_days"))
    ids = spark.range(1301).select(F.col("id").alias("person_id"))
    observation = ids.select("person_id", F.date_sub(F.lit(DAY), 400).alias("observation_period_start_date"), F.date_add(F.lit(DAY), 300).alias("observation_period_end_date"))
    death = ids.where("person_id % 7 = 0").select("person_id", F.date_add(F.lit(DAY), 200).alias("death_date"))
    plain, by_rows = cohort.eligible(eras, observation, death), cohort.eligible(eras, observation, death, rows=20_000)
    assert by_rows.exceptAll(plain).isEmpty() and by_rows.count() == plain.count() > 500
    clipped, dealt = intervals.clipped_eras(eras, plain), intervals.clipped_eras(eras, plain, rows=20_000)
    assert dealt.exceptAll(clipped).isEmpty() and dealt.count() == clipped.count() > 5000
    by_number = lambda d: d._jdf.queryExecution().executedPlan().toString().count(", 200), REPARTITION_BY_NUM")
    assert (by_number(by_rows), by_number(dealt)) == (3, 2) and by_number(plain) == by_number(intervals.clipped_eras(eras, plain, rows=100)) == 0


def test_tasks_of_months_and_events_are_made_by_the_number_of_rows(spark, monkeypatch):
    from dosepath.config import Settings
    from dosepath.operators import events, features, grid
    from dosepath.plans import staging

    monkeypatch.setattr(staging, "ROWS", 100)
    s, day = Settings(), F.lit(DAY).cast("date")
    ids = spark.range(300).select(F.col("id").alias("person_id"), day.alias("index_date"), F.date_add(day, 700).alias("censor_date"))
    start = F.date_add(day, (F.col("number") * 90 + F.col("person_id") % 30).cast("int"))
    clipped = ids.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("number")).select("person_id", (F.col("number") % 2).cast("long").alias("ingredient_concept_id"), start.alias("era_start_date"), F.date_add(start, 40).alias("era_end_date"), F.lit(1).cast("long").alias("drug_exposure_count"), F.lit(30).cast("long").alias("gap_days"), F.lit(False).alias("clipped_at_censor"), "index_date", "censor_date")
    persons = lambda n: features.person_features(ids, grid.month_states(ids, clipped, s, n=n), events.era_events(clipped, s, n=n), s)
    plain, by_rows = persons(None), persons(5000)
    assert by_rows.exceptAll(plain).isEmpty() and by_rows.count() == plain.count() == 300
    by_number = lambda d: d._jdf.queryExecution().executedPlan().toString().count(", 50), REPARTITION_BY_NUM")
    assert by_number(by_rows) == 2 and by_number(plain) == 0
