"""End-to-end cohorts made by hand."""

import datetime as dt

import pytest

from dosepath import schemas
from dosepath.config import Settings
from dosepath.operators import grid, validity
from dosepath.plans import sinks, staging, trajectory

D = dt.date.fromisoformat
S = Settings(turnover_low=0.25, k_grid=(2,), top_ingredients=5)
ERAS = [
    (1, 101, "2020-01-01", "2021-12-31"),
    (2, 101, "2020-01-01", "2021-12-31"),
    (2, 102, "2020-07-01", "2021-12-31"),
    (2, 103, "2021-01-01", "2021-12-31"),
    (2, 104, "2021-01-01", "2021-12-31"),
    (2, 105, "2021-01-01", "2021-12-31"),
    (3, 106, "2020-01-01", "2020-05-01"),
    (3, 106, "2020-07-01", "2020-08-31"),
    (4, 107, "2020-01-01", "2020-01-07"),
    (5, 101, "2020-01-01", "2021-12-01"),
]
OBSERVED = [(p, "2018-01-01", "2023-01-01") for p in (1, 2, 3, 4)] + [(5, "2018-01-01", "2021-12-31")]


def frames(spark, eras, observed):
    e = spark.createDataFrame([(p, i, D(s), D(x), 1, 0) for p, i, s, x in eras], schemas.DRUG_ERA)
    o = spark.createDataFrame([(p, D(s), D(x)) for p, s, x in observed], schemas.OBSERVATION_PERIOD)
    return e, o


def run(spark, eras, observed=None, s=S, **kw):
    observed = observed or [(p, "2018-01-01", "2023-01-01") for p in {x[0] for x in eras}]
    e, o = frames(spark, eras, observed)
    names = spark.createDataFrame([(101, "Drug A"), (102, "Drug B"), (106, "Drug C"), (107, "Drug D")], schemas.INGREDIENT)
    return trajectory.run(e, o, spark.createDataFrame([], schemas.DEATH), names, s, **kw)


@pytest.fixture(scope="module")
def primary(spark):
    return run(spark, ERAS, OBSERVED)


@pytest.fixture(scope="module")
def persons(primary):
    return {r.person_id: r for r in primary["final_person"].collect()}


def test_phenotypes(persons):
    assert persons[1].discontinuation_phenotype == "Persistent stable use"
    assert persons[2].poly_month_prop > 0
    assert persons[3].restart_180_rate > 0
    assert not persons[4].disc_evaluable and persons[4].discontinuation_phenotype == "Insufficient prescribing history"


def test_features(persons):
    assert persons[1].n_ingredient_eras >= 1 and persons[1].median_era_days >= 365
    assert persons[2].n_distinct_ingredients > persons[1].n_distinct_ingredients
    assert persons[1].disc_evaluable and persons[1].is_single_era_maintenance == 1.0
    assert persons[4].is_single_era_maintenance is None
    for r in persons.values():
        assert abs(sum(r[f"prop_{x}"] for x in schemas.STATES) - 1) < 1e-9


def test_censoring_hides_the_restart_window(primary):
    (r,) = primary["era_events"].where("person_id = 5").collect()
    assert r.observed_for_restart_window == 0


def test_clusters(primary, persons):
    assert all(isinstance(r.trajectory_cluster, int) for r in persons.values())
    assert persons[4].trajectory_cluster == -1
    assert all(persons[p].trajectory_cluster in (0, 1) for p in (1, 2, 3, 5))
    summary = primary["cluster_summary"].collect()
    assert sum(r.n_people for r in summary) == 4 and all(r.trajectory_cluster >= 0 for r in summary)
    assert -1 in {r.trajectory_cluster for r in primary["top_ingredients"].collect()}


def test_months_are_contiguous_and_turnover_is_a_share(primary):
    months = primary["person_month_summary"].collect()
    for p in {r.person_id for r in months}:
        own = sorted((r.month_index, r.turnover) for r in months if r.person_id == p)
        assert [m for m, _ in own] == list(range(1, len(own) + 1))
        assert own[0][1] == 1.0 and all(0 <= t <= 1 for _, t in own)


def test_single_person_is_not_clustered(spark):
    out = run(spark, [(1001, 101, "2020-01-01", "2021-12-31")])
    assert [r.trajectory_cluster for r in out["final_person"].collect()] == [-1]


def test_overlapping_eras_keep_both_persons(spark):
    out = run(spark, [(2001, 201, "2020-01-01", "2020-06-30"), (2001, 201, "2020-05-01", "2020-09-30"), (2001, 202, "2020-01-01", "2020-06-30"), (2002, 201, "2020-01-01", "2020-12-31")], fixed_k=1)
    assert {r.person_id for r in out["final_person"].collect()} == {2001, 2002}


def test_era_before_observation_drops_the_person(spark):
    out = run(spark, [(3001, 301, "2020-01-01", "2023-06-30"), (3002, 301, "2017-01-01", "2018-12-31")])
    assert {r.person_id for r in out["final_person"].collect()} == {3001}


def test_short_courses_are_not_evaluable(spark):
    out = run(spark, [(4001, 401, "2020-01-01", "2020-01-10"), (4001, 401, "2020-03-01", "2020-03-10"), (4001, 401, "2020-06-01", "2020-06-10")])
    assert not out["final_person"].collect()[0].disc_evaluable


def test_nobody_evaluable_and_empty_input(spark):
    assert run(spark, [(4, 107, "2020-01-01", "2020-01-07")])["final_person"].collect()[0].trajectory_cluster == -1
    e, o = frames(spark, [], [])
    out = trajectory.run(e, o, None, spark.createDataFrame([], schemas.INGREDIENT), S)
    assert out["final_person"].count() == 0 and out["cluster_summary"].count() == 0


def test_infeasible_k_fails_safely(spark):
    out = run(spark, ERAS, OBSERVED, fixed_k=50)
    assert {r.trajectory_cluster for r in out["final_person"].collect()} == {-1}


def test_focus_moves_the_index_date(spark):
    out = run(spark, ERAS, OBSERVED, s=S.having(focus_ingredients=(102,)))
    assert [(r.person_id, str(r.index_date)) for r in out["eligible"].collect()] == [(2, "2020-07-01")]


def test_negative_controls_and_comparison(spark, primary):
    final = primary["final_person"]
    controls = spark.createDataFrame([(4,), (1,), (99,)], "person_id bigint")
    assert validity.validate_negative_controls(final, controls) == {"passed": False, "n_violations": 1, "violations": [1]}
    assert validity.validate_negative_controls(final, controls.where("person_id = 4"))["passed"]
    assert {r.same_phenotype for r in validity.compared_runs(final, final).collect()} == {1}


def test_month_ends_are_clamped(spark):
    e = spark.createDataFrame([(1, D("2020-01-31"), D("2022-01-30"))], "person_id bigint, index_date date, censor_date date")
    starts = [str(r.month_start) for r in grid.month_grid(e, 3).orderBy("month_index").collect()]
    assert starts == ["2020-01-31", "2020-02-29", "2020-03-31"]


def test_results_are_written(spark, primary, tmp_path):
    paths = sinks.write_results(primary, str(tmp_path), "x")
    assert len(paths) == 7
    assert spark.read.parquet(f"{tmp_path}/x_person_level_phenotypes.parquet").count() == 5
    sinks.write_csv(spark, [], "label string, k int, silhouette double", f"{tmp_path}/grid.csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/grid.csv").count() == 0


def test_switches_equal_brute_force_and_a_long_person_ends(spark):
    import datetime
    import random
    import time

    from pyspark.sql import functions as F

    from dosepath.operators import events

    r = random.Random(4)
    day = lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(days=n)
    rows = []
    for _ in range(400):
        start = r.randrange(900)
        rows.append((r.randrange(5), r.randrange(4), day(start), day(start + r.randrange(90)), 1, 0, False, day(0), day(2000)))
    schema = "person_id long, ingredient_concept_id long, era_start_date date, era_end_date date, drug_exposure_count long, gap_days long, clipped_at_censor boolean, index_date date, censor_date date"
    got = [(x.person_id, x.ingredient_concept_id, x.era_start_date, x.era_end_date, x.switched_within_60d) for x in events.era_events(spark.createDataFrame(rows, schema), Settings()).collect()]
    hit = lambda e: int(any(o[0] == e[0] and o[1] != e[1] and 0 < (o[2] - e[3]).days <= 60 for o in rows))
    assert sorted(got) == sorted((*e[:4], hit(e)) for e in rows)
    one = spark.range(100_000).select(F.lit(1).cast("long").alias("person_id"), (F.col("id") % 50).alias("ingredient_concept_id"), F.expr("date_add(date'1950-01-01', cast(id % 25000 as int))").alias("era_start_date"))
    one = one.withColumn("era_end_date", F.date_add("era_start_date", 5)).withColumns({"drug_exposure_count": F.lit(1), "gap_days": F.lit(0), "clipped_at_censor": F.lit(False), "index_date": F.lit(None).cast("date"), "censor_date": F.lit(day(0))})
    began = time.time()
    assert events.era_events(one, Settings()).agg(F.sum("switched_within_60d")).collect()[0][0] > 0
    assert time.time() - began < 60


def test_slope_and_turnover_do_not_depend_on_the_order_of_rows(spark):
    """A slope of exactly -0.1 is not below it, and parts of a mean are not added in an order of their own."""
    import itertools

    from pyspark.sql import functions as F

    from dosepath.operators import features

    burden = [1, 2, 3, 3, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 0, 0, 0, 0]
    turnover = [1.0, 2 / 3, 0.2, 1 / 3, 0.75, 0.6, 1 / 7, 0.0]
    rows = [(p, m + 1, n, turnover[(m + p) % 8], "NoRx") for p in range(40) for m, n in enumerate(burden)]
    months = spark.createDataFrame(rows, "person_id long, month_index int, active_n long, turnover double, state string")
    want = {p: list(itertools.accumulate(turnover[(m + p) % 8] for m in range(24)))[-1] / 24 for p in range(40)}  # sum() compensates
    for seed in (1, 2, 3):
        found = features.month_features(months.repartition(7, "month_index").orderBy(F.rand(seed)), S).collect()
        assert {r.burden_slope for r in found} == {-0.1}
        assert {r.person_id: r.mean_turnover for r in found} == want
    odd = spark.createDataFrame([(1, 1, 2, 0.5, "NoRx"), (2, 1, 2, None, "NoRx"), (2, 2, 4, None, "NoRx")], months.schema)
    assert {r.person_id: (r.burden_slope, r.mean_turnover) for r in features.month_features(odd, S).collect()} == {1: (0.0, 0.5), 2: (2.0, None)}


def test_persons_and_clusters_are_dealt_by_the_number_of_rows(spark, monkeypatch):
    eras = [(p, 101 + p % 3, "2020-01-01", str(D("2020-02-01") + dt.timedelta(p * 7 % 600))) for p in range(300)]
    plain = run(spark, eras, fixed_k=2)["final_person"]
    files, stage = {}, trajectory.stage

    def staged(df, name, *keys):
        out = stage(df, name, *keys)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(trajectory, "stage", staged)
    monkeypatch.setattr(staging, "ROWS", 400)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of many persons
    try:
        dealt = run(spark, eras, fixed_k=2)["final_person"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert files["persons"] > 8 and files["final"] > 8  # a task a file; 4 shuffle partitions before
    same = [c for c in plain.columns if c != "trajectory_cluster"]
    assert dealt.select(same).exceptAll(plain.select(same)).isEmpty() and dealt.count() == plain.count() == 300
    assert dealt.where("trajectory_cluster >= 0").count() == plain.where("trajectory_cluster >= 0").count() > 0


def test_a_slope_on_the_threshold_is_rounded_as_regr_slope_rounds_it(spark):
    """Slopes of exactly -0.1, on either side of it by their last digits, whatever the order of rows."""
    import itertools

    import duckdb
    from pyspark.sql import functions as F

    from dosepath.operators import features

    sums = lambda y: (len(y) * sum(m * n for m, n in enumerate(y, 1)) - sum(range(1, len(y) + 1)) * sum(y), (len(y) ** 4 - len(y) ** 2) // 12)
    falling = [y for k in (5, 6, 8, 9) for y in itertools.product((1, 0, 2), repeat=k) if 10 * sums(y)[0] == -sums(y)[1]][:200]
    long = [1, 2, 3, 3, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 0, 0, 0, 0]
    con = duckdb.connect(config={"threads": 1})
    slope = lambda y: con.execute(f"SELECT regr_slope(n, m) FROM (VALUES {', '.join(f'({m}, {n})' for m, n in enumerate(y, 1))}) t(m, n)").fetchone()[0]
    want = {p: slope(y) for p, y in enumerate([*falling, long])}
    assert {x < -0.1 for x in want.values()} == {True, False}
    rows = [(p, m, n, 0.5, "NoRx") for p, y in enumerate([*falling, long]) for m, n in enumerate(y, 1)]
    months = spark.createDataFrame(rows, "person_id long, month_index int, active_n long, turnover double, state string")
    found = features.month_features(months.repartition(7, "month_index").orderBy(F.rand(1)), S).collect()
    assert {r.burden_slope for r in found} == {-0.1}
    assert {r.person_id: r.fitted_slope for r in found} == want
    odd = spark.createDataFrame([(1, 1, 2, 0.5, "NoRx"), (2, 2, 1, 0.5, "NoRx"), (2, 3, None, 0.5, "NoRx"), (2, 4, 5, 0.5, "NoRx"), (3, 1, None, 0.5, "NoRx")], months.schema)
    assert {r.person_id: r.fitted_slope for r in features.month_features(odd, S).collect()} == {1: 0.0, 2: 2.0, 3: 0.0}
