"""Acceptance on a synthetic cohort, post-hoc reports and spreadsheet blocks."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dosepath.config import Settings
from dosepath.operators import intervals, validity
from dosepath.plans import posthoc, trajectory
from dosepath.plans.staging import stage
from dosepath.sources import blocks, synthetic

N = 2000


@pytest.fixture(scope="module")
def cohort(spark):
    eras, observed, person = synthetic.cohort(spark, N, seed=42)
    return stage(eras, "eras"), observed, person


@pytest.fixture(scope="module")
def results(spark, cohort):
    concept, _ = synthetic.vocabulary(spark)
    names = concept.selectExpr("concept_id as ingredient_concept_id", "concept_name")
    return trajectory.run(intervals.primary_eras(cohort[0]), cohort[1], None, names, Settings(k_grid=(2, 4), final_k=4))


def test_archetypes_have_their_weights(cohort):
    assert cohort[2].count() == N
    shares = {r.archetype: r.n_people / N for r in validity.prevalence(cohort[0], "archetype").collect()}
    total = sum(a[0] for a in synthetic.ARCHETYPES.values())
    for name, (weight, *_) in synthetic.ARCHETYPES.items():
        assert abs(shares.get(name, 0.0 if name != "no_psychiatric_rx" else weight / total) - weight / total) < 0.03
    assert cohort[0].where("drug_era_end_date < drug_era_start_date").count() == 0


def test_draws_do_not_depend_on_partitions_or_size(spark, cohort):
    few = synthetic.cohort(spark, 50, seed=42)[0]
    assert sorted(map(str, few.collect())) == sorted(map(str, cohort[0].where("person_id <= 50").collect()))
    assert sorted(map(str, few.collect())) != sorted(map(str, synthetic.cohort(spark, 50, seed=43)[0].collect()))


def test_negative_controls_do_not_leak(cohort, results):
    controls = cohort[0].where(F.col("archetype") == synthetic.CONTROLS).select("person_id")
    got = validity.validate_negative_controls(results["final_person"], controls)
    assert got["passed"] and controls.distinct().count() > 0.1 * N


def test_phenotype_shares_are_near_the_published_ones(results):
    counts = {r.discontinuation_phenotype: r.n_people for r in validity.phenotype_counts(results["final_person"]).collect()}
    total = sum(counts.values())
    published = {"Insufficient prescribing history": 310, "Persistent stable use": 162, "Intermittent stop-start": 156, "Early drop-off / de-intensification": 79, "High-turnover switching": 41, "Stable polypharmacy": 40, "Mixed transition pattern": 0}
    for name, n in published.items():
        assert abs(counts[name] / total - n / 788) < 0.05, (name, counts[name] / total, n / 788)


def test_every_evaluable_person_is_clustered(results):
    final = results["final_person"]
    assert {r[0] for r in final.where("disc_evaluable").select("trajectory_cluster").distinct().collect()} == {0, 1, 2, 3}
    assert final.where("not disc_evaluable and trajectory_cluster <> -1").count() == 0
    severe = results["cluster_summary"].orderBy(F.desc("mean_active_n")).first()
    assert severe.mean_active_n > 3 and severe.poly_month_prop > 0.4 and severe.mean_turnover < 0.2


def test_reports(spark, results, tmp_path):
    got = posthoc.report(results["final_person"], str(tmp_path), max_k=4)
    assert [k for k, _ in got["wssse"]] == [2, 3, 4] and got["wssse"][0][1] > got["wssse"][-1][1]
    assert len(got["importance"]) == 23 and all(0 <= r[2] <= 1 for r in got["importance"])
    assert all(-1 <= s <= 1 for _, s in got["silhouette"]) and len(got["profile"]) == 4
    assert spark.read.option("header", True).csv(f"{tmp_path}/indices.csv").count() == 3
    pcs = posthoc.components(results["final_person"])
    assert pcs.columns == ["person_id", "trajectory_cluster", "pc_1", "pc_2"] and abs(pcs.agg(F.avg("pc_1")).first()[0]) < 1e-6


def test_sensitivity_grid(spark, cohort):
    eras = intervals.primary_eras(cohort[0].where("person_id <= 400"))
    cells, ari = posthoc.sensitivity(eras, cohort[1], None, Settings(), thresholds=(5,), days=(56, 84), k=2)
    assert len(cells) == 2 and ari[(5, 56), (5, 56)] == 1.0 and -1 <= ari[(5, 56), (5, 84)] <= 1


SHEET = """Some title,,,
"ATC code: N05A (Antipsychotics)",,,
Search variable,,,
,2019,2020,
,,,
a,,,
b,,,
Male,1.5,-,
Women,">99%",4,
,,,
ATC code: Search variable,,,
"ATC code: N06A (Antidepressants, all)",,,
x,,,
,2019,2020,
,,,
,,,
,,,
mænd,7,8,
kvinder,9,10,
"""


def test_spreadsheet_blocks(spark, tmp_path):
    (tmp_path / "s.csv").write_text(SHEET)
    got = {(r.atc_group, r.year, r.sex): r.value for r in blocks.parse(blocks.read_rows(spark, f"{tmp_path}/s.csv")).collect()}
    assert got == {("N05A", 2019, "Male"): 1.5, ("N05A", 2020, "Male"): None, ("N05A", 2019, "Women"): None, ("N05A", 2020, "Women"): 4.0, ("N06A", 2019, "mænd"): 7.0, ("N06A", 2020, "mænd"): 8.0, ("N06A", 2019, "kvinder"): 9.0, ("N06A", 2020, "kvinder"): 10.0}
    (tmp_path / "bad.csv").write_text(SHEET.replace("Male,", "Total,"))
    with pytest.raises(PySparkException):
        blocks.parse(blocks.read_rows(spark, f"{tmp_path}/bad.csv")).collect()
