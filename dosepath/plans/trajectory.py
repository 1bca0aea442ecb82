"""The trajectory run: eras to phenotypes, clusters and summaries."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from dosepath.config import Settings
from dosepath.operators import cluster, cohort, events, features, grid, intervals, validity
from dosepath.plans import sinks
from dosepath.plans.staging import dealt, stage
from dosepath.schemas import FEATURES, WINDOWS

PERSON_COLUMNS = ("person_id", "trajectory_cluster", "discontinuation_phenotype", *FEATURES, "disc_evaluable", *(f"dominant_state_w{w}" for w in WINDOWS))


def relational(eras: DataFrame, observation: DataFrame, death: DataFrame | None, s: Settings, *, rows: int | None = None) -> dict[str, DataFrame]:
    """The relational part of a run: eligible, clipped, person_month_summary, era_events, persons.

    Eligibility and clipped eras feed several branches, so each is staged once;
    the branches after them are lazy.  ``rows``: about how many ``eras`` has, by which tasks are made.
    """
    chosen = intervals.focused(eras, s.focus_ingredients)
    eligible = stage(cohort.eligible(chosen, observation, death, washout_days=s.washout_days, followup_months=s.followup_months, rows=rows), "eligible")
    clipped = stage(intervals.clipped_eras(chosen, eligible, rows=rows), "clipped")
    n = s.followup_months * eligible.count() + clipped.count()  # staged: from the files' footers
    months = grid.month_states(eligible, clipped, s, n=n)
    flagged = events.era_events(clipped, s, n=n)
    persons = features.phenotyped(features.person_features(eligible, months, flagged, s), s)
    return {"eligible": eligible, "clipped": clipped, "person_month_summary": months, "era_events": flagged, "persons": persons}


def run(
    eras: DataFrame,
    observation: DataFrame,
    death: DataFrame | None,
    ingredients: DataFrame,
    s: Settings,
    *,
    label: str = "run",
    fixed_k: int | None = None,
    out: str | None = None,
    rows: int | None = None,
) -> dict[str, Any]:
    """A whole run; ``out`` writes the seven results and the silhouette grid there; ``rows`` as of ``relational``.

    The month table, events and persons are staged, too, so aggregates, the
    iterations of k-means and callers read tables instead of running a plan again.
    Persons and their clusters are made in tasks by the number of months and events.
    """
    part = relational(eras, observation, death, s, rows=rows)
    eligible, clipped = part["eligible"], part["clipped"]
    months, flagged = stage(part["person_month_summary"], "months"), stage(part["era_events"], "events")
    n = months.count() + flagged.count()  # staged: from the files' footers
    persons = stage(features.phenotyped(features.person_features(eligible, dealt(months, n, "person_id"), dealt(flagged, n, "person_id"), s), s), "persons")
    found = cluster.clustered(persons, k_grid=s.k_grid, final_k=s.final_k, fixed_k=fixed_k, seed=s.seed)
    final = stage(cluster.with_clusters(dealt(persons, n, "person_id"), dealt(found.assigned, n, "person_id")).select(*PERSON_COLUMNS), "final")
    results: dict[str, Any] = {
        "eligible": eligible,
        "eras": clipped.drop("index_date", "censor_date"),
        "person_month_summary": months,
        "era_events": flagged,
        "final_person": final,
        "cluster_summary": cluster.cluster_summary(final),
        "top_ingredients": cluster.top_ingredients(final, months, ingredients, s.top_ingredients),
    }
    if out is not None:
        sinks.write_results(results, out, label)
        sinks.write_csv(final.sparkSession, [(label, k, v) for k, v in found.grid], "label string, k int, silhouette double", f"{out}/{label}_silhouette_grid.csv")
    return results


def run_omop(tables: Mapping[str, Any], s: Settings, *, sensitivity: bool = False, out: str | None = None) -> dict[str, Any]:
    """Primary run on standardised tables; with ``sensitivity`` also one on eras made from exposures, and their comparison."""
    names = tables["ingredients"].withColumnRenamed("ingredient_name", "concept_name")
    primary = run(tables["drug_era"], tables["observation_period"], tables["death"], names, s, label="drug_era_primary", out=out, rows=tables["drug_era"].count())
    results: dict[str, Any] = {"primary": primary}
    if sensitivity:
        n = tables["drug_exposure"].count()
        eras = intervals.exposure_eras(tables["drug_exposure"], tables["concept"], tables["concept_ancestor"], s.exposure_gap_days, rows=n)
        other = run(eras, tables["observation_period"], tables["death"], names, s, label="drug_exposure_sensitivity", out=out, rows=n)
        results |= {"exposure": other, "comparison": validity.compared_runs(primary["final_person"], other["final_person"])}
        if out is not None:
            results["comparison"].write.mode("overwrite").parquet(f"{out}/primary_vs_exposure_sensitivity.parquet")
    return results
