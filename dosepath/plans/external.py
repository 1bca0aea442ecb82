"""External data models: their tables exported as Parquet with a configuration, and runs on them."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from dosepath import schemas
from dosepath.config import Settings
from dosepath.operators import validity
from dosepath.plans import trajectory
from dosepath.sources import omop

FILES = {"drug_era": "drug_era.parquet", "observation_period": "observation_period.parquet", "person": "person.parquet", "concept": "CONCEPT.csv", "concept_ancestor": "concept_ancestor.csv", "drug_exposure": "omop_drug_exposure.csv.gz", "death": "omop_death.csv.gz"}
ANALYSIS = ("washout_days", "followup_months", "exposure_gap_days", "maintenance_min_total_days", "early_discontinuation_days", "restart_window_days", "switch_window_days", "polypharmacy_threshold", "turnover_low", "turnover_high")


def configuration(label: str, folder: str, s: Settings, *, deaths: bool = False) -> dict[str, Any]:
    """A configuration of a run on the tables that ``export`` wrote to ``folder``, with its deaths or without."""
    values = asdict(s)
    return {
        "project": {"name": f"trajectories-external-{label}", "output_dir": f"./outputs/external_{label}"},
        "paths": {"omop_dir": folder},
        "files": FILES | ({"death": "death.parquet"} if deaths else {}),
        "csv": {"concept_sep": ","},
        "analysis": {k: values[k] for k in ANALYSIS},
        "clustering": {"k_grid": list(s.k_grid), "seed": s.seed},
        "run": {"run_exposure_sensitivity": False, "save_top_ingredients_per_cluster": s.top_ingredients},
    }


def export(spark: SparkSession, folder: str, out: str, *, fmt: str = "csv", gap_days: int = 30, deaths: bool = False) -> dict[str, str]:
    """Write eras, observation periods and (where there are any) persons, with ``deaths`` also deaths, of an external folder to ``out``; returns the paths.

    Eras have the names of the data model (drug_era_start_date, drug_concept_id), so that
    ``external_eras`` with fmt="parquet" reads them again.
    """
    eras = omop.external_eras(spark, folder, fmt=fmt, gap_days=gap_days)
    names = {"era_start_date": "drug_era_start_date", "era_end_date": "drug_era_end_date"}
    tables = {
        "drug_era": eras.withColumn("drug_concept_id", eras["ingredient_concept_id"]).withColumnsRenamed(names),
        "observation_period": omop.external_observation(spark, folder, fmt=fmt),
        "person": omop.external_persons(spark, folder, fmt=fmt),
        "death": omop.external_deaths(spark, folder, fmt=fmt) if deaths else None,
    }
    paths = {}
    for name, df in tables.items():
        if df is not None:
            paths[name] = f"{out.rstrip('/')}/{name}.parquet"
            df.write.mode("overwrite").parquet(paths[name])
    return paths


def run(spark: SparkSession, folder: str, s: Settings, *, fmt: str = "parquet", ingredients: DataFrame | None = None, controls: Collection[str] = (), deaths: bool = True, **kw: Any) -> dict[str, Any]:
    """A whole run on an external folder; ``kw`` as of ``trajectory.run``.

    Deaths are of the folder's table, where it has one and ``deaths`` is set.  Persons with an
    era of an archetype in ``controls`` are negative controls: the result's ``negative_controls``
    has whether none of them is evaluable, as ``validity.validate_negative_controls`` tells.
    """
    described = omop.external_eras(spark, folder, fmt=fmt, gap_days=s.exposure_gap_days)
    named = ingredients if ingredients is not None else spark.createDataFrame([], schemas.INGREDIENT)
    death = omop.external_deaths(spark, folder, fmt=fmt) if deaths else None
    out = trajectory.run(described.drop(*omop.DESCRIPTION), omop.external_observation(spark, folder, fmt=fmt), death, named, s, **{"rows": described.count()} | kw)
    if controls:
        persons = described.where(F.col("archetype").isin(list(controls))).select("person_id")
        out["negative_controls"] = validity.validate_negative_controls(out["final_person"], persons)
    return out
