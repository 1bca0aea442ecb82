"""National dispensing and civil registers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dosepath.functions.columns import atc_ingredient_id, lenient_date, md5_id
from dosepath.operators import intervals
from dosepath.operators.cohort import single_deaths
from dosepath.sources.omop import read_table

EMIGRATION = ("U", "EM", "EMIGRATION")


def dispensing_exposures(dispensed: DataFrame, *, atc_prefixes: Sequence[str] = (), ddd_per_day: float = 1.0, default_supply_days: int = 30) -> DataFrame:
    """Intervals of (person, ingredient) from dispensings (pnr, eksd, atc, volume).

    Days of supply are the whole volume / ddd_per_day, or the default where the
    volume is null or not over 0; intervals that end before they start go, so a
    volume under one day's dose vanishes.
    """
    chosen: Column = F.lit(True)
    if atc_prefixes:
        chosen = F.lit(False)
        for p in atc_prefixes:
            chosen = chosen | F.col("atc").startswith(p)
    volume = F.col("volume").cast("double")
    supply = F.when(volume > 0, (volume / ddd_per_day).cast("int")).otherwise(F.lit(default_supply_days))
    start = lenient_date(F.col("eksd"))
    rows = dispensed.where(chosen).select(md5_id(F.col("pnr")).alias("person_id"), atc_ingredient_id(F.col("atc")).alias("ingredient_concept_id"), start.alias("era_start_date"), F.date_add(start, supply - 1).alias("era_end_date"))
    return rows.where("person_id is not null and era_start_date is not null and era_end_date >= era_start_date")


def register_eras(spark: SparkSession, path: str, *, atc_prefixes: Sequence[str] = (), gap_days: int = 30, ddd_per_day: float = 1.0, default_supply_days: int = 30) -> DataFrame:
    """Gap-merged eras of a dispensing register."""
    rows = dispensing_exposures(read_table(spark, path), atc_prefixes=atc_prefixes, ddd_per_day=ddd_per_day, default_supply_days=default_supply_days)
    return intervals.gap_merged(rows, gap_days)


def observation_periods(civil: DataFrame, death: DataFrame | None, *, registry_start: str = "1995-01-01", registry_end: str = "2023-12-31") -> DataFrame:
    """Observation from adulthood (18) to emigration, death or the register's end; empty ones go.

    civil: person_id, birth_date, event_date, event_code.
    """
    left = F.upper(F.trim("event_code")).isin(*EMIGRATION)
    persons = civil.groupBy("person_id").agg(F.min("birth_date").alias("born"), F.min(F.when(left, F.col("event_date"))).alias("left_on"))
    if death is not None:
        persons = persons.join(single_deaths(death), "person_id", "left")
    else:
        persons = persons.withColumn("death_date", F.lit(None).cast("date"))
    start = F.greatest(F.lit(registry_start).cast("date"), F.add_months("born", 18 * 12))
    end = F.least(F.lit(registry_end).cast("date"), "left_on", "death_date")
    out = persons.where("born is not null").select("person_id", start.alias("observation_period_start_date"), end.alias("observation_period_end_date"))
    return out.where("observation_period_end_date > observation_period_start_date")


def register_observation(spark: SparkSession, civil_path: str, death_path: str | None = None, *, registry_start: str = "1995-01-01", registry_end: str = "2023-12-31") -> tuple[DataFrame, DataFrame | None, bool]:
    """(observation_period, death, have_death) of civil and death registers."""
    civil = read_table(spark, civil_path).select(md5_id(F.col("pnr")).alias("person_id"), lenient_date(F.col("foed_dato")).alias("birth_date"), lenient_date(F.col("haend_dato")).alias("event_date"), F.col("haend_kode").alias("event_code"))
    death = None
    if death_path is not None:
        death = single_deaths(read_table(spark, death_path).select(md5_id(F.col("pnr")).alias("person_id"), lenient_date(F.col("dod_dato")).alias("death_date")))
    return observation_periods(civil, death, registry_start=registry_start, registry_end=registry_end), death, death is not None


def register_ingredients(eras: DataFrame) -> DataFrame:
    """(ingredient_concept_id, concept_name): the ids themselves as names."""
    return eras.select("ingredient_concept_id").distinct().withColumn("concept_name", F.col("ingredient_concept_id").cast("string"))
