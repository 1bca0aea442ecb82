"""Eligibility: index date, washout, observation period and censoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dosepath.plans.staging import dealt


def index_dates(eras: DataFrame) -> DataFrame:
    """Each person's first era start."""
    return eras.groupBy("person_id").agg(F.min("era_start_date").alias("index_date"))


def washout_candidates(index: DataFrame, observation: DataFrame, washout_days: int) -> DataFrame:
    """Observation periods that hold the index date after at least ``washout_days``."""
    start, end = F.col("observation_period_start_date"), F.col("observation_period_end_date")
    both = index.join(observation.select("person_id", start, end), "person_id")
    return both.where((F.col("index_date") >= start) & (F.col("index_date") <= end) & (F.datediff("index_date", start) >= washout_days))


def single_deaths(death: DataFrame) -> DataFrame:
    """The earliest death date of each person."""
    return death.where("death_date is not null").groupBy("person_id").agg(F.min("death_date").alias("death_date"))


def eligible(eras: DataFrame, observation: DataFrame, death: DataFrame | None, *, washout_days: int = 365, followup_months: int = 24, rows: int | None = None) -> DataFrame:
    """One row an eligible person: index_date, the observation period that ends last (ties: starts first), censor_date.

    The period is picked by max_by-like aggregation, so candidates of a person
    are combined before and after one shuffle on the person.  ``rows``: about how many
    ``eras`` has, by which tasks are made; first starts and deaths are dealt when they are
    one row a person.
    """
    candidates = washout_candidates(dealt(index_dates(eras), rows, "person_id"), dealt(observation, rows, "person_id"), washout_days)
    start, end = "observation_period_start_date", "observation_period_end_date"
    latest = F.max(F.struct(F.col(end), (-F.datediff(F.col(start), F.lit("1970-01-01").cast("date"))).alias("k"), F.col(start))).alias("p")
    picked = candidates.groupBy("person_id", "index_date").agg(latest).select("person_id", "index_date", F.col(f"p.{start}").alias(start), F.col(f"p.{end}").alias(end))
    horizon = F.date_sub(F.add_months("index_date", followup_months), 1)
    if death is None:
        out = picked.withColumn("censor_date", F.least(end, horizon))
    else:
        out = picked.join(dealt(single_deaths(death), rows, "person_id"), "person_id", "left").withColumn("censor_date", F.least(end, horizon, "death_date"))
    return out.where("censor_date >= index_date")
