"""A raw common data model made on the executors, in the shape that ``omop.load_tables`` reads, and its files.

Every draw is a hash of (seed, person, what is drawn).  A person has one to three
ingredients and one to nineteen exposures of their products.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dosepath.operators import intervals
from dosepath.plans import sinks
from dosepath.plans.staging import stage
from dosepath.sources import synthetic

#: Ingredients and days of supply (fixed values).
INGREDIENTS = ("sertraline", "fluoxetine", "citalopram", "quetiapine", "risperidone", "olanzapine", "lithium", "valproate", "lorazepam", "diazepam")
SUPPLIES = (28, 30, 56, 84, 90)
FIRST_ID, PRODUCTS = 1_000_001, 3
DEATH_SHARE = 0.03
#: File of each table (fixed values).
FILES = {
    "observation_period": "omop_observation_period.csv.gz",
    "drug_exposure": "omop_drug_exposure.csv.gz",
    "drug_era": "omop_drug_era.csv.gz",
    "death": "omop_death.csv.gz",
    "concept": "CONCEPT.csv",
    "concept_ancestor": "concept_ancestor.csv",
}
CONCEPT = "concept_id bigint, concept_name string, domain_id string, vocabulary_id string, concept_class_id string, standard_concept string, concept_code string, valid_start_date string, valid_end_date string, invalid_reason string"
ANCESTOR = "ancestor_concept_id bigint, descendant_concept_id bigint, min_levels_of_separation int, max_levels_of_separation int"
VALID = ("1970-01-01", "2099-12-31")


def _draw(n: Column | int, seed: int, *what: Column | str) -> Column:
    """An integer in 0 .. n - 1."""
    n = n if isinstance(n, Column) else F.lit(n)
    keys = [F.lit(seed), F.col("person_id"), *[F.lit(w) if isinstance(w, str) else w for w in what]]
    return F.pmod(F.xxhash64(*keys), n.cast("long")).cast("int")


def observation_periods(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    first, last = F.lit("2000-01-01").cast("date"), F.lit("2022-12-31").cast("date")
    rows = spark.range(1, n + 1).withColumnRenamed("id", "person_id")
    start = F.date_add(first, _draw(F.datediff(F.lit("2015-01-01").cast("date"), first), seed, "start"))
    rows = rows.withColumn("observation_period_start_date", start)
    earliest = F.date_add("observation_period_start_date", 730)
    return rows.withColumn("observation_period_end_date", F.date_add(earliest, _draw(F.datediff(last, earliest), seed, "end")))


def drug_exposures(periods: DataFrame, seed: int = 42) -> DataFrame:
    start, end = F.col("observation_period_start_date"), F.col("observation_period_end_date")
    order = F.array_sort(F.array(*[F.struct(_draw(1 << 30, seed, "ingredient", F.lit(i)).alias("draw"), F.lit(FIRST_ID + i).cast("long").alias("id")) for i in range(len(INGREDIENTS))]))
    own = periods.withColumn("_own", F.slice(order["id"], F.lit(1), 1 + _draw(3, seed, "ingredients")))
    each = own.withColumn("_k", F.explode(F.sequence(F.lit(1), 1 + _draw(19, seed, "exposures"))))
    ingredient = F.get("_own", _draw(F.size("_own"), seed, "which", F.col("_k")))
    begun = F.date_add(start, _draw(F.greatest(F.lit(1), F.datediff(end, start) - 60), seed, "day", F.col("_k")))
    supply = F.get(F.array(*map(F.lit, SUPPLIES)), _draw(len(SUPPLIES), seed, "supply", F.col("_k")))
    return each.select(
        (F.col("person_id") * 32 + F.col("_k")).alias("drug_exposure_id"),
        "person_id",
        (ingredient * 100 + 1 + _draw(PRODUCTS, seed, "product", F.col("_k"))).alias("drug_concept_id"),
        begun.alias("drug_exposure_start_date"),
        F.least(F.date_add(begun, supply - 1), end).alias("drug_exposure_end_date"),
        F.lit(38_000_177).alias("drug_type_concept_id"),
        supply.alias("days_supply"),
        supply.cast("double").alias("quantity"),
    )


def drug_eras(exposures: DataFrame, ancestors: DataFrame, gap_days: int = 30) -> DataFrame:
    """Eras of the exposures' ingredients, every exposure counted, with ids that a person's order gives."""
    products = ancestors.where("min_levels_of_separation > 0").select(F.col("descendant_concept_id").alias("drug_concept_id"), F.col("ancestor_concept_id").alias("ingredient_concept_id"))
    rows = exposures.withColumnsRenamed({"drug_exposure_start_date": "era_start_date", "drug_exposure_end_date": "era_end_date"})
    merged = intervals.gap_merged(intervals.to_ingredients(rows, products), gap_days, distinct_starts=False)
    at = F.row_number().over(Window.partitionBy("person_id").orderBy("ingredient_concept_id", "era_start_date"))
    names = {"era_start_date": "drug_era_start_date", "era_end_date": "drug_era_end_date"}
    return merged.select((F.col("person_id") * 32 + at).alias("drug_era_id"), *intervals.KEYS, *[F.col(a).alias(b) for a, b in names.items()], "drug_exposure_count", "gap_days")


def deaths(periods: DataFrame, seed: int = 42) -> DataFrame:
    died = periods.where(_draw(1 << 20, seed, "died") < int(DEATH_SHARE * (1 << 20)))
    return died.select("person_id", F.date_sub("observation_period_end_date", _draw(365, seed, "death")).alias("death_date"))


def vocabulary(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(concept, concept_ancestor): each ingredient, its own ancestor, and its products."""
    concepts, ancestors = [], []
    for i, name in enumerate(INGREDIENTS):
        ingredient = FIRST_ID + i
        kinds = [(ingredient, name, "Ingredient", 0), *[(ingredient * 100 + k, f"{name} tablet", "Clinical Drug", 1) for k in range(1, PRODUCTS + 1)]]
        concepts += [(c, n, "Drug", "RxNorm", kind, "S", str(c), *VALID, None) for c, n, kind, _ in kinds]
        ancestors += [(ingredient, c, level, level) for c, _, _, level in kinds]
    return spark.createDataFrame(concepts, CONCEPT), spark.createDataFrame(ancestors, ANCESTOR)


def tables(spark: SparkSession, n: int = 5000, *, seed: int = 42, gap_days: int = 30) -> dict[str, DataFrame]:
    """The six tables of ``n`` persons."""
    periods = observation_periods(spark, n, seed)
    exposures = drug_exposures(periods, seed)
    concept, ancestor = vocabulary(spark)
    return {"observation_period": periods, "drug_exposure": exposures, "drug_era": drug_eras(exposures, ancestor, gap_days), "death": deaths(periods, seed), "concept": concept, "concept_ancestor": ancestor}


def write(spark: SparkSession, folder: str, n: int = 5000, *, seed: int = 42) -> dict[str, str]:
    """Write the tables' files to ``folder``; returns their paths."""
    made = tables(spark, n, seed=seed)
    made["drug_exposure"] = stage(made["drug_exposure"], "exposures")  # written, and merged to eras
    concept, ancestor = made["concept"], made["concept_ancestor"]
    made["drug_era"] = drug_eras(made["drug_exposure"], ancestor)
    made["concept"] = concept.coalesce(1).sortWithinPartitions("concept_id")
    return {name: sinks.write_named_csv(df, f"{folder.rstrip('/')}/{FILES[name]}") for name, df in made.items()}


def configuration(folder: str) -> dict[str, Any]:
    """What ``omop.load_tables`` needs to read the files that ``write`` made."""
    return {"paths": {"omop_dir": folder}, "files": dict(FILES), "csv": {"concept_sep": ","}}


def write_stub_vocabulary(spark: SparkSession, folder: str) -> dict[str, str]:
    """CONCEPT.csv and concept_ancestor.csv of the synthetic cohort's ingredients, each its own ancestor."""
    rows = [(i, n, "Drug", "Synthetic", "Ingredient", "S", f"SYN_{i}", *VALID, None) for i, n in sorted(synthetic.DRUGS.items())]
    frames = {"concept": spark.createDataFrame(rows, CONCEPT), "concept_ancestor": spark.createDataFrame([(r[0], r[0], 0, 0) for r in rows], ANCESTOR)}
    return {name: sinks.write_named_csv(df, f"{folder.rstrip('/')}/{FILES[name]}") for name, df in frames.items()}
