"""Common-data-model sources: delimited or Parquet tables with declared schemas."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from dosepath import schemas
from dosepath.functions.columns import lenient_date
from dosepath.operators import intervals
from dosepath.operators.cohort import single_deaths

TABLES = ("drug_era", "drug_exposure", "observation_period", "concept", "concept_ancestor", "death")


def read_table(spark: SparkSession, path: str, *, sep: str = ",") -> DataFrame:
    """A CSV (gzip too) or Parquet table with lower-case names.

    CSV columns are read as text and cast where they are used: no inference pass.
    """
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).option("sep", sep).csv(path)
    return df.toDF(*[c.lower() for c in df.columns])


def optional_table(spark: SparkSession, path: str, **kw: Any) -> DataFrame | None:
    """The table, or None where the path does not exist."""
    try:
        return read_table(spark, path, **kw)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load_tables(spark: SparkSession, raw: Mapping[str, Any]) -> dict[str, Any]:
    """The tables that a configuration names; a separator may be set for each file; ``death`` is optional."""
    base = str(raw["paths"]["omop_dir"]).rstrip("/")
    files, csv = raw.get("files", {}), raw.get("csv", {})
    seps = {"concept": csv.get("concept_sep", ","), "concept_ancestor": csv.get("concept_ancestor_sep", csv.get("concept_sep", ",")), **csv.get("sep", {})}
    out: dict[str, Any] = {}
    for name in TABLES:
        path = f"{base}/{files.get(name, name + '.csv')}"
        read = optional_table if name == "death" else read_table
        out[name] = read(spark, path, sep=seps.get(name, ","))
    out["have_death"] = out["death"] is not None
    return out


def standardised(tables: Mapping[str, Any], *, british_dates: bool = False) -> dict[str, Any]:
    """Cast and pruned tables: ids are longs, dates dates (bad ones null), rows without needed dates or with an end before the start are dropped.

    ``eid`` is a person id; deaths are one a person; concepts are drug ingredients.
    """
    date = lambda c: lenient_date(F.col(c), british=british_dates).alias(c)
    long = lambda c: F.col(c).cast("long").alias(c)

    def person(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("eid", "person_id") if "person_id" not in df.columns else df

    era, exposure = person(tables["drug_era"]), person(tables["drug_exposure"])
    observed = person(tables["observation_period"])
    out: dict[str, Any] = {"have_death": tables.get("death") is not None}
    eras = era.select(long("person_id"), long("ingredient_concept_id"), date("drug_era_start_date"), date("drug_era_end_date"), long("drug_exposure_count"), long("gap_days"))
    out["drug_era"] = intervals.primary_eras(eras).where("era_start_date is not null and era_end_date >= era_start_date")
    out["drug_exposure"] = exposure.select(
        long("person_id"), long("drug_concept_id"), date("drug_exposure_start_date"), date("drug_exposure_end_date"), F.col("days_supply").cast("double").cast("int").alias("days_supply"), F.col("quantity").cast("double").alias("quantity")
    ).where("drug_exposure_start_date is not null")
    out["observation_period"] = observed.select(long("person_id"), date("observation_period_start_date"), date("observation_period_end_date")).dropna()
    out["death"] = single_deaths(person(tables["death"]).select(long("person_id"), date("death_date"))) if out["have_death"] else None
    concept = tables["concept"]
    out["concept"] = concept.select(long("concept_id"), "concept_name", "domain_id", "concept_class_id")
    out["ingredients"] = out["concept"].where("domain_id = 'Drug' and concept_class_id = 'Ingredient'").select(F.col("concept_id").alias("ingredient_concept_id"), F.col("concept_name").alias("ingredient_name"))
    out["concept_ancestor"] = tables["concept_ancestor"].select(long("ancestor_concept_id"), long("descendant_concept_id"))
    return out


def vocabulary(spark: SparkSession, path: str, *, sep: str = ",") -> DataFrame:
    """(ingredient_concept_id, concept_name) of a concept file; an empty table where it is absent."""
    found = optional_table(spark, path, sep=sep)
    if found is None:
        return spark.createDataFrame([], schemas.INGREDIENT)
    return found.select(F.col("concept_id").cast("long").alias("ingredient_concept_id"), "concept_name")


def find_table(spark: SparkSession, folder: str, name: str, fmt: str) -> str | None:
    """Path of ``name`` in a folder whatever its case, through the file system Spark reads with."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    wanted = {f"{name}.{fmt}", f"{name}.{fmt}.gz"}
    for status in fs.listStatus(at):
        if status.getPath().getName().lower() in wanted:
            return status.getPath().toString()
    return None


#: Columns that describe an era and their value where an external table has none (fixed values).
DESCRIPTION = {"ingredient_name": None, "atc_group": None, "archetype": "external_omop"}


def _with_columns(spark: SparkSession, path: str, needed: set[str]) -> DataFrame:
    """The table at ``path``; raises ValueError that names every needed column it lacks."""
    df = read_table(spark, path)
    if gone := sorted(needed - set(df.columns)):
        raise ValueError(f"{path} lacks columns: {', '.join(gone)}")
    return df


def external_eras(spark: SparkSession, folder: str, *, fmt: str = "csv", gap_days: int = 30) -> DataFrame:
    """Eras of an external data model: drug_era, or (absent or empty) eras made from drug_exposure.

    drug_exposure_count and gap_days default to 1 and 0; the columns of DESCRIPTION
    are carried where the table has them; other needed columns must be there.
    """
    path = find_table(spark, folder, "drug_era", fmt)
    if path is not None:
        df = _with_columns(spark, path, {"person_id", "drug_era_start_date", "drug_era_end_date"})
        ingredient = "ingredient_concept_id" if "ingredient_concept_id" in df.columns else "drug_concept_id"
        if ingredient not in df.columns:
            raise ValueError(f"{path} lacks columns: drug_concept_id")
        if not df.isEmpty():
            default = lambda c, v: F.coalesce(F.col(c).cast("long"), F.lit(v)) if c in df.columns else F.lit(v)
            told = lambda c, v: F.coalesce(F.col(c).cast("string"), F.lit(v)) if c in df.columns else F.lit(v).cast("string")
            return df.select(
                F.col("person_id").cast("long"),
                F.col(ingredient).cast("long").alias("ingredient_concept_id"),
                lenient_date(F.col("drug_era_start_date")).alias("era_start_date"),
                lenient_date(F.col("drug_era_end_date")).alias("era_end_date"),
                default("drug_exposure_count", 1).cast("long").alias("drug_exposure_count"),
                default("gap_days", 0).cast("long").alias("gap_days"),
                *[told(c, v).alias(c) for c, v in DESCRIPTION.items()],
            ).where("era_start_date is not null and era_end_date >= era_start_date")
    path = find_table(spark, folder, "drug_exposure", fmt)
    if path is None:
        raise FileNotFoundError(f"neither drug_era nor drug_exposure in {folder}")
    df = _with_columns(spark, path, {"person_id", "drug_concept_id", "drug_exposure_start_date"})
    start = lenient_date(F.col("drug_exposure_start_date"))
    end = lenient_date(F.col("drug_exposure_end_date")) if "drug_exposure_end_date" in df.columns else start
    rows = df.select(F.col("person_id").cast("long"), F.col("drug_concept_id").cast("long"), start.alias("drug_exposure_start_date"), end.alias("drug_exposure_end_date"))
    return intervals.raw_drug_eras(rows, gap_days, rows=rows.count()).withColumns({c: F.lit(v).cast("string") for c, v in DESCRIPTION.items()})


def external_observation(spark: SparkSession, folder: str, *, fmt: str = "csv") -> DataFrame:
    """Observation periods of an external data model; the table and its three columns must be there."""
    path = find_table(spark, folder, "observation_period", fmt)
    if path is None:
        raise FileNotFoundError(f"no observation_period in {folder}")
    dates = ("observation_period_start_date", "observation_period_end_date")
    df = _with_columns(spark, path, {"person_id", *dates})
    return df.select(F.col("person_id").cast("long"), *[lenient_date(F.col(c)).alias(c) for c in dates]).dropna()


def external_persons(spark: SparkSession, folder: str, *, fmt: str = "csv") -> DataFrame | None:
    """Persons of an external data model, or None where it has no such table; birth year and gender default to 1970 and 0 where their columns are absent."""
    path = find_table(spark, folder, "person", fmt)
    if path is None:
        return None
    df = _with_columns(spark, path, {"person_id"})
    number = lambda c, v: (F.col(c) if c in df.columns else F.lit(v)).cast("int").alias(c)
    return df.select(F.col("person_id").cast("long"), number("year_of_birth", 1970), number("gender_concept_id", 0))


def external_deaths(spark: SparkSession, folder: str, *, fmt: str = "csv") -> DataFrame | None:
    """Deaths of an external data model, one a person (the earliest), or None where it has no such table."""
    path = find_table(spark, folder, "death", fmt)
    if path is None:
        return None
    df = _with_columns(spark, path, {"person_id", "death_date"})
    return single_deaths(df.select(F.col("person_id").cast("long"), lenient_date(F.col("death_date")).alias("death_date")))
