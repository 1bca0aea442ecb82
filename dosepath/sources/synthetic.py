"""A synthetic cohort of prescribing archetypes, made on the executors.

Every draw is a hash of (seed, person, what is drawn), so a person's records do
not depend on partitions or on the number of persons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Ingredients of the vocabulary stub (fixed values).
DRUGS = {
    700001: "sertraline",
    700002: "escitalopram",
    700010: "haloperidol",
    700011: "risperidone",
    700020: "diazepam",
    700030: "zolpidem",
    700040: "metoprolol",
    700050: "amoxicillin",
    700060: "lamotrigine",
}
#: Archetypes (fixed values): weight, number of eras, days of the first and of later eras, gap days, ATC group, drug,
#: drugs besides as (drug, days from the index or from the last era's end, days).
ARCHETYPES = {
    "N06A_persistent": (0.09, (1, 1), (300, 730), (300, 730), (0, 0), "N06A", 700001, ()),
    "N06A_early_dropoff": (0.11, (1, 1), (14, 90), (14, 90), (0, 0), "N06A", 700002, ()),
    "N06A_intermittent": (0.10, (2, 4), (60, 180), (60, 180), (30, 150), "N06A", 700001, ()),
    "N06A_early_then_restart": (0.06, (2, 2), (21, 75), (120, 250), (200, 300), "N06A", 700001, ()),
    "N06A_switch": (0.05, (1, 1), (180, 260), (180, 260), (0, 0), "N06A", 700001, ((700002, (10, 55), (180, 360)),)),
    "N05A_stable": (0.03, (1, 1), (270, 730), (270, 730), (0, 0), "N05A", 700010, ()),
    "N05A_intermittent": (0.02, (2, 3), (90, 270), (90, 270), (30, 120), "N05A", 700011, ()),
    "N05B_acute": (0.04, (1, 2), (7, 30), (7, 30), (30, 180), "N05B", 700020, ()),
    "N05C_intermittent": (0.05, (1, 3), (14, 90), (14, 90), (30, 180), "N05C", 700030, ()),
    "polypharmacy_escalating": (0.06, (1, 1), (270, 730), (270, 730), (0, 0), "N06A", 700001, ((700010, (90, 180), (180, 540)), (700040, (0, 60), (270, 730)))),
    "polypharmacy_severe": (0.04, (1, 1), (720, 760), (720, 760), (0, 0), "N06A", 700001, tuple((d, (0, 0), (720, 760)) for d in (700010, 700020, 700040, 700060))),
    "acute_antibiotic": (0.15, (1, 3), (5, 10), (5, 10), (60, 365), "J01", 700050, ()),
    "no_psychiatric_rx": (0.22, (0, 0), (0, 0), (0, 0), (0, 0), None, None, ()),
}
SWITCHING = "N06A_switch"  # its drug besides starts from the last era's end
CONTROLS = "acute_antibiotic"
RANGE = "struct<lo:int,hi:int>"
TABLE = (
    f"archetype string, low double, high double, n_eras {RANGE}, first {RANGE}, later {RANGE}, gap {RANGE}, atc_group string, drug bigint, after_end boolean, "
    f"besides array<struct<drug:bigint,from:{RANGE},days:{RANGE}>>"
)


def archetype_table(spark: SparkSession) -> DataFrame:
    total, at, rows = sum(a[0] for a in ARCHETYPES.values()), 0.0, []
    for name, (weight, *ranges, atc, drug, besides) in ARCHETYPES.items():
        rows.append((name, at / total, (at + weight) / total, *ranges, atc, drug, name == SWITCHING, list(besides)))
        at += weight
    rows[-1] = (*rows[-1][:2], 1.1, *rows[-1][3:])
    return spark.createDataFrame(rows, TABLE)


def _uniform(seed: int, *what: Column | str) -> Column:
    """A number in 0 .. 1 that the seed, the person and ``what`` decide."""
    keys = [F.lit(seed), F.col("person_id"), *[F.lit(w) if isinstance(w, str) else w for w in what]]
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _between(span: Column, seed: int, *what: Column | str) -> Column:
    return (span["lo"] + F.floor(_uniform(seed, *what) * (span["hi"] - span["lo"] + 1))).cast("int")


def persons(spark: SparkSession, n: int = 1000, *, seed: int = 42, followup_months: int = 24) -> DataFrame:
    """Persons with demographics, index date, observation period and archetype."""
    rows = spark.range(1, n + 1).withColumnRenamed("id", "person_id")
    rows = rows.withColumn("index_date", F.date_add(F.lit("2020-01-01").cast("date"), F.floor(_uniform(seed, "index") * 365).cast("int")))
    rows = rows.select(
        "person_id",
        (F.lit(1940) + F.floor(_uniform(seed, "birth") * 51)).cast("int").alias("year_of_birth"),
        F.when(_uniform(seed, "gender") < 0.5, 8507).otherwise(8532).alias("gender_concept_id"),
        "index_date",
        F.date_sub("index_date", 365).alias("observation_period_start_date"),
        F.date_add("index_date", followup_months * 30).alias("observation_period_end_date"),
        _uniform(seed, "archetype").alias("_u"),
    )
    table = F.broadcast(archetype_table(spark))  # thirteen rows
    return rows.join(table, (F.col("_u") >= F.col("low")) & (F.col("_u") < F.col("high"))).drop("_u", "low", "high")


def eras(people: DataFrame, *, seed: int = 42) -> DataFrame:
    """drug_era rows of ``people``, cut at the end of observation."""
    index, end = F.col("index_date"), F.col("observation_period_end_date")
    n = _between(F.col("n_eras"), seed, "n")
    era = "array<struct<start:date,end:date,k:int>>"
    none = F.struct(index.alias("at"), index.alias("last"), F.array().cast(era).alias("eras"))

    def step(acc: Column, k: Column) -> Column:
        days = F.when(k == 0, _between(F.col("first"), seed, "days", k)).otherwise(_between(F.col("later"), seed, "days", k))
        stop = F.date_add(acc["at"], days)
        one = F.struct(acc["at"].alias("start"), stop.alias("end"), k.cast("int").alias("k"))
        return F.struct(F.date_add(stop, _between(F.col("gap"), seed, "gap", k) + 1).alias("at"), stop.alias("last"), F.concat(acc["eras"], F.array(one)).alias("eras"))

    made = people.withColumn("_made", F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), none, step)))
    own = F.transform("_made.eras", lambda e: F.struct(F.col("drug").alias("drug"), e["start"].alias("start"), e["end"].alias("end"), F.col("archetype").alias("archetype"), F.col("atc_group").alias("atc_group")))

    def besides(b: Column) -> Column:
        start = F.date_add(F.when(F.col("after_end"), F.col("_made.last")).otherwise(index), _between(b["from"], seed, "from", b["drug"]))
        label = F.concat("archetype", F.when(F.col("after_end"), F.lit("_switch_target")).otherwise(F.lit("_additional")))
        atc = F.when(F.col("after_end"), F.col("atc_group")).otherwise(F.lit("polypharmacy_additional"))
        return F.struct(b["drug"].alias("drug"), start.alias("start"), F.date_add(start, _between(b["days"], seed, "more", b["drug"])).alias("end"), label.alias("archetype"), atc.alias("atc_group"))

    rows = made.where("_made is not null").select("person_id", end, F.explode(F.concat(own, F.transform("besides", besides))).alias("e"))
    names = F.create_map(*[F.lit(x) for kv in DRUGS.items() for x in kv])
    drug = F.col("e.drug")
    return rows.where(F.col("e.start") <= end).select(
        "person_id",
        drug.alias("drug_concept_id"),
        drug.alias("ingredient_concept_id"),
        names[drug.cast("int")].alias("ingredient_name"),
        F.col("e.atc_group").alias("atc_group"),
        F.col("e.archetype").alias("archetype"),
        F.col("e.start").alias("drug_era_start_date"),
        F.least("e.end", end).alias("drug_era_end_date"),
        (1 + F.floor(_uniform(seed, "count", drug, F.datediff("e.start", F.lit("2020-01-01").cast("date"))) * 4)).cast("long").alias("drug_exposure_count"),
        F.lit(0).cast("long").alias("gap_days"),
    )


def cohort(spark: SparkSession, n: int = 1000, *, seed: int = 42, followup_months: int = 24) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(drug_era, observation_period, person)."""
    people = persons(spark, n, seed=seed, followup_months=followup_months)
    observed = people.select("person_id", "observation_period_start_date", "observation_period_end_date")
    return eras(people, seed=seed), observed, people.select("person_id", "year_of_birth", "gender_concept_id")


def vocabulary(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(concept, concept_ancestor) stubs: the ingredients, each its own ancestor."""
    concept = spark.createDataFrame([(i, n, "Drug", "Synthetic", "Ingredient", "S", str(i)) for i, n in DRUGS.items()], "concept_id bigint, concept_name string, domain_id string, vocabulary_id string, concept_class_id string, standard_concept string, concept_code string")
    same = concept.select(F.col("concept_id").alias("ancestor_concept_id"), F.col("concept_id").alias("descendant_concept_id"), F.lit(0).alias("min_levels_of_separation"), F.lit(0).alias("max_levels_of_separation"))
    return concept, same
