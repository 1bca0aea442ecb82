"""Registered queries of the prescription-trajectory engine and their DuckDB oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from dosepath.config import Settings
from dosepath.functions.columns import atc_ingredient_id, md5_id
from dosepath.operators import cluster, cohort, events, features, grid, intervals, layout, lloyd, validity
from dosepath.oracles import _MEANS, _PROFILE, ORACLES
from dosepath.plans import external, trajectory
from dosepath.plans.staging import shared_dir, stage
from dosepath.schemas import FEATURES, STATES, WINDOWS
from dosepath.sources import omop, registers, testdata

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Six ingredients seldom overlap, so three count as many here.
SETTINGS = Settings(polypharmacy_threshold=3)
FOCUS = (1000001, 1000003)
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, names, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) + F.lit(0.0) for n in names})  # + 0.0: no negative zero


def _joined_set(df: DataFrame) -> DataFrame:
    return df.withColumn("active_set", F.array_join(F.col("active_set").cast("array<string>"), ","))


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    eras, observation, death = testdata.inputs(spark, sf_dir, staged=False)
    return cohort.eligible(eras, observation, death, washout_days=SETTINGS.washout_days, followup_months=SETTINGS.followup_months, rows=testdata.n_items(spark, sf_dir))


def _relational(eras: DataFrame, observation: DataFrame, death: DataFrame) -> dict[str, DataFrame]:
    return trajectory.relational(eras, observation, death, SETTINGS, rows=eras.count())  # staged: from the files' footers


def _run(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _relational(*testdata.inputs(spark, sf_dir))


def _clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = stage(testdata.shipments(spark, sf_dir), "shipped")
    eras = stage(testdata.eras(spark, sf_dir, shipped=shipped), "eras")  # the index date and the eras themselves
    rows = eras.count()  # from the files' footers
    eligible = cohort.eligible(eras, testdata.observation(spark, sf_dir, shipped), testdata.deaths(spark, sf_dir, shipped), washout_days=SETTINGS.washout_days, followup_months=SETTINGS.followup_months, rows=rows)
    return intervals.clipped_eras(eras, eligible, rows=rows)


def _months(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The month grid and the months of clipped eras."""
    run = _run(spark, sf_dir)
    return grid.month_grid(run["eligible"], SETTINGS.followup_months), grid.era_months(run["clipped"], SETTINGS.followup_months)


@query
def standardised_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures as a raw file has them (text, British dates, another name of the person) and cast again."""
    text = lambda c: F.date_format(c, "dd/MM/yyyy").alias(c)
    rows = testdata.exposures(spark, sf_dir)
    raw = rows.select(F.col("person_id").cast("string").alias("eid"), F.col("drug_concept_id").cast("string").alias("drug_concept_id"), text("drug_exposure_start_date"), text("drug_exposure_end_date"), F.concat("days_supply", F.lit(".0")).alias("days_supply"), (F.col("days_supply") / 2).cast("string").alias("quantity"))
    eras, observation, death = testdata.inputs(spark, sf_dir, staged=False)
    names = {"era_start_date": "drug_era_start_date", "era_end_date": "drug_era_end_date"}
    tables = {"drug_era": eras.withColumnsRenamed(names), "drug_exposure": raw, "observation_period": observation, "death": death, "concept": testdata.concepts(spark, sf_dir), "concept_ancestor": testdata.ancestors(spark, sf_dir)}
    return omop.standardised(tables, british_dates=True)["drug_exposure"]


def _external(spark: SparkSession, sf_dir: str) -> str:
    """An external folder of the adapter's eras, described, and of observation periods and deaths."""
    folder = f"{shared_dir(spark)}/external-{uuid.uuid4().hex[:12]}"
    eras, observation, death = testdata.inputs(spark, sf_dir, staged=False)
    kind = F.when(F.col("person_id") % 9 == 0, "acute_antibiotic")  # else as a table without it
    described = eras.withColumnsRenamed({"era_start_date": "drug_era_start_date", "era_end_date": "drug_era_end_date"}).withColumn("archetype", kind)
    for name, df in (("drug_era", described), ("observation_period", observation), ("death", death)):
        df.write.parquet(f"{folder}/{name.upper()}.parquet")
    return folder


@query
def external_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omop.external_eras(spark, _external(spark, sf_dir), fmt="parquet")


@query
def external_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run on an external folder with deaths, and whether its controls, chosen by archetype, are evaluable."""
    found = external.run(spark, _external(spark, sf_dir), SETTINGS, controls=["acute_antibiotic"], fixed_k=2)
    checked = found["negative_controls"]
    return spark.createDataFrame([(found["final_person"].count(), checked["n_violations"], checked["passed"])], "n_persons long, n_violations long, passed boolean")


@query
def exposure_end_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.imputed_exposures(testdata.exposures(spark, sf_dir))


@query
def ingredient_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.ingredient_map(testdata.concepts(spark, sf_dir), testdata.ancestors(spark, sf_dir))


@query
def exposure_ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.to_ingredients(exposure_end_imputation(spark, sf_dir), ingredient_map(spark, sf_dir))


@query
def exposure_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.same_start_deduped(exposure_ingredients(spark, sf_dir))


@query
def era_gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testdata.eras(spark, sf_dir)


@query
def era_gap_merge_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.raw_drug_eras(testdata.exposures(spark, sf_dir), rows=testdata.n_items(spark, sf_dir))


@query
def era_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = testdata.read(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("era_start_date")).distinct()
    merged = intervals.gap_merged(days.withColumn("era_end_date", F.col("era_start_date")), 1, keys=("user_id", "event_type"))
    return merged.select("user_id", "event_type", "era_start_date", "era_end_date", F.col("drug_exposure_count").alias("n_days"))


@query
def primary_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = testdata.eras(spark, sf_dir).withColumnsRenamed({"era_start_date": "drug_era_start_date", "era_end_date": "drug_era_end_date"})
    return intervals.primary_eras(source)


@query
def focus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.focused(testdata.eras(spark, sf_dir), FOCUS)


@query
def index_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.index_dates(testdata.eras(spark, sf_dir))


@query
def washout_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.washout_candidates(index_date(spark, sf_dir), testdata.observation(spark, sf_dir), SETTINGS.washout_days)


@query
def eligible_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.eligible(testdata.eras(spark, sf_dir), testdata.observation(spark, sf_dir), None, rows=testdata.n_items(spark, sf_dir))


@query
def eligible_cohort_death(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eligible(spark, sf_dir)


@query
def registry_observation_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("long")
    day = lambda start, n: F.date_add(F.lit(start).cast("date"), n.cast("int"))
    civil = testdata.read(spark, sf_dir, "customer").select(
        key.alias("person_id"),
        day("1960-01-15", key * 37 % 20000).alias("birth_date"),
        F.when(key % 5 == 0, day("2005-06-30", key % 1000)).alias("event_date"),
        F.when(key % 2 == 0, "u").otherwise("Emigration").alias("event_code"),
        F.when(key % 7 == 0, day("2010-01-01", key % 900)).alias("death_date"),
    )
    return registers.observation_periods(civil.drop("death_date"), civil.select("person_id", "death_date"))


@query
def pseudonymous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return testdata.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), md5_id(name).alias("person_id"), atc_ingredient_id(name).alias("ingredient_concept_id"))


@query
def clipped_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clipped(spark, sf_dir).drop("index_date", "censor_date")


@query
def month_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.month_grid(_eligible(spark, sf_dir), SETTINGS.followup_months)


@query
def month_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.month_overlap(*_months(spark, sf_dir))


@query
def month_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_set(grid.month_burden(*_months(spark, sf_dir)))


@query
def month_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, sf_dir)["person_month_summary"]
    return rounded(_joined_set(out).select("person_id", "month_index", "active_n", "prev_active_n", "active_set", "turnover"), ["turnover"])


@query
def month_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, sf_dir)["person_month_summary"]
    return rounded(out.select("person_id", "month_index", "active_n", "starts_n", "stops_n", "turnover", "state"), ["turnover"])


@query
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _run(spark, sf_dir)["person_month_summary"]
    return months.groupBy("person_id").agg(*[F.count(F.when(F.col("state") == x, 1)).alias(x) for x in STATES])


def _by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.month_features(_run(spark, sf_dir)["person_month_summary"], SETTINGS)


@query
def subwindow_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"mean_burden_w{w}" for w in WINDOWS]
    return rounded(_by_month(spark, sf_dir).select("person_id", *names), names)


@query
def subwindow_dominant_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_month(spark, sf_dir).select("person_id", *[f"dominant_state_w{w}" for w in WINDOWS])


@query
def maintenance_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.maintenance_tiers(_clipped(spark, sf_dir), SETTINGS)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.era_events(_clipped(spark, sf_dir), SETTINGS)


_INTERVAL = ("person_id", "ingredient_concept_id", "era_start_date", "era_end_date")


@query
def restart_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(*_INTERVAL, "era_number", "next_same_ingredient_start", "restarted_within_180d", "observed_for_restart_window")


@query
def switch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(*_INTERVAL, "switched_within_60d", "observed_for_switch_window")


@query
def early_discontinuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("era_row_key", "era_days", "maintenance_eligible", "early_discontinuation_90d")


@query
def burden_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["mean_active_n", "poly_month_prop", "mean_turnover", "burden_slope"]
    return rounded(_by_month(spark, sf_dir).select("person_id", *names), names)


@query
def era_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.era_features(_events(spark, sf_dir)).select("person_id", "n_ingredient_eras", "n_distinct_ingredients")


@query
def disc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.era_features(_events(spark, sf_dir)).where("n_maintenance_eras > 0").drop("n_ingredient_eras", "n_distinct_ingredients")
    return rounded(out, ["early_disc_90_rate", "restart_180_rate", "switch_60_rate", "is_single_era_maintenance"])


def _persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir)["persons"]


@query
def person_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_persons(spark, sf_dir).select("person_id", *FEATURES, "disc_evaluable"), FEATURES)


@query
def person_phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _persons(spark, sf_dir).select("person_id", "discontinuation_phenotype", *FEATURES, "disc_evaluable", *[f"dominant_state_w{w}" for w in WINDOWS])
    return rounded(out, FEATURES)


@query
def phenotype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.phenotype_counts(_persons(spark, sf_dir))


@query
def negative_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    controls = testdata.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("person_id")).where("person_id % 9 = 0")
    return validity.negative_controls(_persons(spark, sf_dir), controls)


@query
def primary_vs_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eras of a 30-day gap against eras of a 60-day gap on the same exposures."""
    other = _relational(*testdata.inputs(spark, sf_dir, 60))["persons"]
    out = validity.compared_runs(_persons(spark, sf_dir), other)
    return rounded(out, [c for c in out.columns if c.startswith(("mean_", "early_"))])


@query
def turnover_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validity.turnover_profile(_run(spark, sf_dir)["person_month_summary"]), ["zero_share", "mean", "stddev", "q10", "q25", "q50", "q75", "q90"])


@query
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.null_audit(_persons(spark, sf_dir), ["is_single_era_maintenance", "dominant_state_w4", "mean_active_n"])


@query
def phenotype_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.crosstab(_persons(spark, sf_dir), "discontinuation_phenotype", "dominant_state_w1", STATES)


@query
def phenotype_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.cluster_summary(_persons(spark, sf_dir), by="discontinuation_phenotype"), _MEANS)


@query
def phenotype_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validity.centroids(_persons(spark, sf_dir), "discontinuation_phenotype", _PROFILE), _PROFILE, 3)


@query
def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validity.anova(_persons(spark, sf_dir), "discontinuation_phenotype", _PROFILE)
    return rounded(rounded(out.select("feature", "f_value", "eta_squared"), ["eta_squared"]), ["f_value"], 4)


@query
def archetype_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validity.prevalence(_persons(spark, sf_dir), "discontinuation_phenotype"), ["share"])


@query
def dominant_ingredient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.dominant_ingredient(_clipped(spark, sf_dir))


@query
def top_ingredients_by_phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    return cluster.top_ingredients(run["persons"], run["person_month_summary"], testdata.ingredients(spark, sf_dir), 3, by="discontinuation_phenotype")


@query
def standardised_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What k-means reads: all features of evaluable persons, standardised and of unit length."""
    rows = cluster.scaled(_persons(spark, sf_dir)).select("person_id", vector_to_array("features_cosine").alias("u"))
    return rounded(rows.select("person_id", *[F.get("u", F.lit(i)).alias(f"u_{n}") for i, n in enumerate(FEATURES)]), [f"u_{n}" for n in FEATURES])


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A falling curve (k, value): squares of l_quantity within k groups of equal width, for k from 2 to 7."""
    items = testdata.read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("q"))
    low, high = items.agg(F.min("q"), F.max("q")).first()
    group = F.least(F.col("k") - 1, F.floor((F.col("q") - low) * F.col("k") / (high - low)))
    groups = items.select("q", F.explode(F.sequence(F.lit(2), F.lit(7))).alias("k")).groupBy("k", group.alias("g")).agg(F.count("*").alias("n"), F.var_pop("q").alias("v"))
    return groups.groupBy("k").agg(F.sum(F.col("n") * F.col("v")).alias("value"))


@query
def kneedle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.kneedle(_curve(spark, sf_dir)), ["bend"])


@query
def second_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.second_differences(_curve(spark, sf_dir)), ["second_difference"], 3)


@query
def phenotype_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validity.adjusted_rand_index(_persons(spark, sf_dir).fillna("", ["dominant_state_w1"]), "discontinuation_phenotype", "dominant_state_w1"), ["ari"])


def _full(spark: SparkSession, sf_dir: str, s: Settings = SETTINGS, fixed_k: int | None = 4) -> dict:
    eras, observation, death = testdata.inputs(spark, sf_dir)
    return trajectory.run(eras, observation, death, testdata.ingredients(spark, sf_dir), s, fixed_k=fixed_k, rows=eras.count())


@query
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir)["final_person"]


def _labelled(persons: DataFrame) -> DataFrame:
    """Persons with labels that SQL can make too, in place of fitted clusters: evaluable persons in turn, but for every eleventh."""
    assigned = persons.where("disc_evaluable and person_id % 11 <> 0").select("person_id", (F.col("person_id") % 4).cast("int").alias(cluster.CLUSTER))
    return cluster.with_clusters(persons, assigned)


@query
def labelled_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(_persons(spark, sf_dir)).select("person_id", cluster.CLUSTER)


@query
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.cluster_summary(_labelled(_persons(spark, sf_dir))), _MEANS)


@query
def top_ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir)
    return cluster.top_ingredients(_labelled(run["persons"]), run["person_month_summary"], testdata.ingredients(spark, sf_dir), 3)


@query
def feasible_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(cluster.feasible_k(_persons(spark, sf_dir)),)], "k long")


@query
def label_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosine silhouette of the labels."""
    persons = stage(_persons(spark, sf_dir), "persons")
    rows = cluster.scaled(persons).select("person_id", "features_cosine")
    labels = _labelled(persons).select("person_id", cluster.CLUSTER).where(F.col(cluster.CLUSTER) >= 0)
    found = cluster.silhouette(rows.join(labels, "person_id"), SETTINGS.seed)
    return rounded(spark.createDataFrame([(found,)], "silhouette double"), ["silhouette"])


@query
def scaled_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validity.scaled_centroids(_persons(spark, sf_dir), "discontinuation_phenotype", _PROFILE), ["mean", "scaled"])


@query
def anova_p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.anova_p_values(validity.anova(_persons(spark, sf_dir), "discontinuation_phenotype", _PROFILE))


@query
def dispensing_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispensings with estimated supply, merged to eras."""
    items = testdata.shipments(spark, sf_dir)
    volume = F.when(F.col("l_linenumber") == 7, F.lit(None)).when(F.col("l_linenumber") == 6, F.lit(0.5)).otherwise(F.col("l_quantity"))
    dispensed = items.select(F.col("person_id").cast("string").alias("pnr"), F.date_format("shipped", "yyyy-MM-dd").alias("eksd"), F.concat(F.lit("N06AB"), F.lpad((F.col("l_partkey") % 20).cast("string"), 2, "0")).alias("atc"), volume.alias("volume"))
    rows = registers.dispensing_exposures(dispensed, atc_prefixes=("N06AB0",))
    return intervals.gap_merged(rows, 30, rows=testdata.n_items(spark, sf_dir)).select("person_id", "ingredient_concept_id", "era_start_date", "era_end_date", "drug_exposure_count")


def _sales(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(users, doses) of return flags: items of odd lines are men's, others women's."""
    sex = F.when(F.col("l_linenumber") % 2 == 1, "Male").otherwise("Kvinder")
    items = testdata.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("atc_group"), F.year("l_shipdate").alias("year"), sex.alias("sex")).agg(F.sum("l_quantity").cast("double").alias("ddd"), F.count_distinct("l_orderkey").cast("double").alias("n"))
    names = ["atc_group", "year", "sex"]
    return items.select(*names, F.col("n").alias("value")), items.select(*names, F.col("ddd").alias("value"))


@query
def sales_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validity.sales_volumes(*_sales(spark, sf_dir), 1995), ["volume", "index_to_base", "year_share"])


@query
def sales_share_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ["A", "N", "R"]
    return rounded(validity.share_pivot(validity.sales_volumes(*_sales(spark, sf_dir), 1995), groups), [f"share_{g}" for g in groups])


@query
def sales_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validity.sales_changes(*_sales(spark, sf_dir)), ["base_volume", "recent_volume", "change_all", "change_men", "change_women"], 5)


@query
def turnover_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketched quantiles of turnover: whether each rank is within the error of its share, as counted over all months."""
    months = stage(_run(spark, sf_dir)["person_month_summary"].select("turnover"), "turnover")
    found = validity.sketched_quantiles(months, "turnover", QUANTILES)
    within = (F.col("p") >= F.col("rank_low") - 0.005) & (F.col("p") <= F.col("rank_high") + 0.005)
    n = F.lit(months.where("turnover is not null").count()).cast("long")
    return found.select("p", n.alias("n_months"), within.alias("within_error"))


@query
def era_gap_merge_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods in which a supplier ships; suppliers of many items are merged in pieces."""
    start = F.to_date("l_shipdate")
    items = testdata.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("l_suppkey"), start.alias("s"), F.date_add(start, (F.col("l_quantity") % 3).cast("int")).alias("e"))
    return intervals.gap_merged(items, 1, keys=("l_suppkey",), start="s", end="e", hot_rows=600, rows=testdata.n_items(spark, sf_dir))


def _standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(cluster.scaled(_persons(spark, sf_dir)).select("person_id", vector_to_array("features_scaled").alias("z"), vector_to_array("features_cosine").alias("u")), "standard")


@query
def neighbour_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons on a plane where neighbours stay near each other."""
    return layout.neighbour_layout(_standard(spark, sf_dir), "u", keep=["person_id"], seed=SETTINGS.seed)


@query
def lloyd_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all k after five rounds, from the first k persons' vectors, advanced together."""
    rows = _standard(spark, sf_dir)
    first = [r.u for r in rows.orderBy("person_id").limit(4).collect()]
    models = lloyd.advanced(rows, "u", [np.array(first[:k]) for k in (2, 3, 4)], rounds=5, tolerance=-1.0) if len(first) == 4 else []
    found = lloyd.measured(rows, "u", [m.centres for m in models]) if models else []
    out = [(len(n), i, int(n[i]), float(cost[i])) for n, _, cost, _ in found for i in range(len(n)) if n[i]]
    return rounded(spark.createDataFrame(out, "k int, cluster int, n_people long, inertia double"), ["inertia"], 5)


@query
def index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of k-means refitted on standardised rows, the best of ten starts of each k."""
    return spark.createDataFrame(validity.index_table(_standard(spark, sf_dir), "z", range(2, 7), seed=SETTINGS.seed), "k int, inertia double, calinski_harabasz double, davies_bouldin double")


@query
def sales_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a return flag as doses of a group, their orders as its users."""
    items = testdata.read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("atc_group"), F.year("l_shipdate").alias("year"), F.col("l_linestatus").alias("sex")).agg(F.sum("l_quantity").alias("ddd"), F.count_distinct("l_orderkey").cast("double").alias("n"))
    names = ["atc_group", "year", "sex"]
    out = validity.sales_measures(items.select(*names, F.col("n").alias("value")), items.select(*names, F.col("ddd").alias("value")), 1995)
    return rounded(out, ["ddd_per_patient_year", "index_to_base", "year_share"])


def _unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(cluster.scaled(_persons(spark, sf_dir)).select("person_id", "features_cosine"), "unit")


@query
def silhouette_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster.silhouette_grid(_unit_rows(spark, sf_dir), SETTINGS.k_grid, SETTINGS.seed)
    return spark.createDataFrame([("testdata", k, s) for k, s, _ in found], "label string, k int, silhouette double")


@query
def bisecting_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(cluster.bisecting_grid(_unit_rows(spark, sf_dir), 6, SETTINGS.seed), "k int, wssse double")


@query
def internal_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch, db = validity.cluster_indices(_persons(spark, sf_dir).where("disc_evaluable"), "discontinuation_phenotype", _PROFILE)
    return rounded(spark.createDataFrame([(ch, db)], "calinski_harabasz double, davies_bouldin double"), ["calinski_harabasz", "davies_bouldin"], 5)
