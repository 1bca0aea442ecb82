"""Post-hoc reports on a person table: elbow, silhouettes, indices, importance, profiles, sensitivity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from dosepath.config import Settings
from dosepath.operators import cluster, layout, validity
from dosepath.plans import sinks, trajectory
from dosepath.plans.staging import stage
from dosepath.schemas import FEATURES_LEGACY


def prepared(final: DataFrame, names: Sequence[str] = FEATURES_LEGACY) -> tuple[DataFrame, DataFrame]:
    """(clustered persons with nulls as 0, null counts by column)."""
    rows = final.where(F.col("trajectory_cluster") >= 0)
    return rows.withColumn("disc_evaluable", F.lit(True)).fillna(0, list(names)), validity.null_audit(rows, names)


def components(final: DataFrame, k: int = 2, names: Sequence[str] = FEATURES_LEGACY) -> DataFrame:
    """person_id, trajectory_cluster and the first ``k`` principal components pc_1.. of the scaled features."""
    rows = cluster.scaled(prepared(final, names)[0], names)
    out = PCA(k=k, inputCol="features_scaled", outputCol="pc").fit(rows).transform(rows).withColumn("pc", vector_to_array("pc"))
    return out.select("person_id", "trajectory_cluster", *[F.col("pc")[i].alias(f"pc_{i + 1}") for i in range(k)])


def neighbour_components(final: DataFrame, k: int = 2, names: Sequence[str] = FEATURES_LEGACY, *, seed: int = 42) -> DataFrame:
    """person_id, trajectory_cluster and coordinates at_1 .. that keep neighbours of the unit vectors near each other."""
    unit = cluster.scaled(prepared(final, names)[0], names).select("person_id", "trajectory_cluster", vector_to_array("features_cosine").alias("u"))
    return layout.neighbour_layout(stage(unit, "unit"), "u", keep=["person_id", "trajectory_cluster"], dims=k, seed=seed)


def report(final: DataFrame, out: str, *, max_k: int = 8, seed: int = 42, names: Sequence[str] = FEATURES_LEGACY) -> dict[str, list[tuple]]:
    """Write and return the elbow, second differences, silhouettes, indices, importances and profiles as small CSV tables."""
    spark = final.sparkSession
    rows, _ = prepared(final, names)
    unit = stage(cluster.scaled(rows.drop("trajectory_cluster"), names), "unit")
    elbow = cluster.bisecting_grid(unit, max_k, seed)
    curve = spark.createDataFrame(elbow, "k int, value double")
    found: dict[str, tuple[str, list[tuple]]] = {
        "wssse": ("k int, wssse double", elbow),
        "second_difference": ("k int, second_difference double", [tuple(r) for r in cluster.second_differences(curve).orderBy("k").collect()]),
        "kneedle": ("k int, bend double", [tuple(r) for r in cluster.kneedle(curve).collect()]),
    }
    silhouettes = [(k, s) for k, s, _ in cluster.silhouette_grid(unit, range(2, max_k + 1), seed)]
    standard = stage(unit.select(vector_to_array("features_scaled").alias("z")), "standard")
    indices = validity.index_table(standard, "z", range(2, max_k + 1), seed=seed)  # refitted, on rows that are not of unit length
    found["silhouette"] = ("k int, silhouette double", silhouettes)
    found["indices"] = ("k int, inertia double, calinski_harabasz double, davies_bouldin double", indices)
    importance = validity.anova(rows, "trajectory_cluster", names).orderBy(F.desc("eta_squared"), "feature")
    found["importance"] = ("feature string, f_value double, eta_squared double, df_between long, df_within long", [tuple(r) for r in importance.collect()])
    profile = validity.centroids(rows, "trajectory_cluster", names).orderBy("trajectory_cluster")
    found["profile"] = ("trajectory_cluster int, " + ", ".join(f"{n} double" for n in names), [(r[0], *map(float, r[1:])) for r in profile.collect()])
    for name, (schema, data) in found.items():
        sinks.write_csv(spark, data, schema, f"{out}/{name}.csv")
    return {name: data for name, (_, data) in found.items()}


def sensitivity(eras: DataFrame, observation: DataFrame, death: DataFrame | None, s: Settings, *, thresholds: Sequence[int] = (4, 5, 6), days: Sequence[int] = (28, 56, 84), k: int = 4) -> tuple[dict[tuple[int, int], DataFrame], dict]:
    """Clusterings over a grid of polypharmacy thresholds and maintenance days, and the adjusted Rand index of each two."""
    cells: dict[tuple[int, int], DataFrame] = {}
    rows = eras.count()
    for p in thresholds:
        for d in days:
            persons = stage(trajectory.relational(eras, observation, death, s.having(polypharmacy_threshold=p, maintenance_min_total_days=d), rows=rows)["persons"], "cell")
            cells[p, d] = stage(cluster.with_clusters(persons, cluster.clustered(persons, k_grid=(k,), fixed_k=k, seed=s.seed).assigned).select("person_id", "trajectory_cluster"), "cell")
    return cells, ari_matrix(cells)


def ari_matrix(cells: Mapping) -> dict:
    """Adjusted Rand index of each two labellings of the same persons."""
    out = {}
    names = list(cells)
    for i, a in enumerate(names):
        for b in names[i:]:
            both = cells[a].withColumnRenamed("trajectory_cluster", "a").join(cells[b].withColumnRenamed("trajectory_cluster", "b"), "person_id")
            out[a, b] = out[b, a] = validity.adjusted_rand_index(both, "a", "b").collect()[0].ari
    return out
