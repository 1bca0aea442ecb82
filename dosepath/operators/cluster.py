"""K-means on cosine geometry: scaling, feasibility, sweep, silhouette, summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from dosepath.operators import lloyd
from dosepath.plans.staging import stage
from dosepath.schemas import FEATURES

CLUSTER = "trajectory_cluster"
UNCLUSTERED = -1
#: Parameters of the sample on which silhouettes are made where one is asked for; else they are of all rows.
SAMPLE_SHARE, SAMPLE_FLOOR = 0.15, 0.05


@dataclass
class Clustering:
    """Assignments (person_id, trajectory_cluster) of clustered persons, the k chosen (-1: none) and the silhouette of each k."""

    assigned: DataFrame
    k: int
    grid: list[tuple[int, float]] = field(default_factory=list)


def scaled(features: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """Evaluable persons with ``features_cosine``: standardised (mean 0, sample sd 1), then of unit length. Must not be empty."""
    rows = features.where("disc_evaluable").fillna(0, list(names))
    rows = VectorAssembler(inputCols=list(names), outputCol="features_raw", handleInvalid="keep").transform(rows)
    rows = StandardScaler(inputCol="features_raw", outputCol="features_scaled", withMean=True, withStd=True).fit(rows).transform(rows)
    return Normalizer(inputCol="features_scaled", outputCol="features_cosine", p=2.0).transform(rows)


def feasible_k(features: DataFrame, names: Sequence[str] = FEATURES) -> int:
    """The largest k that can be fitted: evaluable persons, distinct vectors at most; 0 without any."""
    rows = features.where("disc_evaluable").fillna(0, list(names))
    r = rows.groupBy(*names).agg(F.count("*").alias("n")).agg(F.count("*").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).collect()[0]
    return min(r["all"], max(1, r["distinct"]))


def silhouette(predicted: DataFrame, seed: int, *, sample_from: int | None = None) -> float:
    """Cosine silhouette of all rows; NaN with one cluster.

    With ``sample_from``, from that many rows on, a cluster c of n_c rows is sampled at
    max(floor, min(share * N / n_c, 1)), about an equal count of each cluster.
    """
    counts = {r[CLUSTER]: r["n"] for r in predicted.groupBy(CLUSTER).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return math.nan
    total = sum(counts.values())
    if sample_from is not None and total >= sample_from:
        predicted = predicted.sampleBy(CLUSTER, {c: max(SAMPLE_FLOOR, min(SAMPLE_SHARE * total / n, 1.0)) for c, n in counts.items()}, seed)
    return ClusteringEvaluator(featuresCol="features_cosine", predictionCol=CLUSTER, metricName="silhouette", distanceMeasure="cosine").evaluate(predicted)


#: Starts of each k; they are advanced in the same scans.
STARTS, ROUNDS = 4, 20


def _arrays(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_u", vector_to_array("features_cosine"))


def kmeans(rows: DataFrame, ks: Sequence[int], seed: int) -> dict[int, lloyd.Model]:
    """The best of ``STARTS`` models of each k; a round reads ``rows`` once for all of them."""
    found = lloyd.restarted(_arrays(rows), "_u", ks, n_init=STARTS, seed=seed, rounds=ROUNDS)
    return {k: models[0] for k, models in found.items()}


def with_nearest(rows: DataFrame, model: lloyd.Model) -> DataFrame:
    """``rows`` with the cluster of ``model``."""
    return model.labelled(_arrays(rows), "_u", CLUSTER).drop("_u")


def silhouette_grid(rows: DataFrame, k_grid: Sequence[int], seed: int, *, sample_from: int | None = None) -> list[tuple[int, float, lloyd.Model]]:
    """(k, silhouette, model) of each k; ``rows`` (person_id, features_cosine) should be a staged table.

    Silhouettes follow the rule of ``silhouette``, by two scans for all k.
    """
    models = kmeans(rows, k_grid, seed)
    share = None
    if models and sample_from is not None and sum((m := next(iter(models.values()))).n) >= sample_from:
        share = {k: np.maximum(SAMPLE_FLOOR, np.minimum(SAMPLE_SHARE * m.n.sum() / np.maximum(m.n, 1), 1.0)) for k, m in models.items()}
    found = lloyd.cosine_silhouettes(_arrays(rows), "_u", models, share=share, row=F.col("person_id"), seed=seed) if models else {}
    return [(k, found[k], models[k]) for k in models]


def clustered(features: DataFrame, *, k_grid: Sequence[int], final_k: int | None = None, fixed_k: int | None = None, seed: int = 42) -> Clustering:
    """Choose k and cluster the evaluable persons.

    fixed_k: that k, no silhouette; infeasible: nobody is clustered.  Else the k
    of the highest silhouette (lowest k on ties), replaced by final_k if feasible.
    """
    nobody = Clustering(features.where("disc_evaluable").select("person_id", F.lit(UNCLUSTERED).alias(CLUSTER)), UNCLUSTERED)
    most = feasible_k(features)
    grid = [k for k in k_grid if 2 <= k <= most]
    if not most or (fixed_k is not None and not 2 <= fixed_k <= most) or (fixed_k is None and not grid):
        return nobody
    rows = stage(scaled(features).select("person_id", "features_cosine"), "scaled")  # read by every k and by the lazy result
    if fixed_k is not None:
        model, k, found = kmeans(rows, [fixed_k], seed)[fixed_k], fixed_k, []
    else:
        swept = silhouette_grid(rows, grid, seed)
        found = [(k, s) for k, s, _ in swept]
        k, _, model = max(swept, key=lambda x: (-math.inf if math.isnan(x[1]) else x[1], -x[0]))
        if final_k is not None and final_k <= most and final_k != k:
            k, model = final_k, next((m for j, _, m in swept if j == final_k), None) or kmeans(rows, [final_k], seed)[final_k]
    return Clustering(with_nearest(rows, model).select("person_id", CLUSTER), k, found)


def with_clusters(features: DataFrame, assigned: DataFrame) -> DataFrame:
    """Features and trajectory_cluster, -1 for persons without one."""
    return features.join(assigned, "person_id", "left").withColumn(CLUSTER, F.coalesce(F.col(CLUSTER).cast("int"), F.lit(UNCLUSTERED)))


def cluster_summary(final: DataFrame, by: str = CLUSTER) -> DataFrame:
    """Persons and means of each group (clusters from 0 on)."""
    rows = final.where(F.col(by) >= 0) if by == CLUSTER else final
    means = ("mean_active_n", "poly_month_prop", "mean_turnover", "early_disc_90_rate", "restart_180_rate", "switch_60_rate")
    return rows.groupBy(by).agg(F.count("*").alias("n_people"), *[F.avg(c).alias(c) for c in means]).orderBy(by)


def top_ingredients(final: DataFrame, months: DataFrame, names: DataFrame, top: int = 10, by: str = CLUSTER) -> DataFrame:
    """The ingredients with most person-months in each group (-1 too); ties to the smaller id."""
    rows = final.select("person_id", by).join(months.select("person_id", F.explode("active_set").alias("ingredient_concept_id")), "person_id")
    counts = rows.groupBy(by, "ingredient_concept_id").agg(F.count("*").alias("cluster_month_count"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("cluster_month_count"), "ingredient_concept_id"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).join(names, "ingredient_concept_id", "left")


def bisecting_grid(rows: DataFrame, max_k: int, seed: int) -> list[tuple[int, float]]:
    """(k, within-cluster sum of squares) for k from 2 to ``max_k``, read off one divisive tree."""
    return [(k, cost) for k, cost in lloyd.divisive(_arrays(rows), "_u", max_k, seed=seed).curve if k > 1]


def kneedle(curve: DataFrame) -> DataFrame:
    """The elbow of a falling curve (k, value): the largest 1 - x - y on axes scaled to 0..1, ties to the smaller k."""
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a curve has few points
    scale = lambda c: (F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0))
    bent = curve.select(F.col("k").cast("double").alias("k"), F.col("value").cast("double").alias("value"))
    bent = bent.select("k", (1 - scale("k") - F.coalesce(scale("value"), F.lit(0.0))).alias("bend"))
    return bent.orderBy(F.desc("bend"), "k").limit(1).select(F.col("k").cast("int").alias("k"), "bend")


def second_differences(curve: DataFrame) -> DataFrame:
    """value[k-1] - 2 value[k] + value[k+1] for inner k."""
    w = Window.orderBy("k")
    out = curve.select("k", (F.lag("value").over(w) - 2 * F.col("value") + F.lead("value").over(w)).alias("second_difference"))
    return out.where("second_difference is not null")
