"""Validation, comparison and profile operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from dosepath.operators import lloyd
from dosepath.schemas import PHENOTYPES


def negative_controls(phenotypes: DataFrame, controls: DataFrame) -> DataFrame:
    """Control persons that are evaluable: each is a violation."""
    return phenotypes.where("disc_evaluable").join(controls.select("person_id").distinct(), "person_id", "left_semi").select("person_id", "discontinuation_phenotype")


def validate_negative_controls(phenotypes: DataFrame, controls: DataFrame, show: int = 100) -> dict:
    """{passed, n_violations, violations}: the count is of all, the list of the first ``show``."""
    found = negative_controls(phenotypes, controls)
    n = found.count()
    return {"passed": n == 0, "n_violations": n, "violations": [r["person_id"] for r in found.orderBy("person_id").limit(show).collect()]}


def compared_runs(primary: DataFrame, other: DataFrame) -> DataFrame:
    """Persons of two runs side by side, and whether their phenotype is the same."""
    kept = {"trajectory_cluster": "cluster", "discontinuation_phenotype": "phenotype", "mean_active_n": "mean_active_n", "mean_turnover": "mean_turnover", "early_disc_90_rate": "early_disc_90_rate"}
    side = lambda df, tag: df.select(F.col("person_id").alias("pid"), *[F.col(c).alias(f"{n}_{tag}") for c, n in kept.items() if c in df.columns])
    both = side(primary, "primary").join(side(other, "exposure"), "pid")
    return both.withColumn("same_phenotype", (F.col("phenotype_primary") == F.col("phenotype_exposure")).cast("int"))


def turnover_profile(months: DataFrame, low: float = 0.2, high: float = 0.5) -> DataFrame:
    """One row: months, zero and non-zero turnover, moments, quantiles and bands."""
    t = F.col("turnover")
    n = lambda cond: F.count(F.when(cond, 1))
    return months.agg(
        F.count("*").alias("n_months"),
        n(t == 0).alias("n_zero"),
        n(t > 0).alias("n_nonzero"),
        F.avg(F.when(t == 0, 1.0).otherwise(0.0)).alias("zero_share"),
        F.avg(t).alias("mean"),
        F.stddev_samp(t).alias("stddev"),
        F.min(t).alias("min"),
        F.max(t).alias("max"),
        *[F.percentile(t, p).alias(f"q{int(p * 100)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)],
        n((t > 0) & (t < low)).alias("n_low"),
        n((t >= low) & (t < high)).alias("n_mid"),
        n(t >= high).alias("n_high"),
        F.count_distinct(F.when((t > 0) & (t < low), t)).alias("n_distinct_low"),
    )


def null_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls) by one aggregate, turned into rows."""
    one = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])).alias("r")).select("r.*")


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence) -> DataFrame:
    """Contingency counts with a column n_<i> for each of the known levels."""
    return df.groupBy(row).agg(*[F.count(F.when(F.col(column) == v, 1)).alias(f"n_{i}") for i, v in enumerate(levels)])


def centroids(df: DataFrame, by: str, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Rounded means by group."""
    return df.groupBy(by).agg(*[F.round(F.avg(c), digits).alias(c) for c in columns])


def scaled_centroids(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, feature, mean, scaled): group means, scaled to 0..1 across groups."""
    means = df.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])
    long = means.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("mean")) for c in columns])).alias("r")).select(by, "r.*")
    w = Window.partitionBy("feature")
    spread = F.max("mean").over(w) - F.min("mean").over(w)
    return long.withColumn("scaled", F.when(spread > 0, (F.col("mean") - F.min("mean").over(w)) / spread).otherwise(0.0))


def anova(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(feature, f_value, eta_squared, df_between, df_within): one-way analysis of variance of each column.

    One aggregate by group; then a row for each group and feature.  A feature's nulls
    are left out of it.
    """
    own = df.groupBy(by).agg(*[x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))])
    long = own.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").alias("m"), F.col(f"v_{c}").alias("v")) for c in columns])).alias("r")).select("r.*").where("n > 0")
    sums = long.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.sum(F.col("n") * F.col("v")).alias("within"))
    sums = sums.withColumn("between", F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"))
    total = F.col("between") + F.col("within")
    f = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return sums.select("feature", F.when((F.col("within") > 0) & (F.col("k") > 1), f).alias("f_value"), F.when(total > 0, F.col("between") / total).otherwise(0.0).alias("eta_squared"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's rule."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny, key=abs)
    out = d
    for m in range(1, 10_000):
        before = out
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / max(1 + step * d, tiny, key=abs)
            c = max(1 + step / c, tiny, key=abs)
            out *= c * d
        if abs(out - before) <= 1e-15 * abs(out):
            break
    return out


def f_tail(f: float, between: int, within: int) -> float:
    """P(F >= f) of Fisher's distribution: the regularised incomplete beta function at within / (within + between f)."""
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    a, b, x = within / 2, between / 2, within / (within + between * f)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1 - math.exp(log_front) * _beta_fraction(b, a, 1 - x) / b


def anova_p_values(tested: DataFrame) -> DataFrame:
    """The rows of ``anova``, a row a feature, and ``p_value`` (null without an F value)."""
    names = [f.name for f in tested.schema]
    rows = [(*r, None if r["f_value"] is None else f_tail(r["f_value"], r["df_between"], r["df_within"])) for r in tested.collect()]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tested.schema) + ", p_value double"
    return tested.sparkSession.createDataFrame(rows, schema).select(*names, "p_value")


def dominant_ingredient(eras: DataFrame) -> DataFrame:
    """Each person's ingredient of the longest era; ties to the smaller id."""
    days = F.datediff("era_end_date", "era_start_date")
    return eras.groupBy("person_id").agg(F.max(F.struct(days.alias("d"), (-F.col("ingredient_concept_id")).alias("i"))).alias("m")).select("person_id", (-F.col("m.i")).alias("ingredient_concept_id"))


def adjusted_rand_index(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the agreement of two labellings, corrected for chance (1 where neither splits)."""
    cells = labels.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda df, name: df.select(F.lit(name).alias("of"), (F.col("n") * (F.col("n") - 1) / 2).alias("v"))
    sizes = pairs(cells, "both").unionByName(cells.select(F.lit("all").alias("of"), F.col("n").alias("v")))
    for name, c in (("rows", a), ("cols", b)):
        sizes = sizes.unionByName(pairs(cells.groupBy(c).agg(F.sum("n").alias("n")), name))
    total = lambda name: F.coalesce(F.sum(F.when(F.col("of") == name, F.col("v"))), F.lit(0.0)).alias(name)
    one = sizes.agg(*[total(n) for n in ("both", "all", "rows", "cols")])
    expected = F.col("rows") * F.col("cols") / F.nullif(F.col("all") * (F.col("all") - 1) / 2, F.lit(0.0))
    top = (F.col("rows") + F.col("cols")) / 2 - expected
    return one.select(F.when(top == 0, 1.0).otherwise((F.col("both") - expected) / top).alias("ari"))


def cluster_indices(rows: DataFrame, by: str, columns: Sequence[str]) -> tuple[float, float]:
    """(Calinski-Harabasz, Davies-Bouldin) of labelled rows by two aggregates; centroids, a row a cluster, are on the driver."""
    own = [r.asDict() for r in rows.groupBy(by).agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in columns]).collect()]
    k, n = len(own), sum(r["_n"] for r in own)
    if k < 2 or n <= k:
        return float("nan"), float("nan")
    means = {r[by]: [r[c] for c in columns] for r in own}
    centre = [sum(r["_n"] * r[c] for r in own) / n for c in columns]
    square: Column = sum((F.pow(F.col(c) - F.element_at(F.create_map(*[F.lit(x) for g, m in means.items() for x in (g, m[i])]), F.col(by)), 2.0) for i, c in enumerate(columns)), F.lit(0.0))
    spread = {r[by]: (r["s"], r["d"]) for r in rows.groupBy(by).agg(F.sum(square).alias("s"), F.avg(F.sqrt(square)).alias("d")).collect()}
    within = sum(s for s, _ in spread.values())
    between = sum(r["_n"] * sum((r[c] - m) ** 2 for c, m in zip(columns, centre, strict=True)) for r in own)
    far = lambda x, y: sum((p - q) ** 2 for p, q in zip(means[x], means[y], strict=True)) ** 0.5
    worst = [max((spread[x][1] + spread[y][1]) / far(x, y) for y in means if y != x) for x in means]
    return (between / (k - 1)) / (within / (n - k)) if within else float("inf"), sum(worst) / k


def index_table(rows: DataFrame, vector: str, ks: Sequence[int], *, n_init: int = 10, seed: int = 42) -> list[tuple[int, float, float, float]]:
    """(k, inertia, Calinski-Harabasz, Davies-Bouldin) of k-means refitted for each k, the best of ``n_init`` starts.

    ``rows`` (``vector``: array of doubles) should be a staged table: a round of all
    starts of all k is one scan, and so are the indices.
    """
    best = {k: models[0] for k, models in lloyd.restarted(rows, vector, ks, n_init=n_init, seed=seed).items()}
    out = []
    for (k, model), (n, total, squares, distances) in zip(best.items(), lloyd.measured(rows, vector, [m.centres for m in best.values()]) if best else [], strict=True):
        held = n > 0
        n, means, squares, away = n[held], total[held] / n[held, None], squares[held], distances[held] / n[held]
        if len(n) < 2 or n.sum() <= len(n):
            out.append((k, model.cost, math.nan, math.nan))
            continue
        between = (n * ((means - total.sum(axis=0) / n.sum()) ** 2).sum(axis=1)).sum()
        apart = np.sqrt(((means[:, None] - means[None]) ** 2).sum(axis=2))
        np.fill_diagonal(apart, np.inf)
        within = squares.sum()
        ch = (between / (len(n) - 1)) / (within / (n.sum() - len(n))) if within else math.inf
        out.append((k, model.cost, float(ch), float(((away[:, None] + away[None]) / apart).max(axis=1).mean())))
    return out


def prevalence(df: DataFrame, by: str) -> DataFrame:
    """Distinct persons of each group and their share of all."""
    counts = df.select("person_id", by).distinct().groupBy(by).agg(F.count("*").alias("n_people"))
    total = F.sum("n_people").over(Window.partitionBy())  # a row a group
    return counts.withColumn("share", F.col("n_people") / total)


def phenotype_counts(phenotypes: DataFrame) -> DataFrame:
    """Persons of every phenotype, those with none too."""
    return phenotypes.agg(*[F.count(F.when(F.col("discontinuation_phenotype") == p, 1)).alias(f"c{i}") for i, p in enumerate(PHENOTYPES)]).select(
        F.explode(F.array(*[F.struct(F.lit(p).alias("discontinuation_phenotype"), F.col(f"c{i}").alias("n_people")) for i, p in enumerate(PHENOTYPES)])).alias("r")
    ).select("r.*")


def sales_measures(users: DataFrame, doses: DataFrame, base_year: int) -> DataFrame:
    """Defined daily doses a patient-year by group and year, as an index of the base year (100) and a share of the year's doses.

    users, doses: (atc_group, year, sex, value).
    """
    both = doses.withColumnRenamed("value", "ddd").join(users.withColumnRenamed("value", "n"), ["atc_group", "year", "sex"])
    both = both.groupBy("atc_group", "year").agg(F.avg(F.col("ddd") * 365 / F.nullif(F.col("n"), F.lit(0.0))).alias("ddd_per_patient_year"), F.sum("ddd").alias("ddd"))
    base = F.max(F.when(F.col("year") == base_year, F.col("ddd_per_patient_year"))).over(Window.partitionBy("atc_group"))
    return both.withColumn("index_to_base", F.col("ddd_per_patient_year") / base * 100).withColumn("year_share", F.col("ddd") / F.sum("ddd").over(Window.partitionBy("year")))


def sales_volumes(users: DataFrame, doses: DataFrame, base_year: int) -> DataFrame:
    """(atc_group, year, volume, index_to_base, year_share): mean doses of the sexes that have users too, as an index of the base year (100) and a share of the year."""
    both = doses.withColumnRenamed("value", "ddd").join(users.select("atc_group", "year", "sex"), ["atc_group", "year", "sex"], "left_semi")
    rows = both.groupBy("atc_group", "year").agg(F.avg("ddd").alias("volume"))
    base = F.max(F.when(F.col("year") == base_year, F.nullif(F.col("volume"), F.lit(0.0)))).over(Window.partitionBy("atc_group"))
    return rows.withColumn("index_to_base", F.col("volume") / base * 100).withColumn("year_share", F.col("volume") / F.sum("volume").over(Window.partitionBy("year")))


def share_pivot(volumes: DataFrame, groups: Sequence[str]) -> DataFrame:
    """A row a year and a column share_<group>: the groups' shares of the volume of all ``groups``; 0 where a group has none."""
    wide = volumes.where(F.col("atc_group").isin(list(groups))).groupBy("year").pivot("atc_group", list(groups)).agg(F.sum("volume")).fillna(0.0)
    total = F.nullif(sum((F.col(g) for g in groups), F.lit(0.0)), F.lit(0.0))
    return wide.select("year", *[(F.col(g) / total).alias(f"share_{g}") for g in groups])


def sales_changes(users: DataFrame, doses: DataFrame) -> DataFrame:
    """Each group's volume in the first and the last year of all, and its change in percent: of both sexes, men and women.

    Doses without users of the same group, year and sex are left out.  A change is null
    without both years or from nothing.
    """
    both = doses.withColumnRenamed("value", "ddd").join(users.select("atc_group", "year", "sex"), ["atc_group", "year", "sex"], "left_semi")
    ends = both.agg(F.min("year").alias("base"), F.max("year").alias("recent")).first()
    sex = F.lower("sex")
    parts = {"all": F.lit(True), "men": sex.startswith("m"), "women": sex.startswith("f") | sex.startswith("k")}
    at = {"base": F.col("year") == F.lit(ends.base), "recent": F.col("year") == F.lit(ends.recent)}
    sums = both.groupBy("atc_group").agg(*[F.avg(F.when(own & year, F.col("ddd"))).alias(f"{p}_{y}") for p, own in parts.items() for y, year in at.items()])
    change = lambda p: F.when(F.col(f"{p}_base") > 0, (F.col(f"{p}_recent") - F.col(f"{p}_base")) / F.col(f"{p}_base") * 100).alias(f"change_{p}")
    return sums.select("atc_group", F.lit(ends.base).cast("int").alias("base_year"), F.lit(ends.recent).cast("int").alias("recent_year"), F.col("all_base").alias("base_volume"), F.col("all_recent").alias("recent_volume"), *[change(p) for p in parts])


def sketched_quantiles(df: DataFrame, column: str, shares: Sequence[float], error: float = 0.005) -> DataFrame:
    """(p, value, rank_low, rank_high): quantiles from a mergeable sketch, and what share of rows lies below and at or below each.

    A value's rank is within ``error`` of p, whatever the number of distinct values;
    a task's sketch has about 1 / error entries.  Nulls are left out.
    """
    made = df.agg(F.percentile_approx(column, list(shares), math.ceil(1 / error)).alias("v")).first().v or [None] * len(shares)
    c, counts = F.col(column), []
    for v in made:
        counts += [F.count(F.when(c < F.lit(v), 1)), F.count(F.when(c <= F.lit(v), 1))]
    one = df.agg(F.count(c).alias("n"), F.array(*counts).alias("r"))
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")
    rows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(v).cast("double").alias("value"), (F.get("r", F.lit(2 * i)) / n).alias("rank_low"), (F.get("r", F.lit(2 * i + 1)) / n).alias("rank_high")) for i, (p, v) in enumerate(zip(shares, made, strict=True))])
    return one.select(F.inline(rows))
