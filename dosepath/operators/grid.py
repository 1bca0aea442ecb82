"""Monthly person-time grid, burden, turnover and states.

Eras are spread to the months they touch by arithmetic (no range join), and a
person's rows stay on one partitioning from the spread to the features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dosepath.config import Settings
from dosepath.functions.columns import jaccard_distance
from dosepath.plans.staging import dealt


def _month_start(index: Column, month: Column) -> Column:
    return F.add_months(index, month - 1)


def _month_end(index: Column, month: Column, censor: Column) -> Column:
    return F.least(F.date_sub(F.add_months(index, month), 1), censor)


def month_grid(eligible: DataFrame, followup_months: int = 24) -> DataFrame:
    """Months 1 to ``followup_months`` of each person that start by the censor date."""
    index, month, censor = F.col("index_date"), F.col("month_index"), F.col("censor_date")
    rows = eligible.select("person_id", "index_date", "censor_date", F.explode(F.sequence(F.lit(1), F.lit(followup_months))).alias("month_index"))
    rows = rows.select("person_id", "month_index", _month_start(index, month).alias("month_start"), _month_end(index, month, censor).alias("month_end"), "censor_date")
    return rows.where("month_start <= censor_date").drop("censor_date")


def era_months(clipped: DataFrame, followup_months: int = 24) -> DataFrame:
    """A row for each month that a clipped era touches, with started_flag and stopped_flag.

    add_months clamps month ends, so candidate months reach one further on each
    side of months_between and the exact overlap is tested.
    """
    index, month, censor = F.col("index_date"), F.col("month_index"), F.col("censor_date")
    low = F.greatest(F.lit(1), F.floor(F.months_between("era_start_date", index)).cast("int"))
    high = F.least(F.lit(followup_months), F.floor(F.months_between("era_end_date", index)).cast("int") + 2)
    rows = clipped.where(low <= high).withColumn("month_index", F.explode(F.sequence(low, high)))
    rows = rows.withColumn("month_start", _month_start(index, month)).withColumn("month_end", _month_end(index, month, censor))
    rows = rows.where("month_start <= censor_date and era_start_date <= month_end and era_end_date >= month_start")
    inside = lambda d: F.col(d).between(F.col("month_start"), F.col("month_end"))
    return rows.select(
        "person_id",
        "month_index",
        "ingredient_concept_id",
        F.when(inside("era_start_date"), 1).otherwise(0).alias("started_flag"),
        F.when(inside("era_end_date") & ~F.col("clipped_at_censor"), 1).otherwise(0).alias("stopped_flag"),
    )


def month_overlap(grid: DataFrame, months: DataFrame) -> DataFrame:
    """The grid with the eras of each month; a month without one keeps a row."""
    out = grid.select("person_id", "month_index").join(months, ["person_id", "month_index"], "left")
    return out.fillna(0, ["started_flag", "stopped_flag"])


def month_burden(grid: DataFrame, months: DataFrame, *, n: int | None = None) -> DataFrame:
    """Active ingredients, starts and stops of every month of the grid.

    The grid's rows join the eras' rows as a union, so months without an era
    need no outer join, and one exchange on the person serves this aggregate and
    everything after it.  ``n``: about how many rows both have, by which tasks are made.
    """
    none = F.lit(None).cast(months.schema["ingredient_concept_id"].dataType)
    empty = grid.select("person_id", "month_index", none.alias("ingredient_concept_id"), F.lit(0).alias("started_flag"), F.lit(0).alias("stopped_flag"))
    both = empty.unionByName(months)
    rows = dealt(both, n, "person_id")
    rows = both.repartition("person_id") if rows is both else rows
    out = rows.groupBy("person_id", "month_index").agg(F.sum("started_flag").alias("starts_n"), F.sum("stopped_flag").alias("stops_n"), F.sort_array(F.collect_set("ingredient_concept_id")).alias("active_set"))
    return out.select("person_id", "month_index", F.size("active_set").cast("long").alias("active_n"), "starts_n", "stops_n", "active_set")


def month_turnover(burden: DataFrame) -> DataFrame:
    """The previous month's burden and the Jaccard distance to it (1 in a first active month)."""
    own = Window.partitionBy("person_id").orderBy("month_index")
    empty = F.array().cast(burden.schema["active_set"].dataType)
    out = burden.withColumn("prev_active_n", F.coalesce(F.lag("active_n").over(own), F.lit(0).cast("long"))).withColumn("prev_active_set", F.coalesce(F.lag("active_set").over(own), empty))
    return out.withColumn("turnover", jaccard_distance("active_set", "prev_active_set"))


def state(s: Settings) -> Column:
    """The prescribing state of a month; the first condition that holds decides."""
    n, was, starts, stops, moved = (F.col(c) for c in ("active_n", "prev_active_n", "starts_n", "stops_n", "turnover"))
    calm, poly = moved < s.turnover_low, s.polypharmacy_threshold
    return (
        F.when(n == 0, "NoRx")
        .when(was == 0, "Initiation")
        .when((n == 1) & calm & (starts == 0) & (stops == 0), "StableMono")
        .when(n.between(2, poly - 1) & calm, "StableLowPoly")
        .when((n >= poly) & calm, "StablePolypharmacy")
        .when((starts > 0) & (stops > 0) & (moved >= s.turnover_high), "HighTurnover")
        .when((n > was) & (starts > 0), "Intensifying")
        .when((n < was) & (stops > 0), "Deintensifying")
        .otherwise("ModerateFlux")
    )


def month_states(eligible: DataFrame, clipped: DataFrame, s: Settings, *, n: int | None = None) -> DataFrame:
    """The month table: burden, turnover and state of each person-month; ``n`` as of ``month_burden``."""
    burden = month_burden(month_grid(eligible, s.followup_months), era_months(clipped, s.followup_months), n=n)
    return month_turnover(burden).withColumn("state", state(s))
