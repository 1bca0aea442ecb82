"""Era construction: interval algebra on closed date intervals.

Gap-merging needs one shuffle on the keys: windows and the island aggregate all
cluster on them, and duplicates of a start are counted by the same windows
instead of an aggregate of their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dosepath.plans.staging import dealt, stage

KEYS = ("person_id", "ingredient_concept_id")


def imputed_exposures(exposures: DataFrame) -> DataFrame:
    """Exposures with an end date: given, else start + days_supply - 1 (supply over 0), else start; none that ends before it starts."""
    start = F.col("drug_exposure_start_date")
    supplied = F.when(F.col("days_supply") > 0, F.date_add(start, F.col("days_supply").cast("int") - 1))
    out = exposures.select("person_id", "drug_concept_id", start.alias("era_start_date"), F.coalesce("drug_exposure_end_date", supplied, start).alias("era_end_date"))
    return out.where("person_id is not null and drug_concept_id is not null and era_start_date is not null and era_end_date >= era_start_date")


def ingredient_map(concept: DataFrame, ancestor: DataFrame) -> DataFrame:
    """(drug_concept_id, ingredient_concept_id): products and the ingredients that are ancestors of theirs."""
    ingredients = concept.where("domain_id = 'Drug' and concept_class_id = 'Ingredient'").select(F.col("concept_id").alias("ancestor_concept_id"))
    pairs = ancestor.join(ingredients, "ancestor_concept_id", "left_semi")
    return pairs.select(F.col("descendant_concept_id").alias("drug_concept_id"), F.col("ancestor_concept_id").alias("ingredient_concept_id")).distinct()


def to_ingredients(exposures: DataFrame, mapping: DataFrame) -> DataFrame:
    """Imputed exposures by ingredient; a product of several ingredients gives a row for each.

    The vocabulary's size is left to the planner: it is broadcast if its
    statistics are under the session's threshold, else joined by a shuffle.
    """
    return exposures.join(mapping, "drug_concept_id").select(*KEYS, "era_start_date", "era_end_date")


def same_start_deduped(exposures: DataFrame) -> DataFrame:
    """One row for a person, ingredient and start, with the latest end."""
    return exposures.groupBy(*KEYS, "era_start_date").agg(F.max("era_end_date").alias("era_end_date"))


def gap_merged(
    df: DataFrame,
    gap_days: int,
    *,
    keys: Sequence[str] = KEYS,
    start: str = "era_start_date",
    end: str = "era_end_date",
    distinct_starts: bool = True,
    gap_out: int | None = None,
    hot_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Merge intervals of the same keys that overlap or lie at most ``gap_days`` apart.

    A new island begins where a start is after the latest end so far plus the
    gap.  drug_exposure_count counts rows, or with ``distinct_starts`` starts;
    gap_days is ``gap_out`` or the gap.  Keys of more than ``hot_rows`` rows (an
    institution's id, say) are merged in pieces that several tasks share; the
    result is the same.  ``rows``: about how many rows ``df`` has, by which tasks are made.
    """
    if hot_rows is not None:
        hot = stage(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).drop("_n"), "hot")
        if not hot.isEmpty():
            options = {"keys": keys, "start": start, "end": end, "distinct_starts": distinct_starts, "gap_out": gap_out, "rows": rows}
            same = _same(keys, df, hot)
            pieces = _merged_in_pieces(df.join(hot, same, "left_semi"), gap_days, keys, start, end, distinct_starts)
            others = gap_merged(df.join(hot, same, "left_anti"), gap_days, **options)
            return others.unionByName(pieces.withColumn("gap_days", F.lit(gap_days if gap_out is None else gap_out).cast("long")))
    own = Window.partitionBy(*keys).orderBy(start, end)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    marked = dealt(df.select(*keys, start, end), rows, *keys).select(
        *keys,
        start,
        end,
        F.max(end).over(before).alias("_reached"),
        F.lag(start).over(own).alias("_previous"),
    )
    fresh = F.col("_reached").isNull() | (F.col(start) > F.date_add("_reached", gap_days))
    counted = F.when(F.lit(not distinct_starts) | F.col("_previous").isNull() | (F.col("_previous") != F.col(start)), 1).otherwise(0)
    islands = marked.withColumn("_island", F.sum(fresh.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_counted", counted)
    out = islands.groupBy(*keys, "_island").agg(F.min(start).alias("era_start_date"), F.max(end).alias("era_end_date"), F.sum("_counted").cast("long").alias("drug_exposure_count"))
    return out.withColumn("gap_days", F.lit(gap_days if gap_out is None else gap_out).cast("long")).drop("_island")


def _same(keys: Sequence[str], a: DataFrame, b: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def _merged_in_pieces(df: DataFrame, gap_days: int, keys: Sequence[str], start: str, end: str, distinct_starts: bool) -> DataFrame:
    """``gap_merged`` where one key has more rows than a task should hold: a running maximum by segments.

    Rows are dealt by range of (keys, start, end), so a key lies in neighbouring
    pieces.  Each piece runs its own windows; what it needs from the pieces before it
    (the latest end, the last start, the number of islands) is carried in by a table
    of one row for a key and piece.
    """
    dealt = df.select(*keys, start, end).withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, start, end, "_tie")
    rows = stage(dealt.drop("_tie").withColumn("_piece", F.spark_partition_id()), "pieces")
    piece = [*keys, "_piece"]
    own = Window.partitionBy(*piece).orderBy(start, end)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)

    def carried(table: DataFrame, **sums: Column) -> DataFrame:
        """``table`` with what the pieces before a row's own give."""
        each = table.groupBy(*piece).agg(*[c.alias(n) for n, c in sums.items()])
        before = [(F.sum if n == "_islands" else F.max)(n).over(earlier).alias(n) for n in sums]
        each = each.select(*[F.col(c).alias(f"_of{c}") for c in piece], *before)
        return table.join(each, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in piece])).drop(*[f"_of{c}" for c in piece])

    with_ends = carried(rows, _end=F.max(end), _last=F.max(start))
    reached = F.greatest(F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("_end"))
    previous = F.coalesce(F.lag(start).over(own), F.col("_last"))
    marked = with_ends.withColumn("_reached", reached).withColumn("_previous", previous)
    fresh = F.col("_reached").isNull() | (F.col(start) > F.date_add("_reached", gap_days))
    counted = F.when(F.lit(not distinct_starts) | F.col("_previous").isNull() | (F.col("_previous") != F.col(start)), 1).otherwise(0)
    marked = stage(marked.select(*piece, start, end, fresh.cast("int").alias("_fresh"), counted.alias("_counted")), "marked")
    numbered = carried(marked, _islands=F.sum("_fresh"))
    # a written table has no order: of equal rows the one that begins an island goes first
    begun = Window.partitionBy(*piece).orderBy(start, end, F.desc("_fresh")).rowsBetween(Window.unboundedPreceding, 0)
    island = F.sum("_fresh").over(begun) + F.coalesce("_islands", F.lit(0))
    out = numbered.withColumn("_island", island).groupBy(*keys, "_island")
    return out.agg(F.min(start).alias("era_start_date"), F.max(end).alias("era_end_date"), F.sum("_counted").cast("long").alias("drug_exposure_count")).drop("_island")


def exposure_eras(exposures: DataFrame, concept: DataFrame, ancestor: DataFrame, gap_days: int = 30, *, hot_rows: int | None = None, rows: int | None = None) -> DataFrame:
    """Ingredient eras of raw exposures; ``rows``: about how many there are."""
    return gap_merged(to_ingredients(imputed_exposures(exposures), ingredient_map(concept, ancestor)), gap_days, hot_rows=hot_rows, rows=rows)


def raw_drug_eras(exposures: DataFrame, gap_days: int = 30, *, rows: int | None = None) -> DataFrame:
    """Eras of a source without a vocabulary: the drug's own id is the ingredient, every row counts, gap_days is 0."""
    start = F.col("drug_exposure_start_date")
    spans = exposures.select("person_id", F.col("drug_concept_id").alias("ingredient_concept_id"), start.alias("era_start_date"), F.coalesce("drug_exposure_end_date", start).alias("era_end_date"))
    return gap_merged(spans.where("era_start_date is not null"), gap_days, distinct_starts=False, gap_out=0, rows=rows)


def primary_eras(drug_era: DataFrame) -> DataFrame:
    """Ready-made eras in the engine's schema, unmerged."""
    names = {"drug_era_start_date": "era_start_date", "drug_era_end_date": "era_end_date"}
    return drug_era.withColumnsRenamed({k: v for k, v in names.items() if k in drug_era.columns}).select(*KEYS, "era_start_date", "era_end_date", "drug_exposure_count", "gap_days")


def focused(eras: DataFrame, ingredients: Iterable[int]) -> DataFrame:
    """Eras of the given ingredients, or all where none is given; applied before index dates."""
    chosen = sorted({int(x) for x in ingredients})
    return eras.where(F.col("ingredient_concept_id").isin(chosen)) if chosen else eras


def clipped_eras(eras: DataFrame, eligible: DataFrame, *, rows: int | None = None) -> DataFrame:
    """Eras inside follow-up, cut to it, with index_date and censor_date for later steps on the same partitioning.

    clipped_at_censor: the era went on after the censor date (an end on that date is a true end).
    ``rows``: about how many ``eras`` has, by which tasks are made.
    """
    followed = eligible.select("person_id", "index_date", "censor_date")
    both = dealt(eras, rows, "person_id").join(dealt(followed, rows, "person_id"), "person_id")
    inside = both.where((F.col("era_start_date") <= F.col("censor_date")) & (F.col("era_end_date") >= F.col("index_date")))
    return inside.select(
        *KEYS,
        F.greatest("era_start_date", "index_date").alias("era_start_date"),
        F.least("era_end_date", "censor_date").alias("era_end_date"),
        "drug_exposure_count",
        "gap_days",
        (F.col("era_end_date") > F.col("censor_date")).alias("clipped_at_censor"),
        "index_date",
        "censor_date",
    )
