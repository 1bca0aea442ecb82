"""The engine's input tables made from a sales star schema: orders are persons' dispensings, part types ingredients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dosepath.operators import intervals
from dosepath.plans.staging import dealt, stage


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_items(spark: SparkSession, sf_dir: str) -> int:
    """The number of items, from the file's footers."""
    return read(spark, sf_dir, "lineitem").count()


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("person_id"))
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linenumber", F.to_date("l_shipdate").alias("shipped"))
    n = n_items(spark, sf_dir)  # an item has one order, so this is the join's size too
    items, orders = dealt(items, n, "l_orderkey"), dealt(orders, n, "o_orderkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def exposures(spark: SparkSession, sf_dir: str, shipped: DataFrame | None = None) -> DataFrame:
    """drug_exposure: end known for returned items, supply of three days a unit but for seventh lines."""
    supply = (F.col("l_quantity") * 3).cast("int")
    return (shipments(spark, sf_dir) if shipped is None else shipped).select(
        "person_id",
        F.col("l_partkey").cast("long").alias("drug_concept_id"),
        F.col("shipped").alias("drug_exposure_start_date"),
        F.when(F.col("l_returnflag") == "A", F.date_add("shipped", supply - 1)).alias("drug_exposure_end_date"),
        F.when(F.col("l_linenumber") != 7, supply).alias("days_supply"),
        F.col("l_quantity").cast("double").alias("quantity"),
    )


def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ingredient_concept_id, concept_name): one for each of the few part types."""
    types = read(spark, sf_dir, "part").select(F.col("p_type").alias("concept_name")).distinct()
    rank = F.dense_rank().over(Window.orderBy("concept_name"))
    return types.select((F.lit(1000000) + rank).cast("long").alias("ingredient_concept_id"), "concept_name")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ingredients(spark, sf_dir).select(F.col("ingredient_concept_id").alias("concept_id"), "concept_name", F.lit("Drug").alias("domain_id"), F.lit("Ingredient").alias("concept_class_id"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("concept_id"), F.col("p_name").alias("concept_name"), F.lit("Drug").alias("domain_id"), F.lit("Clinical Drug").alias("concept_class_id"))
    return own.unionByName(parts)


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ingredients(spark, sf_dir)
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("descendant_concept_id"), F.col("p_type").alias("concept_name"))
    products = parts.join(own, "concept_name").select(F.col("ingredient_concept_id").alias("ancestor_concept_id"), "descendant_concept_id")
    same = own.select(F.col("ingredient_concept_id").alias("ancestor_concept_id"), F.col("ingredient_concept_id").alias("descendant_concept_id"))
    return products.unionByName(same)


def eras(spark: SparkSession, sf_dir: str, gap_days: int = 30, shipped: DataFrame | None = None) -> DataFrame:
    return intervals.exposure_eras(exposures(spark, sf_dir, shipped), concepts(spark, sf_dir), ancestors(spark, sf_dir), gap_days, rows=n_items(spark, sf_dir))


def _first(spark: SparkSession, sf_dir: str, shipped: DataFrame | None) -> DataFrame:
    return (shipments(spark, sf_dir) if shipped is None else shipped).groupBy("person_id").agg(F.min("shipped").alias("f"))


def observation(spark: SparkSession, sf_dir: str, shipped: DataFrame | None = None) -> DataFrame:
    """observation_period: one period a person, and an older one for every tenth."""
    one = F.struct(F.date_sub("f", (F.col("person_id") % 4 * 200).cast("int")).alias("s"), F.date_sub(F.date_add("f", 1000), (F.col("person_id") % 7 * 100).cast("int")).alias("e"))
    two = F.struct(F.date_sub("f", 800).alias("s"), F.date_add("f", 400).alias("e"))
    periods = F.when(F.col("person_id") % 10 == 0, F.array(one, two)).otherwise(F.array(one))
    return _first(spark, sf_dir, shipped).select("person_id", F.explode(periods).alias("p")).select("person_id", F.col("p.s").alias("observation_period_start_date"), F.col("p.e").alias("observation_period_end_date"))


def deaths(spark: SparkSession, sf_dir: str, shipped: DataFrame | None = None) -> DataFrame:
    """death: every thirteenth person, some of them twice."""
    died = F.date_add("f", (F.lit(300) + F.col("person_id") % 400).cast("int"))
    dates = F.when(F.col("person_id") % 26 == 0, F.array(died, F.date_add(died, 10))).otherwise(F.array(died))
    return _first(spark, sf_dir, shipped).where("person_id % 13 = 0").select("person_id", F.explode(dates).alias("death_date"))


def inputs(spark: SparkSession, sf_dir: str, gap_days: int = 30, *, staged: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(eras, observation_period, death); ``staged``, for plans with several branches: from one join of the sales tables, with eras merged once."""
    if not staged:
        return eras(spark, sf_dir, gap_days), observation(spark, sf_dir), deaths(spark, sf_dir)
    shipped = stage(shipments(spark, sf_dir), "shipped")
    return stage(eras(spark, sf_dir, gap_days, shipped), "eras"), observation(spark, sf_dir, shipped), deaths(spark, sf_dir, shipped)
