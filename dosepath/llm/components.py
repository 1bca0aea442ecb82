"""Connected components of an edge table by alternating large and small stars.

Every step is one aggregate and one join on node ids; a node with very many
neighbours is aggregated before the shuffle and its join is split by the
adaptive planner.  Steps are staged, so lineage stays short and a lost executor
costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dosepath.plans.staging import stage, unstage


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    return r[0], r[1]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the least node of its component; nodes without an edge are absent.

    Null ends and loops are ignored; repeated edges do no harm.
    """
    now = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") > F.col("v")).distinct(), "edges")
    state = _sum(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where(F.col("v") > F.col("u")).join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v")).distinct()
        large = stage(large, "large")
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = stage(small.where(F.col("u") > F.col("v")).distinct(), "edges")
        unstage(now, large)
        now, before, state = new, state, _sum(new)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
