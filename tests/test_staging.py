"""Tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosepath.plans.staging import placed


def test_placed_rows_are_grouped_without_a_shuffle(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), (F.col("id") % 3).alias("b"), "id")
    held = placed(rows, 11, "a", "b")
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
    assert held.rdd.getNumPartitions() == 11
    counts = held.groupBy("a", "b").count()
    assert "Exchange" not in counts._jdf.queryExecution().toString()
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in rows.groupBy("a", "b").count().collect()}
    assert placed(rows.limit(0), 4, "a").count() == 0
