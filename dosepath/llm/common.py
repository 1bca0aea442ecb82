"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from dosepath.plans.staging import stage

#: White space as the contracts of the word-based operators have it; a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send this module's functions to executors by value: they need no install of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def release() -> None:
    """Give a task's freed memory back: workers are kept for later tasks beside other ones."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def word_count(text: Column) -> Column:
    """Number of words of a text (long); null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def number_rows(df: DataFrame, *order: str, name: str = "row_number") -> tuple[DataFrame, int]:
    """Global row numbers from 0 in the order of ``order``, without one task seeing all rows.

    Rows are dealt by range and sorted inside their partition; the partitions'
    counts (one number each) give the offsets.  Rows equal in ``order`` follow
    in an arbitrary order, so ``order`` should name all columns that matter; the
    extra key only spreads such ties over partitions.  Returns the staged rows
    and their number.
    """
    spark = df.sparkSession
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    at = F.col("_at")
    rows = stage(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.select("*", F.shiftright(at, 33).cast("int").alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_in"))
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())
    total, offsets = 0, []
    for part, n in counts:
        offsets.append((part, total))
        total += n
    if not offsets:
        return rows.withColumn(name, F.col("_in")).drop("_at", "_part", "_in"), 0
    # one row for each shuffle partition: small whatever the input
    table = F.broadcast(spark.createDataFrame(offsets, "_part int, _offset long"))
    out = rows.join(table, "_part").withColumn(name, F.col("_in") + F.col("_offset"))
    return out.drop("_at", "_part", "_in", "_offset"), total
