"""A corpus pipeline: documents to packed training sequences, in five stages.

Every stage is written as Parquet and read again as the next one's ``docs``.  A row
is a row: stages decide on rows, not on ids, so repeated and null ids lose nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from dosepath.llm import mixing, ngram_join, packing, pii, quality
from dosepath.plans.staging import kept, scratch, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.5 or more).

    It learns from the labels of ``docs`` except those held out by crc32 of the id.
    Null and empty texts are scored as empty ones; repeated rows share a score;
    without labels of one class all documents of the other stay, without any label
    all stay.
    """
    # the statistics are the costly part: made once, beside the texts
    rows = stage(quality.featured(docs, [F.col(c) for c in COLUMNS]), "features")
    marks = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *[f"__x_{n}" for n in quality.FEATURES])
    model = quality.fit(marks, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn_from=~quality.held_out(F.col("_id")))
    return rows.where(model.score() >= 0.5).select(*COLUMNS)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: of the least id, and of its rows one.

    Rows of a null or empty text, and of a null id, are never left out; links reach
    through the latter.
    """
    docs = docs.select(*COLUMNS).withColumn("_row", mixing.unit(docs))
    found = ngram_join.similar_components(docs.select(F.col("_row").alias("doc_id"), "text"), n=5, num=75, den=100)
    found = stage(found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_row"), F.col("component_id").alias("group")).agg(F.count("*").alias("n")), "found")
    ids = docs.where("doc_id is not null").select("doc_id", "_row").distinct()
    several = found.groupBy("group").agg(F.sum("n").alias("n")).where("n > 1").select("group")
    rows = found.join(several, "group", "left_semi").join(ids, "_row")  # ids and hashes only
    first = rows.groupBy("group").agg(F.min(F.struct("doc_id", "_row")).alias("first")).select("group", F.col("first._row").alias("first"))
    verdicts = stage(rows.join(first, "group").select("_row", (F.col("_row") != F.col("first")).alias("lost"), "n").where("lost or n > 1"), "verdicts")
    twice = verdicts.where("not lost").select("_row")
    once = docs.join(verdicts.select("_row"), "_row", "left_anti")
    if not twice.isEmpty():
        once = once.unionByName(docs.join(twice, "_row", "left_semi").dropDuplicates(["_row"]))
    return once.select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it generalised in their texts.

    Texts without any, null and empty ones stay as they are; repeated rows are changed alike.
    """
    docs = docs.select(*COLUMNS)
    clean = pii.sanitised(docs)
    changed = F.size("pii_spans") > 0
    text = F.when(changed, F.col("clean_text")).otherwise(F.col("text"))
    return clean.select("doc_id", text.alias("text"), "lang", "source", F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix to the sources' target weights takes it.

    Copies are separate rows; a row that the mix leaves out goes.  Rows without
    words weigh nothing in the mix and stay once.  Equal rows share what the mix
    takes of them.
    """
    docs = docs.select(*COLUMNS).withColumn("_unit", mixing.unit(docs))
    mixed = mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2.0)
    takes = F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("long")
    times = stage(mixed.groupBy(F.col("unit").alias("_unit")).agg(F.sum(takes).alias("_takes"), F.count("*").alias("_rows")), "takes")
    each = F.floor(F.col("_takes") / F.col("_rows"))
    out = docs.join(times.where(each > 0), "_unit").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), each)))
    over = times.where("_takes % _rows > 0")  # of equal rows only: what does not go round
    if not over.isEmpty():
        more = docs.join(over, "_unit").dropDuplicates(["_unit"]).withColumn("_copy", F.explode(F.expr("sequence(1L, _takes % _rows)")))
        out = out.unionByName(more)
    return out.select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of the documents' tokens; a null text is its end token alone, repeated rows are packed each."""
    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=packing.SPECIAL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", duplicates_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned scores, links over hashed shingles, random flights and byte-level tokens have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        with scratch():  # what a stage wrote for itself goes
            docs = kept(stage(function(spark, docs, sf_dir), name))
    return docs
