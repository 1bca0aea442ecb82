"""Sales statistics exported as spreadsheet blocks, one for each ATC group.

A block starts with a cell "ATC code: XXXX (name)"; its years are two rows below,
its values for men six and for women seven.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

YEARS, MEN, WOMEN = 2, 6, 7
#: Labels of the two rows (fixed values).
SEXES = {MEN: ("male", "men", "mænd"), WOMEN: ("female", "women", "kvinder")}


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row, cells) of a headerless CSV export; a spreadsheet is small, so one task numbers its rows."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r", "").alias("value"))
    rows = raw.select(F.posexplode(F.split("value", "\n")).alias("row", "line"))
    return rows.select("row", F.transform(F.split("line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.regexp_replace(F.trim(c), '^"|"$', "")).alias("cells"))


def _number(c: Column) -> Column:
    """The number in a cell; null for marks such as "-" and ">99%"."""
    return F.regexp_replace(c, ",", ".").try_cast("double")


def parse(rows: DataFrame, name: str = "value") -> DataFrame:
    """(atc_group, year, sex, <name>) of the blocks in ``rows`` (row, cells); raises where a block's labels are not where they belong.

    Each row learns the block that it is in from the last heading before it.
    """
    head = F.col("cells")[0].startswith("ATC code:") & F.contains(F.col("cells")[0], F.lit("("))
    before = Window.orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # rows of one spreadsheet
    own = rows.withColumn("at", F.last(F.when(head, F.col("row")), ignorenulls=True).over(before))
    own = own.withColumn("atc_group", F.last(F.when(head, F.regexp_extract(F.col("cells")[0], r"^ATC code:\s*(\S+)", 1)), ignorenulls=True).over(before))
    own = own.where("at is not null").withColumn("offset", F.col("row") - F.col("at"))
    label = F.lower(F.trim(F.col("cells")[0]))
    for offset, labels in SEXES.items():
        wrong = (F.col("offset") == offset) & ~label.isin(*labels)
        own = own.withColumn("offset", F.when(wrong, F.raise_error(F.concat(F.lit(f"row {offset} below {labels[0]} block heading: unexpected label "), label)).cast("int")).otherwise(F.col("offset")))
    years = own.where(F.col("offset") == YEARS).select("at", F.posexplode(F.slice("cells", F.lit(2), F.greatest(F.lit(0), F.size("cells") - 1))).alias("k", "year"))
    values = own.where(F.col("offset").isin(MEN, WOMEN)).select("at", "atc_group", F.col("cells")[0].alias("sex"), F.posexplode(F.slice("cells", F.lit(2), F.greatest(F.lit(0), F.size("cells") - 1))).alias("k", "v"))
    year = F.col("year").try_cast("double").cast("int")
    return values.join(years, ["at", "k"]).where(year.isNotNull()).select("atc_group", year.alias("year"), "sex", _number(F.col("v")).alias(name))
