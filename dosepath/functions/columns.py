"""Column expressions that operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def jaccard_distance(a: Column | str, b: Column | str) -> Column:
    """1 - |A and B| / |A or B| of two arrays as sets; 0 for two empty ones; null counts as empty."""
    a, b = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.array()) for x in (a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(1.0 - F.size(F.array_intersect(a, b)) / either)


def md5_id(value: Column) -> Column:
    """A stable 60-bit id of a string: the first 15 hex digits of its md5."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def atc_ingredient_id(atc: Column) -> Column:
    """Ingredient id of an ATC code's first seven characters (fifth level); -1 for null or a shorter code."""
    return F.when(F.length(atc) >= 7, md5_id(F.substring(atc, 1, 7))).otherwise(F.lit(-1).cast("long"))


def lenient_date(value: Column, *, british: bool = False) -> Column:
    """ISO date, or null; with ``british`` also dd/MM/yyyy."""
    iso = F.try_to_date(value.cast("string"), "yyyy-MM-dd")
    return F.coalesce(iso, F.try_to_date(value.cast("string"), "dd/MM/yyyy")) if british else iso


def days(start: str, end: str) -> Column:
    """Days of a closed interval."""
    return F.datediff(F.col(end), F.col(start)) + 1
