"""Sinks: Parquet results by label, small CSV reports, and single CSV files of a given name."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

#: Result of a run -> file suffix.
SUFFIXES = {
    "eligible": "eligible",
    "eras": "eras",
    "person_month_summary": "person_months",
    "era_events": "era_events",
    "final_person": "person_level_phenotypes",
    "cluster_summary": "cluster_summary",
    "top_ingredients": "top_ingredients",
}


def write_results(results: Mapping[str, DataFrame], folder: str, label: str) -> dict[str, str]:
    """Write every result as <folder>/<label>_<suffix>.parquet, over what is there; returns the paths."""
    out = {}
    for name, df in results.items():
        out[name] = f"{folder}/{label}_{SUFFIXES.get(name, name)}.parquet"
        df.write.mode("overwrite").parquet(out[name])
    return out


def write_csv(spark: SparkSession, rows: Sequence[tuple], schema: str, path: str) -> None:
    """A small report (a silhouette grid, an elbow curve) as one CSV file with a header, empty or not."""
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_named_csv(df: DataFrame, path: str) -> str:
    """Write ``df`` as one CSV file of that very name, gzipped if it ends in .gz; returns the path.

    Tasks write parts beside it, without headers; the header and the parts' bytes (gzip
    members may follow each other) are put together in a file of another name, which
    replaces ``path`` when it is whole.  Bytes are copied in a fixed buffer, never held.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    zipped = path.endswith(".gz")
    work = f"{path}.{uuid.uuid4().hex[:12]}"
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{work}/{name}")
    writer = df.write.option("header", False).option("compression", "gzip" if zipped else "none").option("emptyValue", "")
    try:
        writer.csv(f"{work}/parts")
        head = ",".join(f'"{c}"' if "," in c or '"' in c else c for c in df.columns) + "\n"
        whole = fs.create(at("whole"), True)
        try:
            data = head.encode()
            whole.write(bytearray(gzip.compress(data, mtime=0) if zipped else data))
            parts = sorted(s.getPath().toString() for s in fs.listStatus(at("parts")) if s.getPath().getName().startswith("part-"))
            for part in parts:
                source = fs.open(jvm.org.apache.hadoop.fs.Path(part))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, whole, conf, False)
                finally:
                    source.close()
        finally:
            whole.close()
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(at("whole"), target):
            raise OSError(f"{path} could not be replaced")
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(work), True)
    return path
