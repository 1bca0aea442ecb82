"""Written tables that cut lineage, in the folder every executor shares.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Where that is
unset, a temporary folder is made if the master is local (tests, a laptop); on a
cluster each executor would write its own disk, so that is refused.
"""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task of ``dealt`` should hold.
ROWS = 400_000

_own: list[str] = []
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir names no folder that executors of {master} share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="dosepath-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


@contextmanager
def scratch() -> Iterator[None]:
    """Delete at its end the tables staged inside: for work whose results are written elsewhere."""
    _scopes.append([])
    try:
        yield
    finally:
        unstage(*_scopes.pop())


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex[:12]}-{name}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as take ``ROWS`` of its ``rows`` each, so that a task's memory does not grow with the input.

    An adaptive plan merges shuffle partitions by their bytes, compressed: its tasks
    grow with the input up to 64 MB, which sorts and windows hold as 1 GB.  Where the
    session runs that many tasks at once, or ``rows`` is not known, the plan decides.
    """
    n = math.ceil((rows or 0) / ROWS)
    return df if n <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(n, *keys)


def placed(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``df`` dealt over ``n`` partitions by ``keys`` and checkpointed: later groupings by these keys move no row of it.

    A checkpoint keeps the partitioning that a written table forgets; it is in the shared folder and survives lost executors.
    """
    spark, adaptive = df.sparkSession, "spark.sql.adaptive.enabled"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    was = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")  # an adaptive plan does not tell its partitioning
    try:
        return df.repartition(n, *keys).checkpoint()
    finally:
        spark.conf.set(adaptive, was)


def kept(df: DataFrame) -> DataFrame:
    """A staged table that outlives the scope it was made in."""
    if _scopes:
        _scopes[-1][:] = [x for x in _scopes[-1] if x is not df]
    return df


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
