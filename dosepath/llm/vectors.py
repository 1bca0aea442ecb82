"""Reading vector tables in Arrow batches, blocks of queries, and each query's best rows.

A query is a row, not an id: rows that are equal in id and vector are one query
asked several times.  Searches take all rows as candidates, the query's own among
them, for the k + 1 best, and ``ranked`` drops the own one: of rows with the
query's id and its score with itself, one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from dosepath.llm.common import ship

ship(__name__)

#: Queries that one pass holds; a table with more takes more passes, each with this bound.
QUERY_BLOCK = 4096

#: Queries of a length: number of the first one in its block, ids, how often each is asked, matrix.
Group = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def usable(table: DataFrame, vec_id: str, vector: str, *, zero: bool) -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as array<double>.

    Left out: null ids, null or empty vectors, vectors that hold null, NaN or an
    infinity, and (unless ``zero``) zero vectors.  Vectors of different lengths
    have no inner product; a query's candidates are those of its length.
    """
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows


def query_blocks(rows: DataFrame, chosen: Column) -> tuple[int, Iterator[dict[int, Group]]]:
    """Number of blocks, and the chosen rows as queries by length, a bounded block at a time."""
    asked = rows.where(chosen)
    blocks = -(-asked.count() * 5 // (QUERY_BLOCK * 4))  # a hash deals blocks of 4/5 of the bound

    def made() -> Iterator[dict[int, Group]]:
        for k in range(blocks):
            one = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == k).groupBy("vec_id", "v").agg(F.count("*").alias("n")).orderBy("vec_id", "v").toArrow()
            if one.num_rows:
                one, out, first = one.combine_chunks(), {}, 0
                for d, part in by_length(one, "v").items():
                    out[d] = first, part["vec_id"].to_numpy(), part["n"].to_numpy(), matrix(part["v"])
                    first += part.num_rows
                yield out

    return blocks, made()


def by_length(rows, column: str) -> dict:
    """A table or batch parted by the lengths of a list column."""
    lengths = pc.list_value_length(rows[column]).to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, int)
    return {int(d): rows if (lengths == d).all() else rows.filter(pa.array(lengths == d)) for d in np.unique(lengths)}


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best: highest score, then smallest vec."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return order[np.arange(len(q)) - begin < k]


def together(groups: dict[int, Group]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and times of all queries of a block, by their number."""
    parts = sorted(groups.values(), key=lambda g: g[0])
    return np.concatenate([g[1] for g in parts]), np.concatenate([g[2] for g in parts])


#: Columns of what tasks return: a query's number, the times it is asked, and whether a row may be the query's own.
FOUND = "query long, times long, own boolean, query_id long, vec_id long"


def found_batch(block: int, ids: np.ndarray, times: np.ndarray, q: np.ndarray, vec: np.ndarray, score: np.ndarray, own_score: np.ndarray) -> pa.RecordBatch:
    own = (ids[q] == vec) & (own_score[q] == score)
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64) + (block << 32)), pa.array(times[q]), pa.array(own), pa.array(ids[q]), pa.array(vec), pa.array(score)], names=[*[c.split()[0] for c in FOUND.split(", ")], "score"])


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query, with ``rank``."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows but the query's own; found: the k + 1 best or more."""
    own = F.min(F.when(F.col("own"), F.col("rank"))).over(Window.partitionBy("query"))
    rows = top(found, k + 1).withColumn("_own", F.coalesce(own, F.lit(k + 2)))
    rows = rows.where(F.col("rank") != F.col("_own")).withColumn("rank", F.col("rank") - (F.col("rank") > F.col("_own")).cast("int")).where(F.col("rank") <= k)
    rows = rows.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return rows.select("query_id", "rank", "vec_id", "score")
