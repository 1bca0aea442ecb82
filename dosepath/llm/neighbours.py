"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are quantised to int8 with a scale of their own; a tile product of a
block of queries and a batch of candidates gives every inner product within a
bound made of the quantisation errors' norms: with x = x' + e and y = y' + f,
|<x,y> - <x',y'>| <= |x'| |f| + |e| |y|.  Products of codes are summed in strips of
1024 components, which float32 holds exactly, and a term relative to |x| |y| covers
the rounding of norms and scores.  A pair survives when its upper bound
reaches the query's k-th best lower bound so far; survivors are recomputed in
double precision on the original vectors and merged into each task's k best.
Nothing is left out by the tiles, so recall is 1.  A seed pass over a bounded
hash sample of candidates gives the tasks a first lower bound.

Nulls and edges: see vectors.usable (zero vectors take no part) and vectors for
repeated rows.  Repeated candidates count each; scores that leave the range of
double are infinite or no numbers; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dosepath.llm.common import ship
from dosepath.llm.vectors import FOUND, Group, best, by_length, found_batch, matrix, query_blocks, ranked, together, top, usable
from dosepath.plans.staging import stage

ship(__name__)

CHUNK = 256
STRIP = 1024  # products of 127 * 127, so many of which stay under 2 ** 24
SEEDS = 2048
OUT = "query_id long, rank int, vec_id long, score double"


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32, for the product), scale, norm of the coded vector, norm of the error."""
    scale = np.abs(v).max(axis=1, initial=0.0) / 127
    scale[scale == 0] = 1
    codes = np.clip(np.rint(v / scale[:, None]), -127, 127)
    coded = codes * scale[:, None]
    return codes.astype(np.int8).astype(np.float32), scale, np.linalg.norm(coded, axis=1), np.linalg.norm(v - coded, axis=1)


def bounded(a: tuple, norm_a: np.ndarray, b: tuple, norm_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of two quantised sets of vectors of these norms, and how far off they are at most."""
    (codes_a, scale_a, coded_a, err_a), (codes_b, scale_b, _, err_b) = a, b
    d = codes_a.shape[1]
    total = np.zeros((len(codes_a), len(codes_b)))
    for lo in range(0, d, STRIP):
        total += codes_a[:, lo : lo + STRIP] @ codes_b[:, lo : lo + STRIP].T
    rounding = 8 * (d + 8) * np.finfo(float).eps * norm_a[:, None] * norm_b[None, :]
    return total * scale_a[:, None] * scale_b[None, :], coded_a[:, None] * err_b[None, :] + err_a[:, None] * norm_b[None, :] + rounding


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first component on, so equal pairs give equal bits."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _search(rows: DataFrame, block: int, groups: dict[int, Group], floor: np.ndarray, k: int) -> DataFrame:
    """The k best rows that each task finds for each query, and others; floor: a score that k rows reach."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, times = together(groups)
        coded = {d: (quantise(q), np.linalg.norm(q, axis=1)) for d, (_, _, _, q) in groups.items()}
        own = np.zeros(len(ids))
        for first, _, _, q in groups.values():
            own[first : first + len(q)] = products(q, q)
        least = floor.copy()
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for batch in batches:
            for d, part in by_length(batch, "v").items():
                if d not in groups:
                    continue
                first, _, _, q = groups[d]
                vec, c = part["vec_id"].to_numpy(), matrix(part["v"])
                codes_c, norm_c = quantise(c), np.linalg.norm(c, axis=1)
                codes_q, norm_q = coded[d]
                new = []
                for lo in range(0, len(q), CHUNK):
                    at = slice(first + lo, first + min(lo + CHUNK, len(q)))
                    about, slack = bounded(tuple(x[lo : lo + CHUNK] for x in codes_q), norm_q[lo : lo + CHUNK], codes_c, norm_c)
                    if len(vec) >= k:
                        lower = np.partition(np.nan_to_num(about - slack, nan=-np.inf, posinf=-np.inf, neginf=-np.inf), len(vec) - k, axis=1)[:, len(vec) - k]
                        np.maximum(least[at], lower, out=least[at])
                    r, j = np.nonzero(~(about + slack < least[at, None]))  # no number: not known to be less
                    for some in range(0, len(r), 1 << 16):
                        rr, jj = r[some : some + (1 << 16)] + lo, j[some : some + (1 << 16)]
                        new.append((rr + first, products(q[rr], c[jj]), vec[jj]))
                        if len(new) > 16:
                            new = [tuple(x[keep] for x in y) for y in [[np.concatenate(x) for x in zip(*new, strict=True)]] for keep in [best(*y, k)]]
                held = [np.concatenate(x) for x in zip(held, *new, strict=True)]
                held = [x[keep] for keep in [best(*held, k)] for x in held]
                starts = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]]) if len(held[0]) else np.zeros(0, int)
                ends = np.r_[starts[1:], len(held[0])]
                for b, e in zip(starts, ends, strict=False):
                    if e - b == k:
                        least[held[0][b]] = max(least[held[0][b]], held[1][e - 1])
        yield found_batch(block, ids, times, held[0], held[2], held[1], own)

    return rows.mapInArrow(found, f"{FOUND}, score double")


def nearest(table: DataFrame, chosen: Column, *, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` largest inner products of every chosen row with the other rows.

    ``chosen`` is a condition on ``vec_id``.  Returns query_id, rank (from 1),
    vec_id, score (double precision, on the original vectors).
    """
    spark = table.sparkSession
    rows = usable(table, vec_id, vector, zero=False)
    blocks, queries = query_blocks(rows, chosen)
    seeds = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows.count() // SEEDS))) == 0) if blocks else rows
    out = None
    for block, groups in enumerate(queries):
        floor = np.full(sum(len(g[1]) for g in groups.values()), -np.inf)
        # with the query's own row k + 1 are the best
        for r in top(_search(seeds, block, groups, floor, k + 1), k + 1).where(F.col("rank") == k + 1).collect():  # one row a query
            floor[r["query"] & 0xFFFFFFFF] = r["score"]
        found = _search(rows, block, groups, floor, k + 1)
        found = found if blocks == 1 else stage(found, f"found{block}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], OUT)
    return ranked(out, k)
