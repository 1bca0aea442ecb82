"""Exact top-k search by distributed histogram selection.

All pairs of a block of queries and the candidates are scored as exact integer
inner products.  A round histograms the scores of every query over the interval
in which its k-th highest score must lie (64 bins, summed on the executors
before and after the shuffle); the bin that holds the k-th score is the next
round's interval.  When an interval is one score wide, or few enough candidates
reach it, a last pass keeps the candidates at or above its lower edge, and ties
are broken by the smaller id.  Scores are made again in every pass and never
written; a task returns at most k rows of a query.

Nulls and edges: see vectors.usable, and vectors for repeated rows.  Repeated
candidates count each; fewer than k candidates are all returned; an empty table
gives no rows; scores that leave the range of long are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dosepath.llm.common import ship
from dosepath.llm.vectors import FOUND, Group, best, by_length, found_batch, matrix, query_blocks, ranked, together, usable
from dosepath.plans.staging import stage

ship(__name__)

BINS = 64
CHUNK = 256
LONGEST = 2**63 - 1
EDGE = 2**60  # histograms end here: higher scores count as this one when an interval is sought, and differ again in the last pass
OUT = "query_id long, rank int, vec_id long, score long"


def _ints(v: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(v * scale))


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products in integers of any size, held to the range of long."""
    whole = [np.array([int(x) for x in m.ravel()], dtype=object).reshape(m.shape) for m in (q, c)]
    return np.clip(whole[0] @ whole[1].T, -LONGEST, LONGEST).astype(np.int64)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, held to the range of long; only rows that could leave it are slow."""
    d = q.shape[1]
    if np.abs(q).max() * np.abs(c).max() * d < 2.0**62:
        far_q, far_c = np.zeros(len(q), bool), np.zeros(len(c), bool)
    else:
        far_q, far_c = (np.abs(m).max(axis=1) >= np.sqrt(2.0**61 / d) for m in (q, c))
        q, c, given_q, given_c = np.where(far_q[:, None], 0, q), np.where(far_c[:, None], 0, c), q, c
    exact = np.float64 if np.abs(q).max() * np.abs(c).max() * d < 2**53 else np.int64
    out = (q.astype(exact) @ c.astype(exact).T).astype(np.int64)
    if far_q.any():
        out[far_q] = _exact(given_q[far_q], given_c)
    if far_c.any():
        out[np.ix_(~far_q, far_c)] = _exact(given_q[~far_q], given_c[far_c])
    return out


def _scored(groups: dict[int, Group], batches: Iterator[pa.RecordBatch], scale: float):
    """(number of the first query, integer scores, candidates' ids) by batch, length and chunk of queries."""
    for b in batches:
        for d, part in by_length(b, "v").items():
            if d not in groups:
                continue
            first, _, _, q = groups[d]
            vec, c = part["vec_id"].to_numpy(), _ints(matrix(part["v"]), scale)
            for lo in range(0, len(q), CHUNK):
                yield first + lo, _products(q[lo : lo + CHUNK], c), vec


def _histograms(rows: DataFrame, groups, low, width, scale) -> dict[int, list[int]]:
    """Counts of every query's scores in BINS bins of ``width`` from ``low``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(low), BINS), dtype=np.int64)
        for lo, s, _ in _scored(groups, batches, scale):
            s = np.clip(s, -EDGE, EDGE)
            at = slice(lo, lo + len(s))
            inside = s >= low[at, None]
            bins = np.where(inside, s - low[at, None], 0) // width[at, None]
            inside &= bins < BINS
            flat = (bins + np.arange(len(s))[:, None] * BINS)[inside]
            total[at] += np.bincount(flat, minlength=len(s) * BINS).reshape(-1, BINS)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["q", "h"])

    parts = rows.mapInArrow(counted, "q int, h array<long>")
    sums = parts.groupBy("q").agg(F.array(*[F.sum(F.get("h", F.lit(i))) for i in range(BINS)]).alias("h"))
    return {r["q"]: r["h"] for r in sums.collect()}  # one row for each query of the block


def _kept(rows: DataFrame, block: int, groups, low, k, scale) -> DataFrame:
    """The k best of each task among the scores at or above ``low``."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, times = together(groups)
        own = np.zeros(len(ids), np.int64)
        for first, _, _, q in groups.values():
            own[first : first + len(q)] = [int(_products(x[None], x[None])[0, 0]) for x in q]
        held = [np.zeros(0, np.int64)] * 3
        for lo, s, vec in _scored(groups, batches, scale):
            r, c = np.nonzero(s >= low[lo : lo + len(s), None])
            held = [np.concatenate(x) for x in zip(held, (r + lo, s[r, c], vec[c]), strict=True)]
            if len(held[0]) > 8 * k * len(ids):
                held = [x[keep] for keep in [best(*held, k)] for x in held]
        keep = best(*held, k)
        yield found_batch(block, ids, times, held[0][keep], held[2][keep], held[1][keep], own)

    return rows.mapInArrow(chosen, f"{FOUND}, score long")


def _open(groups: dict[int, Group], open_: np.ndarray) -> dict[int, Group]:
    """The queries of a block whose interval is still open, numbered anew."""
    out, first = {}, 0
    for d, (at, ids, times, q) in sorted(groups.items(), key=lambda g: g[1][0]):
        keep = open_[at : at + len(ids)]
        if keep.any():
            out[d] = first, ids[keep], times[keep], q[keep]
            first += int(keep.sum())
    return out


def exact_top_k(table: DataFrame, chosen: Column, *, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """The ``k`` highest integer inner products of every chosen row with the other rows.

    ``chosen`` is a condition on ``vec_id``.  Components become floor(scale * x).
    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = table.sparkSession
    rows = usable(table, vec_id, vector, zero=True)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * scale).cast("double"), 2.0)))
    blocks, queries = query_blocks(rows, chosen)
    most = float(rows.agg(F.max(norm)).collect()[0][0] or 0) if blocks else 0.0
    out = None
    for block, groups in enumerate(queries):
        groups = {d: (first, ids, times, _ints(v, scale)) for d, (first, ids, times, v) in groups.items()}
        n = sum(len(g[1]) for g in groups.values())
        reach = np.zeros(n, np.int64)
        for first, ids, _, q in groups.values():
            with np.errstate(over="ignore"):
                reach[first : first + len(ids)] = np.minimum(np.ceil(np.sqrt((q * q).sum(axis=1)) * most * (1 + 1e-9)), EDGE).astype(np.int64) + 1
        low, width = -reach, -(-(2 * reach + 1) // BINS)
        want = np.full(n, k + 1, dtype=np.int64)  # with the query's own row
        open_ = np.ones(n, dtype=bool)
        while open_.any():
            hist = _histograms(rows, _open(groups, open_), low[open_], width[open_], scale)
            for at, i in enumerate(np.flatnonzero(open_)):
                h = np.array(hist.get(at, [0] * BINS), dtype=np.int64)
                above = np.cumsum(h[::-1])[::-1]  # scores in a bin or over it, inside the interval
                hit = np.flatnonzero(above >= want[i])
                if not len(hit):  # fewer candidates than k
                    open_[i] = False
                    continue
                b = int(hit[-1])
                over = int(above[b] - h[b])
                low[i] += b * width[i]
                want[i] -= over
                open_[i] = width[i] > 1 and h[b] > 4 * k
                width[i] = -(-width[i] // BINS)
        low = np.where(low <= -EDGE, -LONGEST, low)  # all scores
        found = _kept(rows, block, groups, low, k + 1, scale)
        found = found if blocks == 1 else stage(found, f"found{block}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], OUT)
    return ranked(out, k)
