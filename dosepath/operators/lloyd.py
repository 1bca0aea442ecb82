"""K-means models advanced together: a round reads the rows once, however many models there are.

Rows go through numpy in Arrow batches; a task sends sums of its rows for each
centre, and centres, a few rows a model, are on the driver.  A model that no longer
moves takes no part in later rounds.  Starts are chosen by k-means++ on a sample of
``SAMPLE`` rows at most, of the least hashes; all else is over all rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no install of the package

SAMPLE = 4096
#: Rows whose distances to all centres are made at once: they fit a core's cache.
BLOCK = 1024


@dataclass
class Model:
    """Centres, and of their rows the number, sums and squared distances (to the centres, summed)."""

    centres: np.ndarray
    n: np.ndarray | None = None
    cost: float = math.inf

    def labelled(self, rows: DataFrame, vector: str, name: str) -> DataFrame:
        """``rows`` with the nearest centre's number, ties to the lower one."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(v):
            import pandas as pd

            return pd.Series(_nearest(np.stack(v.to_numpy()), centres)[0] if len(v) else [], dtype="int32")

        return rows.withColumn(name, nearest(F.col(vector)))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centres and squared distances to them."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
    at = d.argmin(axis=1)
    return at, np.maximum(d[np.arange(len(x)), at], 0.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _gathered(rows: DataFrame, columns: Sequence[str], size: int, width: int, put: Callable[[np.ndarray, list], None]) -> np.ndarray:
    """Sums over all rows of what ``put`` adds to a table of ``size`` x ``width`` numbers for each batch."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((size, width))
        for b in batches:
            if b.num_rows:
                put(table, [b.column(c) for c in columns])
        some = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(table[some]), pa.list_(pa.float64()))], names=["at", "v"])

    sums = rows.select(*columns).mapInArrow(summed, "at int, v array<double>").groupBy("at").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("v"))
    out = np.zeros((size, width))
    for r in sums.collect():  # a row a centre
        out[r["at"]] = r["v"]
    return out


def _of_centres(models: Sequence[np.ndarray]) -> tuple[np.ndarray, list[slice]]:
    ends = np.cumsum([len(c) for c in models]).tolist()
    return np.vstack(models), [slice(e - len(c), e) for e, c in zip(ends, models, strict=True)]


def measured(rows: DataFrame, vector: str, models: Sequence[np.ndarray], *, costs: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each model its centres' rows (count), sums, squared distances and distances, by one scan.

    Products with the centres of all models are made at once, ``BLOCK`` rows at a time.
    Without ``costs``, as rounds need none, distances are left at 0.
    """
    centres, own = _of_centres(models)
    width = centres.shape[1]

    def put(table: np.ndarray, columns: list) -> None:
        whole, squares = _matrix(columns[0]), (centres * centres).sum(axis=1)
        for start in range(0, len(whole), BLOCK):
            x = whole[start : start + BLOCK]
            d = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + squares
            hot, at_row = np.zeros(d.shape), np.arange(len(x))
            for at in own:
                hot[at_row, at.start + d[:, at].argmin(axis=1)] = 1.0
            table[:, :width] += hot.T @ x
            table[:, width] += hot.sum(axis=0)
            if costs:
                near = np.maximum(d, 0.0) * hot
                table[:, width + 1] += near.sum(axis=0)
                table[:, width + 2] += np.sqrt(near).sum(axis=0)

    table = _gathered(rows, [vector], len(centres), width + 3, put)
    return [(table[at, width], table[at, :width], table[at, width + 1], table[at, width + 2]) for at in own]


def advanced(rows: DataFrame, vector: str, starts: Sequence[np.ndarray], *, rounds: int = 100, tolerance: float = 1e-9) -> list[Model]:
    """The models that Lloyd's rounds make of ``starts``; centres without rows stay.

    A model is done when its centres' squared moves sum to ``tolerance`` at most.
    """
    models = [Model(np.asarray(c, dtype=np.float64)) for c in starts]
    moving = list(range(len(models)))
    for _ in range(rounds):
        if not moving:
            break
        found = measured(rows, vector, [models[i].centres for i in moving], costs=False)
        still = []
        for i, (n, total, _, _) in zip(moving, found, strict=True):
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], models[i].centres)
            if ((new - models[i].centres) ** 2).sum() > tolerance:
                still.append(i)
            models[i].centres = new
        moving = still
    if models:
        for m, (n, _, cost, _) in zip(models, measured(rows, vector, [m.centres for m in models]), strict=True):
            m.n, m.cost = n, float(cost.sum())
    return models


def sampled(rows: DataFrame, vector: str, seed: int, size: int = SAMPLE) -> np.ndarray:
    """Vectors of ``size`` rows at most, of the least hashes."""
    some = rows.select(vector).orderBy(F.xxhash64(vector, F.lit(seed)), vector).limit(size).toArrow()
    return _matrix(some[vector].combine_chunks()) if some.num_rows else np.zeros((0, 0))


def spread(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k starts by k-means++: each next one by its squared distance to those chosen."""
    chosen = [int(rng.integers(len(sample)))]
    far = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = far.sum()
        chosen.append(int(rng.choice(len(sample), p=far / total)) if total > 0 else int(rng.integers(len(sample))))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def restarted(rows: DataFrame, vector: str, ks: Sequence[int], *, n_init: int = 10, seed: int = 42, rounds: int = 100) -> dict[int, list[Model]]:
    """``n_init`` models of each k, all advanced together, of least cost first."""
    sample = sampled(rows, vector, seed)
    if not len(sample):
        return {}
    starts = [(k, spread(sample, k, np.random.default_rng((seed, k, i)))) for k in ks for i in range(n_init)]
    models = advanced(rows, vector, [c for _, c in starts], rounds=rounds)
    return {k: sorted((m for (j, _), m in zip(starts, models, strict=True) if j == k), key=lambda m: m.cost) for k in ks}


def cosine_silhouettes(rows: DataFrame, vector: str, models: Mapping[int, Model], *, share: Mapping[int, np.ndarray] | None = None, row: Column | None = None, seed: int = 42) -> dict[int, float]:
    """Cosine silhouette of each model on rows of unit length, by two scans for all; NaN with one cluster.

    ``share``: for each model the share of a cluster's rows to take; ``row`` is what a
    row's draw is made of.  A cluster of one row counts 0.
    """
    names, own = list(models), _of_centres([m.centres for m in models.values()])[1]
    centres = [m.centres for m in models.values()]
    draws = rows.select(vector, (F.pmod(F.xxhash64(row if row is not None else F.col(vector), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("_draw"))
    shares = [np.ones(len(models[k].centres)) if share is None else np.asarray(share[k]) for k in names]
    size, width = own[-1].stop, centres[0].shape[1]

    def taken(columns: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x, draw = _matrix(columns[0]), columns[1].to_numpy()
        for i, c in enumerate(centres):
            at = _nearest(x, c)[0]
            keep = draw < shares[i][at]
            yield i, x[keep], at[keep]

    def put_sums(table: np.ndarray, columns: list) -> None:
        for i, x, at in taken(columns):
            np.add.at(table[own[i]], at, np.c_[x, np.ones(len(x))])

    sums = _gathered(draws, [vector, "_draw"], size, width + 1, put_sums)

    def put_silhouettes(table: np.ndarray, columns: list) -> None:
        for i, x, at in taken(columns):
            n, total = sums[own[i], width], sums[own[i], :width]
            there = np.flatnonzero(n > 0)
            if len(there) < 2 or not len(x):
                continue
            away = 1 - (x @ total[there].T) / n[there]
            mine = np.searchsorted(there, at)
            a = away[np.arange(len(x)), mine] * n[at] / np.maximum(n[at] - 1, 1)
            away[np.arange(len(x)), mine] = np.inf
            b = away.min(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(a < b, 1 - a / b, np.where(a > b, b / a - 1, 0.0))
            table[own[i].start, :2] += np.where(n[at] > 1, s, 0.0).sum(), len(x)

    found = _gathered(draws, [vector, "_draw"], size, 2, put_silhouettes)
    return {k: float(found[at.start, 0] / found[at.start, 1]) if found[at.start, 1] else math.nan for k, at in zip(names, own, strict=True)}


@dataclass
class Tree:
    """A divisive tree: ``splits`` in the order they were made, each (node, its two centres); children of node i are 2i + 1 and 2i + 2."""

    splits: list[tuple[int, np.ndarray]] = field(default_factory=list)
    curve: list[tuple[int, float]] = field(default_factory=list)

    def route(self, x: np.ndarray, k: int | None = None) -> np.ndarray:
        """The node of each row when the tree has k leaves."""
        at = np.zeros(len(x), dtype=np.int64)
        for node, centres in self.splits[: None if k is None else k - 1]:
            here = np.flatnonzero(at == node)
            at[here] = 2 * node + 1 + _nearest(x[here], centres)[0]
        return at


def divisive(rows: DataFrame, vector: str, max_k: int, *, seed: int = 42, rounds: int = 20, tolerance: float = 1e-9) -> Tree:
    """One tree, split leaf by leaf of greatest cost, whose every level is a clustering: ``curve`` has (k, cost) from k = 1 on.

    Leaves that need a split are bisected together, a scan a round for all of them.
    A leaf of one distinct row is not split.
    """
    sample = sampled(rows, vector, seed)
    tree = Tree()
    if not len(sample):
        return tree
    n, total, cost, _ = measured(rows, vector, [sample.mean(axis=0)[None]])[0]
    mean = total[0] / n[0]
    leaves = {0: (float(cost[0] - n[0] * ((mean - sample.mean(axis=0)) ** 2).sum()), float(n[0]))}
    tree.curve.append((1, leaves[0][0]))
    ready: dict[int, tuple[np.ndarray, list[tuple[float, float]]]] = {}
    while len(leaves) < max_k:
        able = [i for i, (cost_, n_) in leaves.items() if n_ > 1 and cost_ > 1e-12 * n_ and not (i in ready and ready[i][1][0][1] * ready[i][1][1][1] == 0)]
        if not able:
            break
        best = max(able, key=lambda i: (leaves[i][0], -i))
        if best not in ready:
            _bisect(rows, vector, tree, [i for i in able if i not in ready], sample, ready, seed, rounds, tolerance)
            continue
        centres, sides = ready.pop(best)
        del leaves[best]
        tree.splits.append((best, centres))
        leaves |= {2 * best + 1 + side: sides[side] for side in (0, 1)}
        tree.curve.append((len(leaves), sum(c for c, _ in leaves.values())))
    return tree


def _bisect(rows: DataFrame, vector: str, tree: Tree, nodes: list[int], sample: np.ndarray, ready: dict, seed: int, rounds: int, tolerance: float) -> None:
    """Two centres for each of ``nodes``, and cost and number of rows of their sides."""
    width, route = sample.shape[1], tree.route(sample)
    pairs = {}
    for i in nodes:
        held = sample[route == i]
        if len(held) < 2:  # a leaf that the sample misses: rows of its own
            held = _rows_of(rows, vector, tree, i, seed)
        pairs[i] = spread(held, 2, np.random.default_rng((seed, i)))
    moving, sums = list(nodes), {}
    for _ in range(rounds):
        if not moving:
            break
        now = [(i, pairs[i]) for i in moving]

        def put(table: np.ndarray, columns: list, now=now) -> None:
            x = _matrix(columns[0])
            at = tree.route(x)
            for j, (i, centres) in enumerate(now):
                own = x[at == i]
                side = _nearest(own, centres)[0]
                np.add.at(table[2 * j : 2 * j + 2], side, np.c_[own, np.ones(len(own)), (own * own).sum(axis=1)])

        table = _gathered(rows, [vector], 2 * len(now), width + 2, put)
        still = []
        for j, (i, centres) in enumerate(now):
            part = table[2 * j : 2 * j + 2]
            n = part[:, width]
            new = np.where(n[:, None] > 0, part[:, :width] / np.maximum(n, 1)[:, None], centres)
            # squares about the mean, of the sides that ``centres`` make
            costs = np.maximum(part[:, width + 1] - (part[:, :width] ** 2).sum(axis=1) / np.maximum(n, 1), 0.0)
            sums[i] = centres, [(float(c), float(m)) for c, m in zip(costs, n, strict=True)]
            if ((new - centres) ** 2).sum() > tolerance:
                still.append(i)
            pairs[i] = new
        moving = still
    ready.update(sums)


def _rows_of(rows: DataFrame, vector: str, tree: Tree, node: int, seed: int) -> np.ndarray:
    """A sample of a leaf's own rows."""

    @F.pandas_udf("boolean")
    def inside(v):
        import pandas as pd

        return pd.Series(tree.route(np.stack(v.to_numpy())) == node if len(v) else [], dtype="bool")

    return sampled(rows.where(inside(F.col(vector))), vector, seed)
