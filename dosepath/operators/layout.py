"""A layout that keeps neighbours near: the spectrum of a neighbour graph over anchors.

A graph of all pairs would be the square of the rows.  So rows are tied to their
nearest anchors (a sample of ``ANCHORS`` rows at most), with weights that fall with
the distance, and two rows are as near as the anchors that they share.  The
graph's matrix over anchors is summed in one scan, its leading eigenvectors are
found by power iteration on the driver (anchors x anchors numbers), and a second
scan places every row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from dosepath.operators import lloyd

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANCHORS, NEAR = 512, 6
FAR_SHARE = 0.02  # of the graph's weight: ties of all anchors by distance, which join separate groups


def ties(x: np.ndarray, anchors: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest anchors and its weights on them, which sum to 1."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ anchors.T) + (anchors * anchors).sum(axis=1)
    at = np.argsort(d, axis=1, kind="stable")[:, :near]
    own = np.maximum(np.take_along_axis(d, at, axis=1), 0.0)
    weight = np.exp(-own / np.maximum(own[:, -1:], 1e-12))
    return at, weight / weight.sum(axis=1, keepdims=True)


def leading(matrix: np.ndarray, count: int, *, seed: int = 42, rounds: int = 500, tolerance: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix without negative ones, and their vectors, by power iteration on a block."""
    width = min(count + 32, len(matrix))  # more than asked for: vectors of close values settle together
    block, before = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(matrix), width)))[0], np.zeros(count)
    power = matrix / max(np.abs(matrix).sum(axis=1).max(initial=0.0), 1e-300)
    power = np.linalg.matrix_power(power, 8)  # eight steps at once
    for _ in range(rounds):
        block = np.linalg.qr(power @ block)[0]
        now = np.diag(block.T @ matrix @ block)[:count]
        if np.abs(now - before).max(initial=0.0) <= tolerance * max(1.0, np.abs(now).max(initial=0.0)):
            break
        before = now
    values, turn = np.linalg.eigh(block.T @ matrix @ block)
    return values[::-1][:count], (block @ turn)[:, ::-1][:, :count]


def neighbour_layout(rows: DataFrame, vector: str, *, keep: Sequence[str] = (), dims: int = 2, anchors: int = ANCHORS, near: int = NEAR, seed: int = 42) -> DataFrame:
    """``keep`` and coordinates at_1 .. of every row of ``rows`` (``vector``: array of doubles without nulls).

    Fewer distinct anchors than ``dims`` + 1 leave the coordinates beyond at 0.  A
    coordinate's sign is that of its first anchor other than 0.
    """
    chosen = np.unique(lloyd.sampled(rows, vector, seed, anchors), axis=0)
    near = min(near, len(chosen))
    size, basis = len(chosen), np.zeros((len(chosen), dims))

    if size > 1:

        def put(table: np.ndarray, columns: list) -> None:
            at, weight = ties(lloyd._matrix(columns[0]), chosen, near)
            for i in range(near):
                for j in range(near):
                    np.add.at(table, (at[:, i], at[:, j]), weight[:, i] * weight[:, j])

        graph = lloyd._gathered(rows, [vector], size, size, put)
        # groups that share no anchor are placed by how far their anchors are from each other
        own = (chosen * chosen).sum(axis=1)
        apart = np.maximum(own[:, None] + own - 2 * chosen @ chosen.T, 0.0)
        wide = np.exp(-apart / apart.mean())
        graph += FAR_SHARE * graph.sum() / wide.sum() * wide
        degree = graph.sum(axis=1)
        scale = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1e-300)), 0.0)
        values, vectors = leading(scale[:, None] * graph * scale, min(dims + 1, size), seed=seed)
        # the first one is the same for all rows
        found = scale[:, None] * vectors[:, 1:] / np.sqrt(np.maximum(values[1:], 1e-12))
        first = np.array([c[np.flatnonzero(np.abs(c) > 1e-9)[:1]].sum() for c in found.T])
        basis[:, : found.shape[1]] = found * np.where(first < 0, -1.0, 1.0)

    names = [f"at_{i + 1}" for i in range(dims)]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, weight = ties(lloyd._matrix(b.column(vector)), chosen, near)
                place = (basis[at] * weight[:, :, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(place[:, i]) for i in range(dims)]], names=[*keep, *names])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*keep, vector).mapInArrow(placed, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], *[f"{n} double" for n in names]]))
