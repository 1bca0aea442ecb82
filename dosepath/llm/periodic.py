"""Periodic runs of words by harmonic grid probing.

A run is a stretch of words with smallest period p that is at least ``exponent``
periods and ``least`` words long and that no neighbouring word extends.  For every
p the words at jp and (j + 1)p are compared, which is n / p tests, so all periods
of a text of n words take about n log n.  A run of p holds equal words at
``exponent`` - 1 neighbouring grid points at least; where these are equal, the
stretch is extended to both sides by comparing chunks of growing length.  Grid
points inside a stretch that is known already, of p or of a divisor of p, are
skipped: a stretch of p that a run of a divisor covers is that run.

Texts are read in Arrow batches and probed many at a time: their words, numbered
exactly (no hashes), are laid behind each other, longest text first, with a number
of its own after each, so a period costs the same few array operations for all
texts long enough for it.  Nothing is shuffled; a task holds ``STREAM`` words, or one
text where that is longer.

Nulls and edges: a null or empty text, or one of white space only, has no run and
collapses to the empty text; a null id stays null; repeated rows are searched each;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dosepath.llm.common import release, ship

ship(__name__)

STREAM = 400_000  # words that are probed at once
NEAR, FAR = 64, 1 << 16  # first and last length of the chunks that extend a stretch
RUN = "struct<start:long,length:long,period:long>"


def _right(w: np.ndarray, i: int, p: int, end: int) -> int:
    """The first place from i on at which words p apart differ."""
    size = NEAR
    while i < end:
        n = min(size, end - i)
        differ = w[i : i + n] != w[i + p : i + p + n]
        at = int(differ.argmax())
        if differ[at]:
            return i + at
        i, size = i + n, min(2 * size, FAR)
    return end


def _left(w: np.ndarray, i: int, p: int) -> int:
    """The least place such that from there to i words p apart are equal."""
    size = NEAR
    while i > 0:
        n = min(size, i)
        differ = w[i - n : i][::-1] != w[i - n + p : i + p][::-1]
        at = int(differ.argmax())
        if differ[at]:
            return i - at
        i, size = i - n, min(2 * size, FAR)
    return 0


def runs_of(w: np.ndarray, lengths: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in texts laid behind each other.

    ``lengths`` falls; each text in ``w`` is followed by one number that is nowhere else.
    """
    begins = np.r_[0, np.cumsum(lengths + 1)]
    found: list[tuple[int, int, int]] = []
    known: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by period: runs of its divisors
    p = 0
    while held := int(np.searchsorted(-lengths, -max(least, exponent * (p := p + 1)), side="right")):
        end = int(begins[held])
        same = w[: end - p : p] == w[p:end:p]
        for start, stop in known.pop(p, ()):
            same[-(-start // p) : -(-(stop - p) // p)] = False
        several = same[: len(same) - exponent + 2].copy()
        for k in range(1, exponent - 1):
            several &= same[k : len(several) + k]
        past = 0
        for j in np.flatnonzero(several):
            if (i := int(j) * p) < past:
                continue
            start, past = _left(w, i, p), _right(w, i, p, end - p)
            length = past - start + p
            if length >= max(least, exponent * p):
                found.append((start, length, p))
                for multiple in range(2 * p, length // exponent + 1, p):
                    known[multiple].append((start, start + length))
    return found


def _searched(texts: list[list[bytes]], least: int, exponent: int) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """Runs of each text, and each text without their repeats."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = pa.array([x for t in order for x in texts[t]], pa.large_binary()).dictionary_encode().indices.to_numpy()
    w = np.insert(flat.astype(np.int64), np.cumsum(lengths[order]), -1 - np.arange(len(texts)))
    begins = np.r_[0, np.cumsum(lengths[order] + 1)]
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in runs_of(w, lengths[order], least, exponent):
        k = int(np.searchsorted(begins, start, side="right")) - 1
        runs[order[k]].append((start - int(begins[k]), length, period))
    out = []
    for words, own in zip(texts, runs, strict=True):
        own.sort(key=lambda r: (r[0], r[2]))
        if own:
            kept = np.ones(len(words), bool)
            for start, length, period in own:
                kept[start + period : start + length] = False
            words = [words[i] for i in np.flatnonzero(kept)]
        out.append(b" ".join(words).decode())
    return runs, out


def periodic_runs(docs: DataFrame, *, least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, runs and collapsed text of every row of ``docs`` (doc_id, text).

    ``runs``: start (word number from 0), length and period in words, by start, then
    period; ``collapsed``: the words, joined by one space, that no run contains after
    its first period.  ``exponent`` is 3 at least.
    """
    if exponent < 3:
        raise ValueError("fewer than three periods leave no neighbouring grid points to test")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, held, first = b.column("doc_id"), b.column("text"), [], 0
            words = 0
            for at in range(b.num_rows):
                held.append((texts[at].as_py() or "").encode().split())  # at the same six characters as WORD
                words += len(held[-1])
                if words >= STREAM or at == b.num_rows - 1:
                    runs, out = _searched(held, least, exponent)
                    flat = [r for own in runs for r in own]
                    struct = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], names=["start", "length", "period"])
                    offsets = pa.array(np.r_[0, np.cumsum([len(own) for own in runs])].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(held)), pa.ListArray.from_arrays(offsets, struct), pa.array(out, pa.string())], names=["doc_id", "runs", "collapsed"])
                    held, words, first = [], 0, at + 1
        release()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(searched, f"doc_id long, runs array<{RUN}>, collapsed string")
