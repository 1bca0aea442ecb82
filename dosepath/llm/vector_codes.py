"""Vector codes: a codebook of entries for each part of the vectors, by Elkan's form of Lloyd's rounds.

Vectors become integers and are cut into equal parts.  A part keeps an upper bound of
its distance to its entry and one lower bound for every entry of its codebook; a
round's table of bounds is written and is the next round's input.  When entries
move, the bounds are shifted by how far they moved.  By the triangle inequality an
entry is no nearer than the own one if the part's upper bound is below the entry's
lower bound or below half of the two entries' distance.  Both tests are strict and on
safe sides of the rounding, so an equal distance is never pruned; what is left
is decided by integer squared distances, ties to the lower index.

Lower bounds are kept as one byte each, in units of a part's greatest one, rounded
down.  Sums of entries are made in a task's arrays, then added by entry: a task sends
one row for an entry, however many parts it has.  The driver holds the codebooks only.

Nulls and edges: vectors that are null or hold null or non-finite components are left
out; null ids stay and come last where the first entries are chosen; rows of one id
are in the order of their vectors; repeated rows count each.  Vectors of different
lengths have codebooks of their own, so codebooks are as many as lengths.  A length
that the parts do not divide is filled with zeros; an empty vector has empty parts and
code 0.  Fewer rows than entries make fewer entries.  Integer components beyond
+-``LIMIT`` are taken as ``LIMIT``: products beyond it leave a long.  An empty table
gives no rows.  Columns of other names are carried only if named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dosepath.llm.common import release, ship
from dosepath.llm.vectors import by_length, matrix
from dosepath.plans.staging import stage, unstage

ship(__name__)

LIMIT = 1 << 26
ROWS = 4096  # rows whose bounds are unpacked at once
PAIRS = 1 << 17  # parts and entries that are compared at once
DOWN, UP = 1 - 1e-6, 1 + 1e-6  # beyond any rounding of doubles and single floats here
STATE = "codes binary, upper binary, unit binary, lower binary"


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if 4 * x.shape[1] * int(most) ** 2 < 1 << 53 else np.int64
    x, entries = x.astype(kind), entries.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)).astype(np.int64)


def _pairs(x: np.ndarray, entries: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of the named pairs."""
    out = np.empty(len(row), np.int64)
    for lo in range(0, len(row), PAIRS):
        gap = x[row[lo : lo + PAIRS]] - entries[entry[lo : lo + PAIRS]]
        out[lo : lo + PAIRS] = np.einsum("ij,ij->i", gap, gap)
    return out


@dataclass
class Book:
    """One part's entries, how far they moved last, and halves of their distances (rounded down)."""

    entries: np.ndarray
    moved: np.ndarray
    half: np.ndarray
    near: np.ndarray  # half of the distance to the nearest other entry

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray | None = None) -> Book:
        half = np.sqrt(squares(entries, entries).astype(np.float64)) / 2 * DOWN
        np.fill_diagonal(half, np.inf)
        gap = entries - (entries if before is None else before)
        return cls(entries, np.sqrt((gap * gap).sum(axis=1).astype(np.float64)) * UP, half.astype(np.float32), half.min(axis=1) * DOWN)


def first_assigned(x: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries, upper bounds and lower bounds, of all distances."""
    d = squares(x, book.entries)
    own = d.argmin(axis=1)  # the lowest index of the least
    root = np.sqrt(d.astype(np.float64))
    return own, root[np.arange(len(x)), own] * UP, root * DOWN


def assigned(x: np.ndarray, book: Book, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same after entries moved, from the bounds before: distances only where no inequality decides."""
    own, upper = own.copy(), (upper + book.moved[own]) * UP
    lower = np.maximum(lower - book.moved, 0.0)
    some = np.flatnonzero(upper >= book.near[own])

    def open_(rows: np.ndarray) -> np.ndarray:
        most = upper[rows, None]
        return (lower[rows] <= most) & (book.half[own[rows]] <= most)  # not the own entry: its half is infinite

    some = some[open_(some).any(axis=1)]
    d = _pairs(x, book.entries, some, own[some])
    upper[some], lower[some, own[some]] = np.sqrt(d) * UP, np.sqrt(d) * DOWN
    left = open_(some)
    at, entry = np.nonzero(left)
    if not len(at):
        return own, upper, lower
    far = _pairs(x, book.entries, some[at], entry)
    lower[some[at], entry] = np.sqrt(far) * DOWN
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    least = np.minimum.reduceat(far, begin)
    first = np.flatnonzero(far == np.repeat(least, np.diff(np.r_[begin, len(at)])))
    row, pick = np.unique(at[first], return_index=True)  # of each row's least, the lowest index
    entry = entry[first[pick]]
    better = (least < d[row]) | ((least == d[row]) & (entry < own[some[row]]))
    own[some[row[better]]], upper[some[row[better]]] = entry[better], np.sqrt(least[better]) * UP
    return own, upper, lower


def _packed(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit = np.maximum(lower.max(axis=1, initial=0.0) / 255, 1e-3).astype(np.float32)
    return unit, np.floor(lower / unit[:, None] * DOWN).clip(0, 255).astype(np.uint8)


def _parts(column: pa.Array, parts: int) -> np.ndarray:
    """Integer vectors as rows x parts x width, filled with zeros."""
    v = matrix(column).astype(np.int64)
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % parts)))
    return v.reshape(len(v), parts, -1)


def _bytes(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    width = a.nbytes // max(1, len(a))
    return pa.array([a[i].tobytes() for i in range(len(a))], pa.binary(width) if width else pa.binary()).cast(pa.binary())


def _unpacked(column: pa.Array, kind, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(rows, -1)


def _round(table: DataFrame, carry: list[str], books: dict[int, list[Book]], parts: int, first: bool, last: bool) -> DataFrame:
    """One assignment of all parts; the last gives codes and errors in place of bounds."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                for d, b in by_length(whole.slice(lo, ROWS), "v").items():
                    x, n = _parts(b.column("v"), parts), b.num_rows
                    codes, uppers, units, lowers = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.zeros((n, parts), np.float32), []
                    error = np.zeros(n, np.int64)
                    if not first:
                        was, above, scale = _unpacked(b.column("codes"), np.uint8, n), _unpacked(b.column("upper"), np.float32, n), _unpacked(b.column("unit"), np.float32, n)
                        below = _unpacked(b.column("lower"), np.uint8, n).reshape(n, parts, -1)
                    for p, book in enumerate(books[d]):
                        if first:
                            own, upper, lower = first_assigned(x[:, p], book)
                        else:
                            own, upper, lower = assigned(x[:, p], book, was[:, p].astype(np.int64), above[:, p].astype(np.float64), below[:, p] * scale[:, p, None].astype(np.float64))
                        codes[:, p], uppers[:, p] = own, upper * UP
                        if last:
                            error += _pairs(x[:, p], book.entries, np.arange(n), own)
                        else:
                            units[:, p], low = _packed(lower)
                            lowers.append(low)
                    made = [pa.array([c.tobytes().hex() for c in codes]), pa.array(error)] if last else [_bytes(codes), _bytes(uppers), _bytes(units), _bytes(np.stack(lowers, axis=1))]
                    names = ["code", "error"] if last else ["codes", "upper", "unit", "lower"]
                    yield pa.RecordBatch.from_arrays([b.column(c) for c in [*carry, "v"]] + made, names=[*carry, "v", *names])
        release()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*carry, "v").schema)
    return table.mapInArrow(done, f"{kept}, {'code string, error long' if last else STATE}")


def _moved(state: DataFrame, books: dict[int, list[Book]], parts: int) -> dict[int, list[Book]]:
    """Codebooks of the floors of the entries' means."""
    sizes = {d: (len(b[0].entries), b[0].entries.shape[1]) for d, b in books.items()}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {d: np.zeros((parts, k), np.int64) for d, (k, _) in sizes.items()}
        totals = {d: np.zeros((parts, k, w), np.int64) for d, (k, w) in sizes.items()}
        for whole in batches:
            for d, b in by_length(whole, "v").items():
                x, codes, k = _parts(b.column("v"), parts), _unpacked(b.column("codes"), np.uint8, b.num_rows), sizes[d][0]
                for p in range(parts):
                    counts[d][p] += np.bincount(codes[:, p], minlength=k)
                    for c in range(x.shape[2]):
                        totals[d][p, :, c] += np.bincount(codes[:, p], weights=x[:, p, c], minlength=k).astype(np.int64)
        for d, n in counts.items():
            part, entry = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), d, np.int32)), pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(totals[d][part, entry]), pa.list_(pa.int64()))], names=["d", "part", "entry", "n", "total"])

    rows = state.select("v", "codes").mapInArrow(summed, "d int, part int, entry int, n long, total array<long>")
    width = max(w for _, w in sizes.values())
    sums = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")) for i in range(width)]
    new = {d: [b.entries.copy() for b in own] for d, own in books.items()}
    for r in rows.groupBy("d", "part", "entry").agg(F.sum("n").alias("n"), F.array(*sums).cast("array<decimal(38,0)>").alias("total")).collect():  # a row an entry
        new[r.d][r.part][r.entry] = [int(t) // r.n for t in r.total[: sizes[r.d][1]]]
    return {d: [Book.of(e, b.entries) for e, b in zip(new[d], own, strict=True)] for d, own in books.items()}


@dataclass
class Coded:
    """``rows``: the carried columns, code (two hex digits a part) and error; ``books``: by vector length, parts x entries x width."""

    rows: DataFrame
    books: dict[int, np.ndarray]

    def digest(self, length: int) -> str:
        """sha256 of all entries' components, by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.books[length].ravel().tolist())).encode()).hexdigest()

    def decoded(self, code: str, length: int) -> np.ndarray:
        """The integer vector that a code stands for."""
        return np.concatenate([self.books[length][p, c] for p, c in enumerate(bytes.fromhex(code))])[:length]


def compressed(table: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", carry: Sequence[str] = (), parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> Coded:
    """Codes of all usable vectors of ``table`` after ``rounds`` rounds.

    Components become floor(scale * x).  A codebook starts as its part of the
    ``entries`` (256 at most) least ids' vectors; entries without parts stay.
    ``rows`` also has ``n_components``, the vector's length.
    """
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x * scale))).cast("int"))
    carry = list(dict.fromkeys([vec_id, *carry]))
    now = table.where(v.isNotNull() & ~bad).select(*carry, whole.alias("v"))
    books: dict[int, list[Book]] = {}
    for r in now.groupBy(F.size("v").alias("d")).count().collect():  # a row a length
        some = now.where(F.size("v") == r.d).orderBy(F.col(vec_id).asc_nulls_last(), "v").limit(min(entries, 256)).select("v").toArrow()
        x = _parts(some["v"].combine_chunks(), parts)
        books[r.d] = [Book.of(x[:, p]) for p in range(parts)]
    for k in range(rounds):
        new = stage(_round(now, carry, books, parts, not k, False), f"bounds{k}")
        if k:
            unstage(now)
        now, books = new, _moved(new, books, parts) if books else {}
    out = stage(_round(now, carry, books, parts, not rounds, True).withColumn("n_components", F.size("v")).drop("v"), "codes")
    unstage(now)
    return Coded(out, {d: np.stack([b.entries for b in own]) for d, own in books.items()})
