"""Mixing sources to target weights by the cube method.

Every source has a target of words; target / size gives whole copies of each
document and one fractional inclusion probability.  The flight phase moves the
vector of fractions along the null space of the balancing constraints, so the
source's document total and word total stay as expected while fractions reach 0
or 1.  With a window of three open documents the null space is the cross product
of (1, 1, 1) and their sizes, so a step costs a few operations.

Flights run in blocks of a source dealt by a hash (a source with a third of all
rows has a third of the blocks); a block leaves two open fractions and a reserve.
These are dealt into blocks again, level by level, until each source has one
block.  What its flight leaves open and a reserve of falling sizes are the landing
problem: of all their outcomes, the nearest to both totals.  Balance is kept exactly at every level, so only the landing moves a
source's totals, commonly by some words.

A row is a unit.  Equal rows are counted before they are dealt and get numbers, so
copies of one row, or rows of one id or of none, spread over blocks like others.

One row a source comes to the driver (its name, size and count): that bounds the
sources to some millions.

Nulls and edges: a null text has no words; a null source is a source of its own
and last; repeated rows are units each; equal ids with different texts are units
each; an empty table or source without words takes nothing; blocks and the order
in them are hashes of the row, its number among its equals and the seed, so reruns
agree however the rows are dealt.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dosepath.llm.common import ship, word_count
from dosepath.plans.staging import stage, unstage

ship(__name__)

#: Rows of a block: what one flight holds.
BLOCK = 4096
RESERVE = 12  # units that a block hands on besides the last two, and that the landing decides
MOST_BROADCAST = 100_000  # sources; more are joined by a shuffle
EQUALS = 4096  # equal rows that one row is spread to at once
UNITS = "doc_id long, unit long, nth long, source_rank int, size long, whole int, part double, again int"


def targets(sizes: Sequence[float], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is cut off goes to the rest by weight.

    Sources are full in the order of their limit over their weight; past the last
    full one, all others share at one level.
    """
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    left, open_weight = total, math.fsum(weights)
    for at, i in enumerate(order):
        if weights[i] * left < most * sizes[i] * open_weight:
            for j in order[at:]:
                out[j] = weights[j] * left / open_weight
            break
        out[i] = most * sizes[i]
        left, open_weight = max(0.0, left - out[i]), open_weight - weights[i]
    return out


def _toss(*key) -> float:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big") / 2.0**64


def flight(size: list[float], part: list[float], key) -> list[float]:
    """Fractions after the flight: all 0 or 1 but two at most, with their sum and their size-weighted sum kept."""
    part = list(part)
    eps = 1e-9
    open_: list[int] = []
    feed = iter(range(len(part)))
    step = 0
    while True:
        while len(open_) < 3:
            k = next(feed, None)
            if k is None:
                break
            if eps < part[k] < 1 - eps:
                open_.append(k)
            else:
                part[k] = float(round(part[k]))
        if len(open_) < 3:
            if len(open_) == 2 and size[open_[0]] == size[open_[1]]:
                u = (1.0, -1.0)  # equal sizes: two fractions still have a null space
            else:
                return part
        else:
            a, b, c = (size[i] for i in open_)
            u = (b - c, c - a, a - b)
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
        up = min((1 - part[i]) / v if v > 0 else part[i] / -v for i, v in zip(open_, u, strict=False) if v)
        down = min(part[i] / v if v > 0 else (1 - part[i]) / -v for i, v in zip(open_, u, strict=False) if v)
        step += 1
        move = up if _toss(key, step) * (up + down) < down else -down
        for i, v in zip(open_, u, strict=False):
            part[i] += move * v
            if part[i] < eps or part[i] > 1 - eps:
                part[i] = float(round(part[i]))
        open_ = [i for i in open_ if 0.0 < part[i] < 1.0]


def reserve(size: list[float], part: list[float]) -> list[int]:
    """Up to RESERVE open units of about the largest size, a half, a quarter ... of it: a flight leaves them to the landing."""
    free = [i for i, p in enumerate(part) if 0.0 < p < 1.0 and size[i] > 0]
    most, found = max((size[i] for i in free), default=0.0), []
    for k in range(min(RESERVE, len(free))):
        near = min(free, key=lambda i: (abs(math.log(size[i] * 2.0**k / most)), i))
        free.remove(near)
        found.append(near)
    return found


def landing(size: list[float], part: list[float]) -> list[float]:
    """Decide the open fractions (RESERVE and two at most): of all outcomes the nearest to both totals."""
    open_ = [i for i, p in enumerate(part) if 0.0 < p < 1.0]
    part = list(part)
    if open_:
        sizes, parts = np.array([size[i] for i in open_]), np.array([part[i] for i in open_])
        outcomes = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
        off = np.abs(outcomes @ sizes - sizes @ parts) + 0.05 * sizes.mean() * np.abs(outcomes.sum(axis=1) - parts.sum())
        for i, x in zip(open_, outcomes[int(off.argmin())], strict=True):
            part[i] = float(x)
    return part


def flown_but_reserve(size: list[float], part: list[float], key) -> list[float]:
    """The flight of all units but the reserve."""
    kept = reserve(size, part)
    flown = list(part)
    for i in kept:
        flown[i] = 0.0
    flown = flight(size, flown, key)
    for i in kept:
        flown[i] = part[i]
    return flown


def _flown(units: DataFrame, keys: list[str], level: int, last: bool, seed: int) -> DataFrame:
    def one(key: tuple, group: pa.Table) -> pa.Table:
        name = (seed, level, *[k.as_py() for k in key])
        cols = {c: group.column(c).to_pylist() for c in ("doc_id", "unit", "nth", "size", "part", "whole", "source_rank")}
        order = sorted(range(group.num_rows), key=lambda i: (-cols["size"][i].bit_length(), _toss(seed, level, cols["unit"][i], cols["nth"][i]), cols["part"][i]))  # large ones settle first, so landings are small
        size = [float(cols["size"][i]) for i in order]
        part = flown_but_reserve(size, [cols["part"][i] for i in order], name)
        if last:
            part = landing(size, part)
        again = [0 if p in (0.0, 1.0) else 1 for p in part]
        picked = {c: [cols[c][i] for i in order] for c in ("doc_id", "unit", "nth", "source_rank", "size", "whole")}
        return pa.table({
            "doc_id": pa.array(picked["doc_id"], pa.int64()), "unit": pa.array(picked["unit"], pa.int64()), "nth": pa.array(picked["nth"], pa.int64()), "source_rank": pa.array(picked["source_rank"], pa.int32()), "size": pa.array(picked["size"], pa.int64()),
            "whole": pa.array(picked["whole"], pa.int32()), "part": pa.array(part, pa.float64()), "again": pa.array(again, pa.int32()),
        })

    return units.groupBy(*keys).applyInArrow(one, UNITS)


def unit(docs: DataFrame) -> Column:
    """The hash of a row of ``docs`` (doc_id, text, source); rows of one hash are equal."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"), F.col("text").isNull(), F.col("source").isNull(), F.col("doc_id").isNull())


def _numbered(rows: DataFrame) -> DataFrame:
    """Each row with ``nth``, its number among its equals (from 0)."""
    some = F.floor((F.col("equals") - 1) / EQUALS)
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("equals"))
    spread = counted.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), some)))
    within = F.least(F.lit(EQUALS - 1).cast("long"), F.col("equals") - 1 - F.col("_turn") * EQUALS)
    return spread.withColumn("_in", F.explode(F.sequence(F.lit(0).cast("long"), within))).withColumn("nth", F.col("_turn") * EQUALS + F.col("_in")).drop("_turn", "_in", "equals")


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, text, source).

    Sources in code-point order (null last) have the ``weights`` in turn and
    share ``share`` times all words; no target is above ``most`` times its
    source's words.  Returns doc_id, unit (the row's hash), source, size, source_size, target, copies, taken.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), unit(docs).alias("unit"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sized = stage(_numbered(rows), "sized")
    # one row a source
    found = sorted(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    if not found:
        return spark.createDataFrame([], "doc_id long, unit long, source string, size long, source_size long, target double, copies int, taken long")
    sizes = [float(r["size"]) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), most)
    rows = []
    for i, r in enumerate(found):
        rate = min(most, goal[i] / sizes[i]) if sizes[i] else 0.0
        whole = int(rate + 1e-12)
        rows.append((i, r["source"], int(r["size"]), goal[i], whole, max(0.0, rate - whole), max(1, -(-r["n"] // BLOCK))))
    plan = spark.createDataFrame(rows, "source_rank int, source string, source_size long, target double, whole int, part double, blocks int")
    units = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select("doc_id", "unit", "nth", "source_rank", "size", "whole", "part", "blocks")
    dealt = lambda level, blocks: F.pmod(F.xxhash64("unit", "nth", F.lit(seed + level)), blocks.cast("long"))
    units = units.withColumn("block", dealt(0, F.col("blocks")))
    settled, blocks, level = [], max(r[6] for r in rows), 0
    while True:
        last = blocks == 1
        done = stage(_flown(units, ["source_rank", "block"], level, last, seed), f"flight{level}")
        settled.append(done.where(F.col("again") == 0))
        if last:
            break
        level, blocks = level + 1, -(-blocks * (RESERVE + 2) // BLOCK)
        units = done.where(F.col("again") == 1).withColumn("block", dealt(level, F.lit(blocks)))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    unstage(sized)
    copies = F.col("whole") + F.col("part").cast("int")
    names = plan.select("source_rank", "source", "source_size", "target")
    names = F.broadcast(names) if len(rows) <= MOST_BROADCAST else names
    return out.join(names, "source_rank").select("doc_id", "unit", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
