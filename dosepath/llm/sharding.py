"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A keyed Feistel network is a bijection of 0 .. 4**h - 1.  Values that leave
0 .. n - 1 are fed back in until they return (cycle walking), which keeps the
map a bijection of the n row numbers.  The permuted number p gives shard
``p % shards`` and slot ``p // shards``: shard sizes differ by one at most, slots
have no gap, and either direction is computed without a table or a shuffle.

Nulls and edges: a null text has no bytes (size 1, crc32 0); a null doc_id is
numbered first; equal rows get different slots; an empty table gives no rows;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dosepath.llm.common import number_rows, ship

ship(__name__)

PRIME = (1 << 31) - 1
ROUNDS = 6


def _keys(seed: int) -> list[tuple[int, int]]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return [(int(rng.integers(1, PRIME)), int(rng.integers(0, PRIME))) for _ in range(ROUNDS)]


def _mixed(half: np.ndarray, key: tuple[int, int], mask: int) -> np.ndarray:
    t = (half % PRIME * key[0] + key[1]) % PRIME
    t = (t * t + half) % PRIME
    return ((t * key[0] + (t >> 15)) % PRIME >> 3 ^ t) & mask


def _once(x: np.ndarray, bits: int, keys: list[tuple[int, int]], back: bool) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ _mixed(left, key, mask), left
        else:
            left, right = right, left ^ _mixed(right, key, mask)
    return left << bits | right


def permute(x: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The permutation of 0 .. n - 1 (or its inverse) at the int64 values ``x``; n up to 2**60."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = _keys(seed)
    out = _once(np.asarray(x, dtype=np.int64), bits, keys, back)
    while (far := out >= n).any():
        out[far] = _once(out[far], bits, keys, back)
    return out


def shard_slot(row_number: np.ndarray, n: int, shards: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of global row numbers among n rows."""
    p = permute(row_number, n, seed)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = 0) -> np.ndarray:
    """The global row number that lies at a shard and slot: the inverse of shard_slot."""
    return permute(np.asarray(slot, dtype=np.int64) * shards + shard, n, seed, back=True)


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20_241) -> DataFrame:
    """Deal all rows of ``docs`` (doc_id, text) into ``shards`` shards of equal row counts.

    Only doc_id, size and crc32 are moved, never a text.  The order that numbers
    the rows is (doc_id, crc32, size): a rerun, whatever its partitions, gives
    the same shard and slot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows, n = number_rows(slim, "doc_id", "text_crc32", "size")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, slot = shard_slot(b.column("row_number").to_numpy(), n, shards, seed)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("size"), b.column("text_crc32"), b.column("row_number"), pa.array(shard.astype(np.int32)), pa.array(slot)],
                names=["doc_id", "size", "text_crc32", "row_number", "shard", "slot"],
            )

    return rows.select("doc_id", "size", "text_crc32", "row_number").mapInArrow(dealt, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")
