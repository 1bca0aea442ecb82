"""N-gram Jaccard join as a blocked sparse product of documents by word n-grams.

The product's rows are distinct sets of n-grams (copies share a row), its columns
n-grams.  Columns are ordered by a hash, frequent n-grams last, and a row takes
part with its prefix only: two sets of Jaccard similarity t share a column of
their prefixes of n - ceil(t n) + 1.  Columns are dealt into blocks; a block gets
packed arrays (one shuffle row for a block and a chunk of documents), multiplies
its columns with numpy and gives the overlap count of every pair of rows in it.
Summed over the blocks, a pair is discarded when its overlap and what the sizes
leave for the suffixes cannot reach the size-derived bound ceil(t (a + b) / (1 + t)).

A column that very many rows hold is not multiplied out with the others.  Its
rows are compared with one hub row first; where that leaves rows of different
components together, their whole sets are multiplied in square blocks, and a
block returns a spanning forest of its links instead of its pairs.

Survivors are verified on whole n-gram sets: first the links to each row's least
partner, then, of the others, those that still join two components.  Result:
one row a document with the least doc_id that links reach.

n-grams are 64-bit hashes of the words' 64-bit hashes, and rows 64-bit hashes of
their sets; everything is otherwise exact.

Nulls and edges: a null or empty text has no n-gram and links with nothing; a
text of fewer words than n is one n-gram; a null doc_id takes part, and its
component is null only where no id is in it; repeated rows share a component;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from dosepath.llm.common import release, ship
from dosepath.llm.components import components
from dosepath.plans.staging import stage, unstage

ship(__name__)

CHUNK_BYTES = 1 << 21  # text that is hashed at once
COUNT_AT_ONCE = 1 << 21  # n-grams that are counted at once
HOT = 64  # a column with more rows is frequent
MOST_HOT = 1 << 20  # frequent columns that are broadcast, 8 MB
BLOCK_ENTRIES = 1_000_000
DENSE = 100_000  # n-grams of a side of a block of whole sets
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64(salt * int(BASE) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Distinct n-gram hashes of many texts at once."""

    def __init__(self, n: int):
        self.n = n
        self.inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        self.powers = self.back = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            self.powers = np.r_[np.uint64(1), np.full(size - 1, BASE)].cumprod(dtype=np.uint64)
            self.back = np.r_[np.uint64(1), np.full(size - 1, self.inverse)].cumprod(dtype=np.uint64)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of every word: a-z for A-Z, words parted by ASCII white space."""
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        low = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        space = np.r_[True, (raw == 32) | ((raw >= 9) & (raw <= 13))]
        starts = np.flatnonzero(space[:-1] & ~space[1:])
        ends = np.flatnonzero(~space[:-1] & space[1:])
        self._grow(len(raw) + 1)
        sums = np.r_[np.uint64(0), ((low.astype(np.uint64) + np.uint64(1)) * self.powers[: len(raw)]).cumsum(dtype=np.uint64)]
        hashed = mix((sums[ends] - sums[starts]) * self.back[starts], 1)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        return hashed, np.searchsorted(bounds, starts, side="right")

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the distinct n-grams, sorted."""
        w, text = self.words(texts)
        count = np.bincount(text, minlength=len(texts))
        n = self.n
        parts = []
        if len(w) >= n:
            inside = text[: len(w) - n + 1] == text[n - 1 :]
            s = np.zeros(len(w) - n + 1, np.uint64)
            for k in range(n):
                s = s * BASE + w[k : len(w) - n + 1 + k]
            parts.append((text[: len(s)][inside], mix(s[inside], 2)))
        first = np.cumsum(count) - count
        for size in range(1, n):
            short = np.flatnonzero(count == size)
            s = np.full(len(short), size, np.uint64)
            for k in range(size):
                s = s * BASE + w[first[short] + k]
            parts.append((short, mix(s, 3)))
        t, h = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        order = np.lexsort((h, t))
        t, h = t[order], h[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1])] if len(t) else np.zeros(0, bool)
        return t[new], h[new]


def chunks(batches: Iterator[pa.RecordBatch], hasher: Hasher):
    """(ids, sizes, set hashes, text of each n-gram, n-grams) for chunks of bounded bytes."""
    for b in batches:
        ids, texts = b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary())
        size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        lo = 0
        while lo < len(ids):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), CHUNK_BYTES, side="right")))
            t, h = hasher.sets([x or b"" for x in texts.slice(lo, hi - lo).to_pylist()])
            count = np.bincount(t, minlength=hi - lo)
            marks = np.r_[np.uint64(0), mix(h, 4).cumsum(dtype=np.uint64)]
            end = np.cumsum(count)
            whole = mix((marks[end] - marks[end - count]) ^ mix(count.astype(np.uint64), 5), 6)
            yield ids[lo:hi], count, whole, t, h
            lo = hi


def _first_seen(whole: np.ndarray, count: np.ndarray, seen: set) -> np.ndarray:
    """Which texts have a set that this task has not had yet."""
    new = np.zeros(len(whole), bool)
    for i, (x, c) in enumerate(zip(whole.tolist(), count.tolist(), strict=True)):
        if c and x not in seen:
            seen.add(x)
            new[i] = True
    return new


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (kind 0: doc_id, n, set) and of n-grams that recur in a task (kind 1: set is the n-gram, n its count)."""

    def surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, held, waiting = Hasher(n), set(), [], 0

        def counted():
            h = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
            times = np.diff(np.r_[first, len(h)])
            many = times > 1
            return rows([None] * int(many.sum()), times[many], h[first[many]], 1)

        def rows(ids, count, keys, kind):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids, pa.int64()), pa.array(count.astype(np.int64)), pa.array(keys.view(np.int64))], names=["kind", "doc_id", "n", "set"])

        for ids, count, whole, t, h in chunks(batches, hasher):
            yield rows(ids, count, whole, 0)
            new = _first_seen(whole, count, seen)
            held.append(h[new[t]])
            waiting += len(held[-1])
            if waiting >= COUNT_AT_ONCE:
                yield counted()
                held, waiting = [], 0
        yield counted()
        held.clear()
        release()

    return docs.mapInArrow(surveyed, "kind int, doc_id long, n long, set long")


def _packed(docs: DataFrame, n: int, num: int, den: int, hot: np.ndarray, blocks: int) -> DataFrame:
    """Prefix entries, packed by block; block -1 holds those of frequent columns."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(n), set()
        maybe = np.zeros(1 << 20, bool)
        maybe[(hot & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for _, count, whole, t, h in chunks(batches, hasher):
            new = _first_seen(whole, count, seen)
            keep = new[t]
            t, h = t[keep], h[keep]
            frequent = maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
            frequent[frequent] = np.isin(h[frequent], hot)
            order = np.lexsort((h, frequent, t))
            t, h, frequent = t[order], h[order], frequent[order]
            begin = np.searchsorted(t, np.arange(len(count)))
            place = np.arange(len(t)) - begin[t]
            prefix = count - -(-count * num // den) + 1
            keep = place < prefix[t]
            t, h, frequent = t[keep], h[keep], frequent[keep]
            if not len(t):
                continue
            hots = np.bincount(t[frequent], minlength=len(count))
            block = np.where(frequent, -1, (mix(h, 7) % np.uint64(blocks)).astype(np.int64))
            order = np.argsort(block, kind="stable")
            t, h, block = t[order], h[order], block[order]
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            out = []
            for lo, hi in zip(cuts, [*cuts[1:], len(block)], strict=True):
                rows, at = np.unique(t[lo:hi], return_inverse=True)
                out.append((int(block[lo]), whole[rows].tobytes(), count[rows].astype(np.uint32).tobytes(), hots[rows].astype(np.uint32).tobytes(), at.astype(np.uint32).tobytes(), h[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*out, strict=True))], names=["block", "sets", "sizes", "hots", "at", "keys"])
        release()

    return docs.mapInArrow(packed, "block int, sets binary, sizes binary, hots binary, at binary, keys binary")


def _unpacked(sets, sizes, hots, at, keys):
    """Arrays (n-gram, set, size, hots) of packed rows."""
    cols = [[], [], [], []]
    for s, z, f, a, k in zip(sets, sizes, hots, at, keys, strict=True):
        a = np.frombuffer(a, np.uint32)
        for c, x in zip(cols, (np.frombuffer(k, np.uint64), np.frombuffer(s, np.uint64)[a], np.frombuffer(z, np.uint32)[a], np.frombuffer(f, np.uint32)[a]), strict=True):
            c.append(x)
    return [np.concatenate(c) for c in cols]


PAIRS = "a long, b long, na int, nb int, shared int, spare int, late long"


def _product(packed: DataFrame, num: int, den: int, limit: int) -> DataFrame:
    """Overlap counts of the pairs of each block; columns with over ``limit`` rows come back as rows with ``late``."""

    def multiplied(key: tuple, group: pa.Table) -> pa.Table:
        k, s, z, f = _unpacked(*[group.column(c).to_pylist() for c in ("sets", "sizes", "hots", "at", "keys")])
        order = np.lexsort((s, k))
        k, s, z, f = k[order], s[order], z[order], f[order]
        new = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]  # copies from different tasks
        k, s, z, f = k[new], s[new], z[new], f[new]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[first, len(k)])
        late = k[first[size > limit]]
        run = np.repeat(size, size)
        keep = (run > 1) & (run <= limit)
        k, s, z, f = k[keep], s[keep], z[keep], f[keep]
        found, total = [], 0

        def summed(parts):
            a, b, na, nb, c, spare = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((b, a))
            a, b, na, nb, c, spare = (x[order] for x in (a, b, na, nb, c, spare))
            start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, int)
            return [(a[start], b[start], na[start], nb[start], np.add.reduceat(c, start) if len(start) else c, spare[start])]

        step = 1
        while True:
            same = np.flatnonzero(k[step:] == k[:-step]) if step < len(k) else []
            if not len(same):
                break
            i, j = same, same + step
            ok = den * np.minimum(z[i], z[j]).astype(np.int64) >= num * np.maximum(z[i], z[j]).astype(np.int64)
            i, j = i[ok], j[ok]
            found.append((s[i], s[j], z[i], z[j], np.ones(len(i), np.int32), np.minimum(f[i], f[j])))
            total += len(i)
            if total > 4_000_000:
                found = summed(found)
                total = len(found[0][0])
            step += 1
        found = summed(found) if found else [tuple(np.zeros(0, np.uint64) for _ in range(6))]
        a, b, na, nb, c, spare = found[0]
        none = np.zeros(len(late), np.int64)
        del k, s, z, f, found
        release()
        i32 = lambda x: pa.array(np.r_[x.astype(np.int32), none.astype(np.int32)])
        return pa.table({"a": pa.array(np.r_[a.view(np.int64), none]), "b": pa.array(np.r_[b.view(np.int64), none]), "na": i32(na), "nb": i32(nb), "shared": i32(c), "spare": i32(spare), "late": pa.array([None] * len(a) + late.view(np.int64).tolist(), pa.int64())})

    return packed.where("block >= 0").groupBy("block").applyInArrow(multiplied, PAIRS)


def _hot_entries(packed: DataFrame) -> DataFrame:
    """(key, set, n) of the prefix entries of frequent columns."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k, s, z, _ = _unpacked(*[b.column(c).to_pylist() for c in ("sets", "sizes", "hots", "at", "keys")])
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(s.view(np.int64)), pa.array(z.astype(np.int32))], names=["key", "set", "n"])

    return packed.where("block = -1").mapInArrow(opened, "key long, set long, n int").distinct()


def _id_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each of 2**k hashes of doc_id, built on the executors; at most 64 MB. Few documents pass it besides ``ids``."""
    slots = 1 << min(29, max(15, (16 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(slots).cast("long"))
    parts = ids.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << 15) - 1)).alias("bits"))
    bits = np.zeros(slots >> 3, np.uint8)
    for r in parts.collect():  # 4 KB a part
        bits[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return bits, slots


def _sets_of(docs: DataFrame, wanted: DataFrame, owner: DataFrame, n: int) -> DataFrame:
    """(set, grams): whole n-gram sets of one document for each ``wanted`` set, and of few others.

    Documents are picked by a bit filter where they lie, so no text is shuffled.
    """
    bits, slots = _id_filter(owner.join(wanted, "set", "left_semi").select("doc_id"))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("at").to_numpy()
            yield b.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, count, whole, _, h in chunks(picked(batches), Hasher(n)):
            end = np.cumsum(count)
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array([h[e - c : e].tobytes() for c, e in zip(count, end, strict=True)], pa.binary())], names=["set", "grams"])
        release()

    own = docs.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(slots).cast("long")))
    return own.mapInArrow(hashed, "set long, grams binary").join(wanted, "set", "left_semi").dropDuplicates(["set"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked) of ``pairs`` by the intersection of whole sets."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("ga"), b.column("gb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])
        release()

    left, right = sets.select(F.col("set").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("set").alias("b"), F.col("grams").alias("gb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(compared, "a long, b long, linked boolean")


def _dense_links(entries: DataFrame, hubs: DataFrame, roots: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that join components among the rows of frequent columns.

    Rows that frequent columns hold together form a cluster.  A cluster of more
    than one component is dealt by classes of size, which are a factor of den / num
    apart, so only rows of one class or of neighbouring ones can link; a class is
    dealt into cells by a hash, and two cells make a square block of whole sets.  A
    task multiplies one block and returns a spanning forest of its links, so what
    leaves it grows with the rows, not with their pairs.
    """
    together = entries.select("key", "set").join(hubs.select("key", F.col("a").alias("hub")), "key").select("set", "hub").distinct()
    cluster = stage(components(together, "set", "hub"), "clusters").select(F.col("node").alias("set"), F.col("root").alias("cluster"))
    marked = cluster.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    marked = marked.join(entries.select("set", "n").distinct(), "set")
    split = marked.groupBy("cluster").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("n").alias("m")).where(F.col("lo") != F.col("hi"))
    own_class = F.when(F.col("m") > DENSE, F.floor(F.log(F.col("n").cast("double")) / math.log(den / num))).otherwise(F.lit(0).cast("long"))
    marked = stage(marked.join(split.select("cluster", "m"), "cluster").select("cluster", "set", "root", "n", own_class.alias("class")), "marked")
    cells = stage(marked.groupBy("cluster", "class").agg(F.ceil(F.sum("n") / DENSE).alias("parts")), "cells")  # a row a class
    near = cells.withColumn("own", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)))
    near = near.groupBy("cluster", F.col("own").alias("class")).agg(F.collect_list(F.struct("class", "parts")).alias("others"), F.max(F.when(F.col("own") == F.col("class"), F.col("parts"))).alias("parts"))
    dealt = marked.join(near.where("parts is not null"), ["cluster", "class"]).withColumn("part", F.pmod(F.xxhash64("set", F.lit(11)), F.col("parts")))
    dealt = dealt.select("cluster", "set", "root", F.struct("class", "part").alias("cell"), F.explode("others").alias("o")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o.parts") - 1)))
    other = F.struct(F.col("o.class").alias("class"), F.col("p").alias("part"))
    dealt = dealt.select("cluster", "set", "root", "cell", F.least("cell", other).alias("i"), F.greatest("cell", other).alias("j"))
    dealt = dealt.select("cluster", F.concat_ws(":", "i.class", "i.part").alias("i"), F.concat_ws(":", "j.class", "j.part").alias("j"), (F.col("cell") == F.col("i")).cast("int").alias("part"), "set", "root")
    dealt = dealt.join(sets, "set")

    def multiplied(key: tuple, group: pa.Table) -> pa.Table:
        ids, root, part = (group.column(c).to_numpy() for c in ("set", "root", "part"))
        grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("grams")]
        size = np.array([len(x) for x in grams])
        _, col = np.unique(np.concatenate(grams), return_inverse=True)
        row = np.repeat(np.arange(len(ids)), size)
        order = np.argsort(col, kind="stable")
        posted, ends = row[order], np.cumsum(np.bincount(col))
        begins = np.r_[0, ends[:-1]]
        within = key[1].as_py() == key[2].as_py()
        parent = {r: r for r in root.tolist()}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out, at = ([], []), np.r_[0, np.cumsum(size)]
        for x in range(len(ids)):
            both = np.zeros(len(ids), np.int64)
            for lo in range(at[x], at[x + 1], 4096):
                cols = col[lo : min(lo + 4096, at[x + 1])]
                times = ends[cols] - begins[cols]
                places = np.repeat(begins[cols] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
                both += np.bincount(posted[places], minlength=len(ids))
            hit = den * both >= num * (size[x] + size - both)
            hit[: x + 1] = False
            if not within:
                hit &= part != part[x]
            for y in np.flatnonzero(hit & (root != root[x])):
                p, q = find(int(root[x])), find(int(root[y]))
                if p != q:
                    parent[p] = q
                    out[0].append(int(ids[x]))
                    out[1].append(int(ids[y]))
        release()
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(multiplied, "a long, b long")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    return pairs.where(F.col("ra") != F.col("rb"))


def _hot_columns(survey: DataFrame) -> tuple[np.ndarray, int]:
    """Frequent n-grams (sorted, at most MOST_HOT, most frequent first) and the rows a column may have."""
    counts = survey.where("kind = 1").groupBy("set").agg(F.sum("n").alias("n")).where(F.col("n") > HOT)
    top = counts.orderBy(F.desc("n"), "set").limit(MOST_HOT).toArrow()
    least = int(top["n"].to_numpy().min()) if top.num_rows == MOST_HOT else HOT
    return np.sort(top["set"].to_numpy().view(np.uint64)) if top.num_rows else np.zeros(0, np.uint64), 4 * least


def similar_components(docs: DataFrame, *, n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Two documents link when den * |A and B| >= num * |A or B| of their sets of
    n-word shingles; component_id is the least doc_id that links reach.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = stage(_survey(docs, n), "survey")
    rows = survey.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("set")).alias("set"))
    owner = rows.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("doc_id"))
    hot, limit = _hot_columns(survey)
    total = rows.agg(F.sum("n_shingles")).collect()[0][0] or 0
    blocks = max(32, -(-total * (den - num) // den // BLOCK_ENTRIES))
    while True:
        packed = stage(_packed(docs, n, num, den, hot, blocks), "packed")
        product = stage(_product(packed, num, den, limit), "product")
        late = product.where("late is not null").select("late").limit(MOST_HOT).toArrow()["late"].to_numpy().view(np.uint64)
        if not len(late):
            break
        hot = np.union1d(hot, late)  # a column that no task saw often enough: it is frequent, too
        unstage(packed, product)
    # the size-derived bound: overlap in the prefixes, frequent columns at most, and the longer suffix
    suffix = lambda c: F.ceil(F.col(c) * num / den) - 1
    need = F.ceil((F.col("na") + F.col("nb")) * num / (num + den))
    pairs = product.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"), F.max("spare").alias("spare"))
    pairs = stage(pairs.where(F.col("shared") + F.col("spare") + F.greatest(suffix("na"), suffix("nb")) >= need).select("a", "b"), "pairs")
    entries = stage(_hot_entries(packed), "hot")
    hubs = entries.groupBy("key").agg(F.min(F.struct("set", "n")).alias("hub")).select("key", F.col("hub.set").alias("a"), F.col("hub.n").alias("na"))
    fits = den * F.least("na", "nb") >= num * F.greatest("na", "nb")
    stars = entries.withColumnRenamed("set", "b").withColumnRenamed("n", "nb").join(hubs, "key").where((F.col("a") != F.col("b")) & fits).select("a", "b").distinct()
    # links to each row's least partner first
    least = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = stage(least.unionByName(stars).distinct(), "first")
    cold_sets = pairs.select(F.explode(F.array("a", "b")).alias("set"))
    hot_sets = entries.select("set")
    sets = stage(_sets_of(docs, cold_sets.unionByName(hot_sets).distinct(), owner, n), "sets")
    checked = stage(_verified(first, sets, num, den), "checked")
    roots = stage(components(checked.where("linked"), "a", "b"), "roots")
    # then all others that could still join two components
    left = _rooted(pairs, roots).select("a", "b")
    rest = left.join(checked.select("a", "b"), ["a", "b"], "left_anti")
    more = stage(_verified(rest, sets, num, den), "more")
    dense = stage(_dense_links(entries, hubs, roots, sets, num, den), "dense")
    links = checked.unionByName(more).where("linked").select("a", "b").unionByName(dense)
    roots = stage(components(links, "a", "b"), "roots")
    unstage(packed, product, sets)
    named = owner.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    ids = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    label = named.select("set", "root").join(ids, "root").select("set", "component_id")
    out = rows.join(label, "set", "left").select("doc_id", "n_shingles", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out
