"""Benchmark decontamination: windows of test items found in training texts, by built-in functions only.

Texts and items are lower-cased (A-Z) and cut into words.  A window is ``n`` consecutive
words of an item; an item of fewer words is one window.  The windows' 64-bit hashes
and their words are broadcast as a hash table; texts are scanned window by window, and
a hit of the hash is verified on the words.  Words of a text inside any occurrence of
a window are hit; ``cleaned`` removes them, or the texts that have any.

The broadcast is bounded: (window, item) pairs are dealt by a hash into as many
blocks as keep each within ``BLOCK_BYTES`` by its own sum of lengths, and a larger
benchmark is scanned for in one pass a block.  Only hits are shuffled, by the text's
hash; equal texts share theirs.

Nulls and edges: null, empty and wordless texts have no words and no hits; an item of
null or no words has no window; an item of a null id hits words but is neither counted
nor listed; repeated items and windows count once; null and repeated ids of texts
are no matter, as results belong to texts; an empty benchmark hits nothing; an empty
table gives no rows; other columns stay.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from dosepath.plans.staging import stage

def _but(characters: str) -> str:
    """A pattern of runs of anything but these; listed one by one, they are one look-up in a set of bits, which ranges are not."""
    return "[^" + "".join(f"\\x{ord(c):02X}" for c in characters) + "]+"


#: Words of a lower-cased text (``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``), and of a text as it is.
WORD = _but("".join(c for c in map(chr, range(128)) if not c.isdigit() and not c.islower()))
RAW_WORD = _but("".join(c for c in map(chr, range(128)) if not c.isalnum()))
BLOCK_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Normalised words of a text; null has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` made once."""
    return F.transform(F.array(value), body)[0]


def _pairs(a: Column, b: Column, apart: int) -> Column:
    """Hashes of each of ``a`` with what is in ``b`` so many places on."""
    both = F.transform(F.sequence(F.lit(0), F.size(b) - 1 - apart), lambda i: F.xxhash64(F.get(a, i), F.get(b, i + apart)))
    return F.when(F.size(b) > apart, both).otherwise(F.array().cast("array<bigint>"))


def _keys(some: Column, length: int) -> Column:
    """Hashes of all windows of ``length`` words: of pairs of words, pairs of pairs and so on, put together by the bits of ``length``."""

    def doubled(power: int, held: Column, done: Column | None, words_done: int) -> Column:
        if length & power:
            done, words_done = held if done is None else _pairs(done, held, words_done), words_done + power
        if 2 * power > length:
            return done
        if done is None or not length & power:
            return _let(_pairs(held, held, power), lambda more: doubled(2 * power, more, done, words_done))
        return _let(done, lambda own: _let(_pairs(held, held, power), lambda more: doubled(2 * power, more, own, words_done)))

    return _let(F.transform(some, lambda w: F.xxhash64(w)), lambda h: doubled(1, h, None, 0))


def windows(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """(key, length, words, item) of all windows of ``items``, each pair of window and item once."""
    own = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    own = own.withColumn("length", F.least(F.size("w"), F.lit(n)))
    keys = F.coalesce(*[F.when(F.col("length") == k, _keys(F.col("w"), k)) for k in range(1, n + 1)])
    cut = F.transform(keys, lambda key, i: F.struct(key.alias("key"), F.slice("w", i + 1, F.col("length")).alias("words")))
    return own.select("length", "item", F.inline(cut)).distinct().select("key", "length", "words", "item")


def _hits(texts: DataFrame, table: DataFrame, lengths: list[int]) -> DataFrame:
    """(text, at, length, items) of all places of ``texts`` (text, w) where a window of the broadcast ``table`` stands."""
    if len(lengths) == 1:
        sized = texts.select("text", "w", F.lit(lengths[0]).alias("l"), _keys(F.col("w"), lengths[0]).alias("keys"))
    else:
        sized = texts.select("text", "w", F.inline(F.array(*[F.struct(F.lit(k).alias("l"), _keys(F.col("w"), k).alias("keys")) for k in lengths])))
    places = sized.select("text", "w", "l", F.posexplode("keys").alias("at", "k"))
    same = (F.col("k") == F.col("key")) & (F.col("l") == F.col("length")) & (F.slice("w", F.col("at") + 1, F.col("l")) == F.col("words"))
    return places.join(F.broadcast(table), same).select("text", "at", "length", "items")


def _merged(places: Column) -> Column:
    """Sorted (start, end) stretches that overlapping or touching places (at, length) cover."""
    Acc = "array<struct<start:int,end:int>>"

    def step(acc: Column, p: Column) -> Column:
        # a stretch goes to the list once the next place lies beyond it
        end = p["at"] + p["length"]
        open_ = p["at"] <= acc["end"]
        done = F.when(open_, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))))
        return F.struct(F.when(open_, acc["start"]).otherwise(p["at"]).alias("start"), F.when(open_, F.greatest(acc["end"], end)).otherwise(end).alias("end"), done.alias("done"))

    first = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.array().cast(Acc).alias("done"))
    all_ = F.aggregate(F.array_sort(places), first, step, lambda a: F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end")))))
    return F.filter(all_, lambda s: s["end"] > s["start"])


def found(docs: DataFrame, items: DataFrame, *, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Hits of the windows of ``items`` in the texts of ``docs``, a row for each distinct text that has any.

    Returns text_key (of ``text_key``), spans (array of start, end in words, end
    exclusive, none touching another) and items (array of ids as strings, sorted).
    """
    pairs = stage(windows(items, item_id, item_text, n), "windows")
    size = F.aggregate("words", F.lit(24).cast("long"), lambda a, w: a + F.octet_length(w) + 16) + F.coalesce(F.octet_length("item"), F.lit(0)) + 16
    r = pairs.agg(F.sum(size).alias("bytes"), F.collect_set("length").alias("lengths")).first()  # n lengths at most
    blocks = -(-(r.bytes or 0) // BLOCK_BYTES)
    texts = docs.select(text_key(F.col(text)).alias("text"), words(F.col(text)).alias("w"))
    hits = None
    for k in range(blocks):
        block = pairs.where(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == k) if blocks > 1 else pairs
        one = block.groupBy("key", "length", "words").agg(F.collect_set("item").alias("items"))
        more = _hits(texts, one, sorted(r.lengths))
        hits = more if hits is None else hits.unionByName(more)
    if hits is None:
        hits = texts.where(F.lit(False)).select("text", F.lit(0).alias("at"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("items"))
    each = hits.groupBy("text").agg(F.collect_set(F.struct("at", "length")).alias("places"), F.collect_set("items").alias("items"))
    return each.select(F.col("text").alias("text_key"), _merged(F.col("places")).alias("spans"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def text_key(text: Column) -> Column:
    """What tells texts apart: two 64-bit hashes and the length."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit("b")).alias("b"), F.length(text).alias("c"))


def marked(docs: DataFrame, items: DataFrame, *, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with hit_spans and hit_items as ``found`` has them (empty where nothing is hit), n_words and n_hit in place of columns so named."""
    # written, so that the planner sees its size, and can split the copies of a text over tasks
    hits = stage(found(docs, items, n=n, text=text, item_id=item_id, item_text=item_text), "hits")
    key = max([*docs.columns, "key"], key=len) + "_"  # no column's name
    hits = hits.select(F.col("text_key").alias(key), F.col("spans").alias("hit_spans"), F.col("items").alias("hit_items"))
    out = docs.drop("hit_spans", "hit_items", "n_words", "n_hit")
    out = out.withColumn("n_words", F.coalesce(F.regexp_count(text, F.lit(RAW_WORD)), F.lit(0)).cast("long"))
    out = out.withColumn(key, text_key(F.col(text))).join(hits, key, "left").drop(key)
    spans = F.coalesce("hit_spans", F.array().cast("array<struct<start:int,end:int>>"))
    out = out.withColumn("hit_spans", spans).withColumn("hit_items", F.coalesce("hit_items", F.array().cast("array<string>")))
    return out.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))


def cleaned(docs: DataFrame, items: DataFrame, *, whole: bool = False, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without what ``items`` hit: their words and the gap before each, or with ``whole`` every text hit.  Other texts are as they were."""
    names, mark = docs.columns, max([*docs.columns, "own"], key=len) + "_"
    own = {c: mark + c for c in ("hit_spans", "hit_items", "n_words", "n_hit") if c in names}
    out = marked(docs.withColumnsRenamed(own), items, n=n, text=text, item_id=item_id, item_text=item_text)
    columns = [F.col(own.get(c, c)).alias(c) for c in names]
    if whole:
        return out.where("n_hit = 0").select(*columns)

    def kept(pieces: Column, spans: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
        ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.size(pieces)))
        return F.array_join(F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(pieces, a + 1, b - a))), "")

    found_words = F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0))
    pieces = _let(F.split(text, RAW_WORD, -1), lambda gaps: F.zip_with(gaps, F.concat(found_words, F.array(F.lit(""))), lambda g, w: F.concat(g, w)))
    clean = F.when(F.col("n_hit") > 0, _let(pieces, lambda p: kept(p, F.col("hit_spans")))).otherwise(F.col(text))
    return out.withColumn(text, clean).select(*columns)
