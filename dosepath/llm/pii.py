"""Information-theoretic sanitisation of personal data.

Protected entities are the values of formats (e-mail, IP address, payment card,
phone number).  From the whole corpus it is estimated how much a term tells
about an entity: with n(t,e) the documents that hold term t and entity e, the
pointwise mutual information of t and e over the information content of e,
PMI(t,e) / -log2 P(e), is the share of the entity that the term discloses.  A
term at or over ``disclosure`` with ``support`` different documents is generalised
(masked as <TERM>) at all its places in every text that holds the entity, besides
the entity itself.

One unit holds throughout: P(t), P(e) and their joint count distinct whole texts, so
copies of any text change nothing.  Texts of an entity support a term as one where
one is made from the other (their 5-word shingles have a Jaccard similarity of 0.4
or more), so near copies do not make every word of theirs a disclosing one.

Values that fewer than ``support`` texts hold cannot support a term alone.  Those
of them that stand in one text (of at most ``record`` values) are taken as one
entity, as the address and the number of a person are, unless texts chain more than
``record`` values so: these are several persons', and each value stays its own.

Texts of candidate terms are counted last and exactly: texts with entities, then
a hashed part of all texts, give lower bounds of P(t), which rule most terms out.

All is made of built-in functions.  Entities and terms are joined, never
collected; the texts are read from a staged copy beside their formats, which are
searched once.

Nulls and edges: a null or empty text has no spans; equal rows get equal spans;
an empty table gives no rows; other columns are kept by ``sanitised``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dosepath.llm import spans as S
from dosepath.llm.common import WORD
from dosepath.llm.components import components
from dosepath.plans.staging import stage, unstage

KINDS = ["email", "ip", "card", "phone", "term"]
#: Formats of the contract (fixed values), written so that a match starts at the start of a run of its characters
#: (or where the last one ended) and never backs up; the same matches, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"[\p{L}\p{N}]{3,}+"
LETTERS = 4  # a term of fewer letters names nothing
SHINGLE, NUM, DEN = 5, 40, 100  # texts of this similarity or more are one context; independent ones share phrases only
SKETCH = 24  # least hashes of a set by which near copies meet; two of similarity 0.4 share none with a chance of 0.6 ** 24 = 5e-6
RUNS = (1, 2, 4)  # so many neighbours of a sketch make one key
PARTS = 16  # of all texts one part gives a lower bound of a term's texts
MOST_BROADCAST = 1_000_000  # hashes of terms, 8 MB; more are joined by a shuffle


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    each = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(each, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four formats, by kind."""

    def found(pattern: str, kind: str, could: Column) -> Column:
        return F.when(could, S.located(text, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pattern, kind)).otherwise(S.empty())

    digit = text.rlike("[0-9]")
    email = found(EMAIL, "email", F.contains(text, F.lit("@")))
    ip = F.filter(found(IP, "ip", digit & F.contains(text, F.lit("."))), lambda s: s["value"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
    card = F.filter(found(CARD, "card", digit), lambda s: F.length(_digits(s["value"])).between(16, 19) & _luhn(_digits(s["value"])))
    phone = F.filter(found(PHONE, "phone", F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["value"])).between(8, 15))
    return F.concat(email, ip, card, phone)


def _entities(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(_digits_or(s)))))


def _digits_or(s: Column) -> Column:
    return F.when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"]))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _blanked(docs: DataFrame, text: Column) -> DataFrame:
    """With ``__blank``: ``text`` of the same length with no term in base_spans, one format after the other as they may overlap."""
    docs = docs.withColumn("__blank", text)
    for kind in KINDS[:-1]:
        blanks = F.transform(F.filter("base_spans", _is(kind)), lambda s: F.struct(F.repeat(F.lit(" "), s["end"] - s["start"] - 2).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        docs = docs.withColumn("__blank", S.masked(F.col("__blank"), blanks))
    return docs


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def _places(blank: Column, terms: Column) -> Column:
    """Spans of all places of ``terms`` in a blanked text."""
    found = S.located(blank, F.regexp_extract_all(blank, F.lit(TERM), F.lit(0)), TERM, "term")
    return F.filter(found, lambda s: F.array_contains(terms, F.lower(s["value"])))


def _key(docs_text: Column) -> Column:
    return F.struct(F.xxhash64(docs_text).alias("a"), F.crc32(docs_text.cast("binary")).alias("b"), F.length(docs_text).alias("n"))


def _shingles(text: Column) -> Column:
    """Sorted hashes of the distinct word n-grams of a text; a text of fewer words is one n-gram."""

    def made(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - SHINGLE))
        return F.array_sort(F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))))

    return F.transform(F.array(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), made)[0]


def _heads(grams: Column) -> Column:
    """Keys by which near copies meet: the least hashes of a set, alone and in runs of neighbours."""
    least = F.slice(grams, F.lit(1), F.lit(SKETCH))

    def runs(n: int) -> Column:
        at = F.sequence(F.lit(0), F.size(least) - n)
        return F.when(F.size(least) >= n, F.transform(at, lambda i: F.xxhash64(F.lit(n), *[F.get(least, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))

    return F.concat(*map(runs, RUNS))


def near_copies(holders: DataFrame) -> DataFrame:
    """(node, root): classes of near copies among the documents of an entity; documents without one are absent.

    holders: (key, __text, entities).  node is xxhash64(entity, key).  Of each key of
    a sketch all documents of the entity are compared, by their whole sets, with two of
    them, which a hash draws anew for each key: no pairs of all.  Keys of several hashes
    bring together texts that are closer to each other than to those drawn for a single
    hash, as copies of one letter on a form that thousands of other letters use.
    """
    sets = stage(holders.withColumn("grams", _shingles(F.col("__text"))).select("key", "grams", F.explode("entities").alias("entity")).select("entity", F.xxhash64("entity", "key").alias("node"), "grams"), "shingles")
    heads = sets.select("entity", "node", F.size("grams").alias("size"), F.explode(_heads(F.col("grams"))).alias("head"))
    drawn = F.struct(F.xxhash64("head", "node").alias("order"), "node", "size")
    hubs = heads.groupBy("entity", "head").agg(F.array(F.min(drawn), F.max(drawn)).alias("hubs"), F.count("*").alias("n")).where("n > 1").drop("n")
    alike = DEN * F.least("size", "hub.size") >= NUM * F.greatest("size", "hub.size")
    pairs = heads.join(hubs, ["entity", "head"]).withColumn("hub", F.explode("hubs")).where(F.col("node") != F.col("hub.node")).where(alike).select("node", F.col("hub.node").alias("hub")).distinct()
    of = sets.select("node", "grams")
    both = pairs.join(of, "node").join(of.select(F.col("node").alias("hub"), F.col("grams").alias("others")), "hub")
    shared = F.size(F.array_intersect("grams", "others"))
    return components(both.where(DEN * shared >= NUM * (F.size("grams") + F.size("others") - shared)), "node", "hub")


def _linked(each: DataFrame, support: int, record: int) -> DataFrame:
    """(key, entity) with the rare entities that texts of few ones hold together made one, where they are no more than ``record``."""
    rare = each.groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") < support).select("entity")
    sets = each.join(rare, "entity", "left_semi").groupBy("key").agg(F.slice(F.collect_set("entity"), 1, record + 1).alias("own"))
    sets = sets.where(F.size("own").between(2, record))
    roots = components(sets.select(F.array_min("own").alias("a"), F.explode("own").alias("b")), "a", "b")
    roots = roots.join(roots.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= record).select("root"), "root", "left_semi")
    return each.join(roots.withColumnRenamed("node", "entity"), "entity", "left").select("key", F.coalesce("root", "entity").alias("entity")).distinct()


def _texts_of(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) distinct texts that hold each of ``terms``.  texts: (key, text)."""
    some = stage(terms.select("term", F.xxhash64("term").alias("hash")).distinct(), "terms")
    hashes = some.select("hash")
    if some.count() <= MOST_BROADCAST:
        hashes = F.broadcast(hashes)
    held = texts.select("key", F.explode(_terms(F.col("text"))).alias("term")).withColumn("hash", F.xxhash64("term"))
    pairs = held.join(hashes, "hash", "left_semi").select("term", "key").distinct()
    return pairs.groupBy("term").agg(F.count("*").alias("n")).join(some.select("term"), "term", "left_semi")


def disclosing(texts: DataFrame, holders: DataFrame, *, support: int, disclosure: float, record: int) -> DataFrame:
    """(key, __told terms) of the texts that hold an entity with terms over the threshold.

    texts: (key, text) of all documents; holders: (key, __text, base_spans, entities), each key once.
    """
    each = stage(holders.select("key", F.explode("entities").alias("value")).select("key", F.xxhash64("value").alias("entity")).distinct(), "each")
    each = stage(_linked(each, support, record), "linked")
    per_entity = each.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    shared = each.join(per_entity, "entity", "left_semi").groupBy("key").agg(F.collect_list("entity").alias("entities"))
    held = stage(holders.drop("entities").join(shared, "key"), "held")
    nodes = held.select("key", F.explode("entities").alias("entity")).withColumn("node", F.xxhash64("entity", "key"))
    nodes = nodes.join(near_copies(held), "node", "left").select("key", "entity", F.coalesce("root", "node").alias("class"))
    per_entity = stage(per_entity.join(nodes.groupBy("entity").agg(F.count_distinct("class").alias("n_c")).where(F.col("n_c") >= support).select("entity"), "entity"), "supported")
    nodes = stage(nodes.join(per_entity, "entity", "left_semi"), "classes")
    of_key = nodes.groupBy("key").agg(F.collect_list(F.struct("entity", "class")).alias("nodes"))
    said = _blanked(held.join(of_key, "key"), F.col("__text")).select("key", "nodes", F.explode(_terms(F.col("__blank"))).alias("term")).where(F.length(F.regexp_replace("term", r"\P{L}+", "")) >= LETTERS)
    joint = said.select("term", F.explode("nodes").alias("node")).groupBy("node.entity", "term").agg(F.count_distinct("node.class").alias("n_c"), F.count("*").alias("n_te")).where(F.col("n_c") >= support)
    joint = stage(joint.join(per_entity, "entity"), "joint")
    total = float(max(1, texts.select("key").distinct().count()))
    prior = F.log2(F.col("n_e") / F.lit(total))

    def over(joint: DataFrame, counts: DataFrame) -> DataFrame:
        """Pairs over the threshold where ``counts`` (term, n) are the texts of a term, or some of them."""
        told = (F.log2(F.col("n_te") / F.greatest("n", "n_te")) - prior) / -prior
        return joint.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).where(told >= disclosure).drop("n")

    near = holders.select("key", F.col("__text").alias("text"))
    part = texts.where(F.pmod(F.col("key.a"), F.lit(PARTS)) == 0)
    for some, name in ((near, "near"), (part, "part"), (texts, "over")):
        if joint.isEmpty():
            return nodes.where("false").select("key", F.array(F.lit("")).alias("__told"))
        left = stage(over(joint, _texts_of(some, joint)), name)
        unstage(joint)
        joint = left
    return nodes.join(joint.select("entity", "term"), "entity").groupBy("key").agg(F.collect_set("term").alias("__told"))


def sanitised(docs: DataFrame, *, support: int = 3, disclosure: float = 0.8, record: int = 8) -> DataFrame:
    """``docs`` (with text) and base_spans (by kind), pii_spans (terms besides) and clean_text.

    Spans are structs (kind, start, end, value) in code points; clean_text has
    every span replaced by <KIND>.  The three replace columns of their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.drop("base_spans", "pii_spans", "clean_text")
    found = docs.withColumn("__key", _key(text)).withColumn("base_spans", S.ordered(base_spans(text), KINDS, True))
    found = stage(found, "formats").withColumn("__text", text)
    some = F.size("base_spans") > 0
    with_any = found.where(some)
    holders = with_any.select(F.col("__key").alias("key"), "__text", "base_spans", _entities(F.col("base_spans")).alias("entities"))
    holders = stage(holders.dropDuplicates(["key"]), "holders")
    texts = found.select(F.col("__key").alias("key"), F.col("__text").alias("text"))
    told = stage(disclosing(texts, holders, support=support, disclosure=disclosure, record=record), "disclosing")
    unstage(holders)
    joined = with_any.join(told.withColumnRenamed("key", "__key"), "__key", "left")
    any_told = F.col("__told").isNotNull()
    joined = _blanked(joined, F.when(any_told, F.col("__text"))).withColumn("__terms", F.when(any_told, _places(F.col("__blank"), F.col("__told"))).otherwise(S.empty())).drop("__blank", "__told")
    none = found.where(~some).withColumn("__terms", S.empty())
    out = joined.unionByName(none)
    out = out.withColumn("pii_spans", F.concat("base_spans", "__terms"))
    return out.withColumn("clean_text", S.masked(F.col("__text"), F.col("pii_spans"))).drop("__text", "__terms", "__key")
