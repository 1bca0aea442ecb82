"""Spans of regular-expression matches, by built-in functions only.

``regexp_extract_all`` gives the matches and ``split`` the gaps between them,
both leftmost and non-overlapping; their lengths give the positions.  A span is a
struct (kind, start, end, value) in code points, end exclusive.

Arrays are built in blocks, so a text of very many matches costs about its
length, not the square of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BLOCK = 256  # matches of a block
CHUNK = 4096  # code points of a chunk
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def empty() -> Column:
    return F.array().cast(SPAN)


def _span(kind: Column, start: Column, end: Column, value: Column) -> Column:
    return F.struct(kind.alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), value.alias("value"))


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` bound once."""
    return F.transform(F.array(value), body)[0]


def _blocked(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def _before(values: Column, add) -> Column:
    """For each of ``values`` (one a block) what ``add`` makes of those before it, from 0."""
    return F.transform(values, lambda _, i: F.aggregate(F.slice(values, F.lit(1), i), F.lit(0), add))


def located(text: Column, matches: Column, pattern: str, kind: str) -> Column:
    """Spans of ``matches``, which are all matches of ``pattern`` in ``text``, in order."""
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + F.length(p["value"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(_span(F.lit(kind), start, end, p["value"]))).alias("spans"))

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, p: n + p["gap"] + F.length(p["value"])))
        return _let(_before(sizes, lambda n, x: n + x), lambda starts: F.flatten(F.zip_with(blocks, starts, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty().alias("spans")), step)["spans"])))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")))
    return F.when(F.size(matches) == 0, empty()).otherwise(_let(_blocked(pairs), placed))


def chunked(text: Column) -> Column:
    """``text`` in chunks, for ``piece``."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int") + 1), lambda i: F.substring(text, i * CHUNK + 1, F.lit(CHUNK)))


def piece(chunks: Column, begin: Column, length: Column) -> Column:
    """Code points from ``begin`` (0 is the first), at most CHUNK, at a cost that the place does not change."""
    i = F.floor(begin / CHUNK).cast("int")
    return F.substring(F.concat(F.get(chunks, i), F.coalesce(F.get(chunks, i + 1), F.lit(""))), begin - i * CHUNK + 1, length)


def ordered(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """Spans sorted by kind (as listed) then start, or by start then kind."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"])
    key = (lambda s: (rank(s), s["start"])) if by_kind else (lambda s: (s["start"], rank(s)))
    keyed = F.transform(spans, lambda s: F.struct(key(s)[0].cast("long").alias("a"), key(s)[1].cast("long").alias("b"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def digest(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by <KIND>; of overlapping spans the first, then the longest, is shown once."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def one_block(block: Column, at: Column) -> Column:
        end = F.aggregate(block, at, lambda n, s: F.greatest(n, -s["back"]))

        def shown(part: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                new = F.array(F.substring(part, acc["at"] - at + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
                return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

            return F.array_join(F.aggregate(block, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), step)["out"], "")

        return _let(F.substring(text, at + 1, end - at), shown)

    def joined(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, s: F.greatest(n, -s["back"])))
        body = F.array_join(F.zip_with(blocks, _before(ends, lambda n, x: F.greatest(n, x)), one_block), "")
        return F.concat(body, F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(_blocked(keyed), joined))
