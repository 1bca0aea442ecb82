"""Secret scan: formats, and a battery of randomness tests for keys without one.

Formats (assignments to secret names, access-key ids, long hex strings) are
regular expressions.  Besides, every unbroken token of 16 or more key characters
is tested.  Its key is the token without separators (``-``, ``_``, ``/``, ``+``); a key of 16
or more characters that mixes letters and digits has its encoding inferred (hex,
base32, base36, base64 less its two signs).  A chi-squared test of uniformity over that
alphabet, a runs test on its kinds (digits, capitals, small letters) and a lag-1 serial
correlation give three p-values, combined by Fisher's method into one measure of randomness.

The null hypothesis is "an ordinary token": words of the corpus joined with a
number, as in slugs, file names and identifiers.  The words are the runs of letters
that occur ``COMMON`` times or more between marks or white space anywhere in the
corpus; each starts null tokens of every encoding and length class, and the battery
of these gives the null distribution of the measure.  A token's p-value is the
share of null tokens of its encoding and length that look as random as it does.
The
Benjamini-Hochberg rule at level ``fdr`` over the corpus' distinct keys of an
encoding and length class says which are secrets; keys that the battery itself
rejects as random (``UNLIKE``) are none.  Where a class has no power, as
with short keys of one case, no p-value is small enough and nothing is reported.

The measures reach the driver as histograms of encoding, length class and
bin, whose size is fixed.  Words are counted with a combine on the map side; no
text is shuffled, no Python runs.

Nulls and edges: a null or empty text has no spans; equal rows get equal spans;
a corpus without words has no null distribution, so no key is reported (formats
are); an empty table gives no rows; other columns are kept by ``scanned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dosepath.llm import spans as S
from dosepath.plans.staging import stage, unstage

#: Base formats, in the order of the kinds.  Fixed values of the contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_LEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
KINDS = ["assign", "access", "hex", "random"]

KEY = "".join(c for c in map(chr, range(128)) if c.isalnum()) + r"+/_\-"  # listed one by one, they are one look-up in a set of bits
TOKEN = f"(?<![{KEY}])[{KEY}]{{16,}}+"
SEPARATORS = r"[+/_-]+"
LEAST = 16  # characters of a key
ORDINARY = r"(?<![\p{L}\p{N}+])[A-Z]?[a-z]{2,14}+(?![\p{L}\p{N}+])"
COMMON = 3  # occurrences of an ordinary word
#: encoding: (condition, alphabet, sizes of its kinds in order); the first that fits is the inferred one.
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", (10, 6, 0)),
    "base32": (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (26, 6, 0)),
    "base36": (r"^([A-Z0-9]+|[a-z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz", (10, 26, 0)),
    "base64": (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", (26, 26, 10)),
}
LENGTHS = (16, 20, 24, 28, 32, 40, 48, 64, 96, 128, 256)  # least lengths of the classes
BINS = 400  # of -log10 p, a tenth each
NULLS = 512  # null tokens of an encoding and length class, about, at least
UNLIKE = 40  # bin from which on a key is not random (p of 1 in 10,000), whatever the null is like
DEALT = 4096  # words from which a null token's other words are taken


def base_spans(text: Column) -> Column:
    """Spans of the three formats, unsorted."""
    long_value = lambda s: F.length(F.regexp_replace(s["value"], ASSIGN_LEAD, "")) >= 8
    assign = F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), S.located(text, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)), ASSIGN, "assign")).otherwise(S.empty())
    access = F.when(F.contains(text, F.lit("AKIA")), S.located(text, F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)), ACCESS, "access")).otherwise(S.empty())
    hexes = S.located(text, F.regexp_extract_all(text, F.lit(HEX), F.lit(0)), HEX, "hex")
    return F.concat(F.filter(assign, long_value), access, hexes)


def token_spans(text: Column) -> Column:
    """Spans of tokens that could be keys: 16 or more letters and digits, one of each at least."""
    all_ = F.when(text.rlike("[0-9]"), S.located(text, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), TOKEN, "random")).otherwise(S.empty())
    return F.filter(all_, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (F.length(key_of(s["value"])) >= LEAST))


def key_of(token: Column) -> Column:
    """A token without separators."""
    return F.regexp_replace(token, SEPARATORS, "")


def _two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal, by a rational approximation of erfc (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    # coefficients of the Chebyshev fit of erfc (fixed values)
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(c[-1])
    for a in reversed(c[:-1]):
        poly = F.lit(a) + t * poly
    return F.greatest(F.lit(1e-300), F.least(F.lit(1.0), t * F.exp(-x * x + poly)))


def battery(token: Column) -> Column:
    """struct(encoding, length class, bin) of a key: inferred encoding and the combined p-value of randomness; bin 0 is the most random.

    ``let`` binds an intermediate value once, by a one-element transform.
    """
    let = lambda value, body: F.transform(F.array(value), body)[0]
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    tail_of = lambda xs: F.slice(xs, F.lit(2), F.size(xs) - 1)
    head_of = lambda xs: F.slice(xs, F.lit(1), F.size(xs) - 1)

    def coded(e: Column) -> Column:
        folded = F.when(e["encoding"].isin("hex", "base36"), F.lower(token)).otherwise(token)
        letters = F.filter(F.split(folded, ""), lambda c: c != "")
        codes = F.transform(letters, lambda c: (F.instr(e["alphabet"], c) - 1).cast("double"))
        return F.struct(F.length(e["alphabet"]).cast("double").alias("a"), codes.alias("codes"), *[e[x].alias(x) for x in ("first", "second", "turn", "two")])

    def measured(t: Column) -> Column:
        codes, n = t["codes"], F.size(t["codes"]).cast("double")
        kinds = F.transform(codes, lambda c: F.when(c < t["first"], 0).when(c < t["second"], 1).otherwise(2))
        return F.struct(
            n.alias("n"),
            t["a"].alias("a"),
            F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda acc, d: acc + F.pow(F.size(F.filter(codes, lambda c: c == d)).cast("double"), 2.0)).alias("squares"),
            kinds.alias("kinds"),
            t["turn"].alias("turn"),
            t["two"].alias("two"),
            let(total(codes) / n, lambda mean: F.transform(codes, lambda c: c - mean)).alias("off"),
        )

    def counted(m: Column) -> Column:
        return F.struct(
            m["n"].alias("n"),
            (m["a"] / m["n"] * m["squares"] - m["n"]).alias("chi"),
            (m["a"] - 1).alias("df"),
            total(F.zip_with(head_of(m["kinds"]), tail_of(m["kinds"]), lambda x, y: F.when(x != y, 1.0).otherwise(0.0))).alias("turns"),
            m["turn"].alias("turn"),
            m["two"].alias("two"),
            total(F.transform(m["off"], lambda x: x * x)).alias("power"),
            total(F.zip_with(head_of(m["off"]), tail_of(m["off"]), lambda x, y: x * y)).alias("lag"),
        )

    def standard(s: Column) -> Column:
        n, nine = s["n"], F.lit(2.0) / (s["df"] * 9)
        turn = s["turn"]  # of two neighbours, and both turns of three
        spread = (n - 1) * turn * (1 - turn) + (n - 2) * 2 * (s["two"] - turn * turn)
        return F.struct(
            ((F.pow(F.greatest(F.lit(0.0), s["chi"]) / s["df"], F.lit(1 / 3)) - 1 + nine) / F.sqrt(nine)).alias("chi"),
            ((s["turns"] - (n - 1) * turn) / F.sqrt(spread)).alias("runs"),
            F.when(s["power"] > 0, (s["lag"] / s["power"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(8.0)).alias("lag"),
        )

    def fisher(z: Column) -> Column:
        p = F.struct(_two_sided(z["chi"]).alias("chi"), _two_sided(z["runs"]).alias("runs"), _two_sided(z["lag"]).alias("lag"))
        upper = lambda z, q: F.when(z > 0, q / 2).otherwise(1 - q / 2)  # noqa: E731  words are uneven and turn seldom
        return let(p, lambda q: -(F.log(upper(z["chi"], q["chi"])) + F.log(upper(-z["runs"], q["runs"])) + F.log(q["lag"])))

    def binned(half: Column) -> Column:
        tail = (-half + F.log(1 + half + half * half / 2)) / F.log(F.lit(10.0))  # chi-squared with six degrees of freedom
        return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(-tail * 10))).cast("int")

    def result(e: Column) -> Column:
        length = sum((F.when(F.length(token) >= x, 1).otherwise(0) for x in LENGTHS[1:]), F.lit(0)).cast("int")
        half = let(let(let(let(coded(e), measured), counted), standard), fisher)
        return F.struct(e["encoding"].alias("encoding"), length.alias("length"), let(half, binned).alias("bin"))

    def encoding(name: str) -> Column:
        _, letters, sizes = ENCODINGS[name]
        share = [x / len(letters) for x in sizes]
        turn, two = sum(x * (1 - x) for x in share), sum(x * (1 - x) ** 2 for x in share)  # probabilities in a random key
        return F.struct(F.lit(name).alias("encoding"), F.lit(letters).alias("alphabet"), F.lit(float(sizes[0])).alias("first"), F.lit(float(sizes[0] + sizes[1])).alias("second"), F.lit(turn).alias("turn"), F.lit(two).alias("two"))

    inferred = F.coalesce(*[F.when(token.rlike(ENCODINGS[name][0]), encoding(name)) for name in ENCODINGS])
    return let(inferred, result)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word): lower-case words of 3 to 15 ASCII letters that occur COMMON times or more in the texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(ORDINARY), F.lit(0))).alias("word"))
    return words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n")).where((F.col("n") >= COMMON) & (F.length("word") > 2)).select("word")


def ordinary_keys(words: DataFrame, n_words: int, lengths: list[int], encodings: set[str]) -> DataFrame:
    """(key) of null tokens of ``lengths``: of each of ``encodings`` one for every word, several where words are few.

    A hash deals words to lengths.  A word is followed by words that a hash picks among about DEALT others; a
    number of one to eight digits stands at a place that a hash picks.  Ordinary
    hex tokens are numbers with some letters.
    """
    dealt = words.groupBy(F.pmod(F.xxhash64("word", F.lit(1)), F.lit(-(-n_words // DEALT))).alias("deal")).agg(F.sort_array(F.collect_list("word")).alias("others"))
    rounds = -(-NULLS * len(lengths) // n_words)
    draw_of = lambda word, at, *x: F.xxhash64(word, at, *[F.lit(y) if isinstance(y, (int, str)) else y for y in x])
    draw = lambda *x: draw_of(F.col("word"), F.col("round"), *x)

    def lines(word: Column) -> Column:
        """The words of each round's token; made beside the others, which no row carries with it."""
        other = lambda at, i: F.get("others", F.pmod(draw_of(word, at, i), F.size("others").cast("long")).cast("int"))
        line = lambda at: F.transform(F.sequence(F.lit(0), F.lit(max(lengths) // 3)), lambda i: F.when(i == 0, word).otherwise(other(at, i)))
        return F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda at: F.struct(word.alias("word"), at.alias("round"), line(at).alias("line")))

    made = dealt.select(F.inline(F.flatten(F.transform("others", lines))))
    made = made.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word", "round")  # a deal's tokens are tested by many tasks
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(max(lengths) // 16 + 1)), lambda i: F.substring(F.lpad(F.pmod(draw("d", i), F.lit(10**17)).cast("string"), 17, "0"), 2, 16)), "")
    made = made.select("word", "round", "line", digits.alias("digits"))
    joined = F.explode(F.array(*[x for names, x in (({"base36", "base32", "hex"}, F.array_join("line", "")), ({"base64"}, F.array_join(F.transform("line", F.initcap), ""))) if names & encodings]))
    made = made.select("word", "round", "digits", joined.alias("joined"))
    made = made.withColumn("length", F.get(F.array(*[F.lit(n) for n in lengths]), F.pmod(draw("l"), F.lit(len(lengths))).cast("int")))
    count = (F.pmod(draw("n", F.col("length")), F.lit(8)) + 1).cast("int")
    place = F.pmod(draw("p", F.col("length")), (F.col("length") - F.col("count") + 1).cast("long")).cast("int")
    made = made.withColumn("count", count).withColumn("place", place)
    number = F.substring("digits", F.lit(1), F.col("count"))
    key = F.concat(F.substring("joined", F.lit(1), F.col("place")), number, F.substring("joined", F.col("place") + 1, F.col("length") - F.col("count") - F.col("place")))
    lower = F.col("joined").rlike("^[a-z]")
    base32 = F.translate(F.upper(key), "0189", "2345")
    letters = F.array_join(F.transform(F.sequence(F.lit(1), F.col("count")), lambda i: F.substring(F.lit("abcdef"), (F.pmod(draw("x", i), F.lit(6)) + 1).cast("int"), F.lit(1))), "")
    hexed = F.concat(F.substring("digits", F.lit(9), F.col("place")), letters, F.substring("digits", F.col("place") + 9, F.col("length") - F.col("count") - F.col("place")))
    small = [x for name, x in (("base36", key), ("base32", base32), ("hex", hexed)) if name in encodings]
    keys = F.when(lower, F.array(*small)).otherwise(F.array(key)) if small else F.array(key)
    return made.select("length", F.explode(keys).alias("key")).where(F.length("key") == F.col("length")).select("key")


def _histograms(keys: DataFrame) -> dict[tuple[str, int], dict[int, int]]:
    """Keys by encoding and length class, then bin: a table of fixed size."""
    out: dict[tuple[str, int], dict[int, int]] = {}
    for r in keys.select(battery(F.col("key")).alias("b")).groupBy("b.encoding", "b.length", "b.bin").agg(F.count("*").alias("n")).collect():
        out.setdefault((r["encoding"], r["length"]), {})[r["bin"]] = r["n"]
    return out


def thresholds(docs: DataFrame, fdr: float = 0.05) -> dict[tuple[str, int], int]:
    """By encoding and length class: bins under this one are discovered as more random than ordinary tokens."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tokens = docs.select(F.explode(F.transform(token_spans(text)["value"], key_of)).alias("key"))
    classes = _histograms(tokens.groupBy("key").agg(F.count("*")).select("key"))
    if not classes:
        return {}
    words = stage(vocabulary(docs), "words")
    n_words = words.count()
    null = _histograms(ordinary_keys(words, n_words, sorted({LENGTHS[n] for _, n in classes}), {e for e, _ in classes})) if n_words else {}
    unstage(words)
    out = {}
    for key, bins in classes.items():
        total, like, seen, as_random, cut = sum(bins.values()), null.get(key, {}), 0, 0, 0
        for b in range(UNLIKE):
            seen, as_random = seen + bins.get(b, 0), as_random + like.get(b, 0)
            if (1 + as_random) / (1 + sum(like.values())) <= fdr * seen / total:
                cut = b + 1
        out[key] = cut
    return out


def all_spans(text: Column, cuts: dict[tuple[str, int], int]) -> tuple[Column, Column]:
    """(base, added) spans of a text; added ones overlap no base one."""
    base = base_spans(text)
    table = F.create_map(*[F.lit(v) for (e, n), cut in sorted(cuts.items()) for v in (f"{e}:{n}", cut)]) if cuts else F.create_map(F.lit(""), F.lit(0))

    def random(s: Column) -> Column:
        b = battery(key_of(s["value"]))
        return F.transform(F.array(b), lambda x: x["bin"] < F.coalesce(F.try_element_at(table, F.concat_ws(":", x["encoding"], x["length"].cast("string"))), F.lit(0)))[0]

    return base, F.filter(token_spans(text), random)


def scanned(docs: DataFrame, *, fdr: float = 0.05) -> DataFrame:
    """``docs`` (with text) and the columns base_spans and secret_spans (base and added), each sorted by start; they replace columns of their names."""
    cuts = thresholds(docs, fdr)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base, added = all_spans(text, cuts)
    found = docs.withColumn("__base", base).withColumn("__added", added)
    clear = F.filter("__added", lambda a: ~F.exists("__base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    return found.withColumn("base_spans", S.ordered(F.col("__base"), KINDS, False)).withColumn("secret_spans", S.ordered(F.concat("__base", clear), KINDS, False)).drop("__base", "__added")
