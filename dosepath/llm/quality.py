"""Quality classifier: regularised quadratic discriminant analysis.

Each text gives a fixed vector of transformed statistics, all from built-in
functions.  Class means and covariances come from one aggregate of moments over
every labelled row that may be learned from (no sample).  A class covariance is
shrunk towards the covariance pooled over the classes, and that towards its
mean variance; the Cholesky factor of each is computed once on the driver (a
matrix of the number of statistics) and its inverse is written into the scoring
expression, so a score is two triangular products and stays in generated code.

The score is a monotone map to 0 .. 1 of the difference of Mahalanobis
log-densities plus log priors that does not saturate, so ranks survive.  It is
0.5 where the learned rows are told apart with fewest errors (densities of ten
statistics are over-sure, so their zero is not that place).

Nulls and edges: a null text counts as empty and gets a score; labels other than
0 and 1, null labels and labels without a document are not learned from; with
no rows of one class every score is 1 (no class 0), 0 (no class 1) or 0.5 (no
labels); repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from dosepath.llm.common import word_count
from dosepath.plans.staging import stage, unstage


def statistics(text: Column) -> dict[str, Column]:
    """Counts over a whole text, from which ``transformed`` makes the features."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]+", ""))
    lines = F.filter(F.split(text, "\n+"), lambda x: x != "")
    return {
        "n": F.length(text),
        "words": word_count(text),
        "distinct": F.size(F.array_distinct(words)),
        "lines": F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)),
        "letters": kept(r"\p{L}"),
        "upper": kept(r"\p{Lu}"),
        "marks": kept(r"!?|#$%&*<>{}\[\]=_~^@+/\\\\"),
        "stops": kept(r".,;:"),
    }


def transformed(s: dict[str, Column]) -> dict[str, Column]:
    """Features of near-normal shape: logs of counts, and logs of ratios smoothed by a pseudo-text.

    The pseudo-text (20 words, 100 characters, 3 lines) keeps one odd word from
    ruling the ratios of a very short text.
    """
    ratio = lambda a, b, more: F.log((s[a] + 1.0) / (s[b] + more))
    return {
        "length": F.log1p(s["words"].cast("double")),
        "word_length": ratio("n", "words", 20.0),
        "variety": F.log((s["distinct"] + 5.0) / (F.pow(s["words"].cast("double"), 0.7) + 5.0)),
        "repeated_words": F.log((s["distinct"] + 20.0) / (s["words"] + 20.0)),
        "repeated_lines": F.log((s["distinct_lines"] + 3.0) / (s["lines"] + 3.0)),
        "line_length": ratio("words", "lines", 3.0),
        "letters": F.log((s["letters"] + 100.0) / (s["n"] + 100.0)),
        "upper": ratio("upper", "letters", 100.0),
        "marks": ratio("marks", "words", 20.0),
        "stops": ratio("stops", "words", 20.0),
    }


FEATURES = ("length", "word_length", "variety", "repeated_words", "repeated_lines", "line_length", "letters", "upper", "marks", "stops")


def featured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` and the features of ``text`` as columns __x_<name>."""
    names = list(statistics(F.lit("")))
    counted = docs.select(*keep, *[c.cast("double").alias(f"__s_{n}") for n, c in statistics(F.coalesce(F.col("text").cast("string"), F.lit(""))).items()])
    made = transformed({n: F.col(f"__s_{n}") for n in names})
    return counted.withColumns({f"__x_{n}": made[n] for n in FEATURES}).drop(*[f"__s_{n}" for n in names])


@dataclass(frozen=True)
class Discriminant:
    """Class log priors, means, and inverse Cholesky factors; ``flat`` is the score where a class is missing."""

    constant: tuple[float, float] = (0.0, 0.0)
    means: tuple = ()
    factors: tuple = ()
    flat: float | None = None
    cut: float = 0.0

    def log_odds(self) -> Column:
        """Log-density of class 1 over class 0 at the features of a row."""
        sides = []
        for mean, factor, constant in zip(self.means, self.factors, self.constant, strict=True):
            centred = [F.col(f"__x_{n}") - F.lit(m) for n, m in zip(FEATURES, mean, strict=True)]
            rows = [sum((c * F.lit(w) for c, w in zip(centred[1 : i + 1], row[1 : i + 1], strict=True)), centred[0] * F.lit(row[0])) for i, row in enumerate(factor)]
            sides.append(F.lit(constant) - F.lit(0.5) * sum((r * r for r in rows[1:]), rows[0] * rows[0]))
        return sides[1] - sides[0]

    def score(self) -> Column:
        if self.flat is not None:
            return F.lit(self.flat)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(self.cut) - F.asinh(self.log_odds())))


def from_moments(n: np.ndarray, first: np.ndarray, second: np.ndarray, pooled_share: float, ridge: float) -> Discriminant:
    """The model of class counts, sums and sums of products."""
    if n.sum() == 0:
        return Discriminant(flat=0.5)
    if (n == 0).any():
        return Discriminant(flat=float(n[1] > 0))
    d = first.shape[1]
    means = first / n[:, None]
    scatter = second - np.einsum("ci,cj->cij", means, means) * n[:, None, None]
    pooled = scatter.sum(axis=0) / n.sum()
    constant, factors = [], []
    for c in (0, 1):
        share = max(pooled_share, min(1.0, d / n[c]))  # few rows: lean on the pooled covariance
        cov = (1 - share) * scatter[c] / n[c] + share * pooled
        cov = (1 - ridge) * cov + ridge * (np.trace(cov) / d + 1e-9) * np.eye(d)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        constant.append(float(math.log(n[c] / n.sum()) - np.log(np.diag(low)).sum()))
    return Discriminant(tuple(constant), tuple(map(tuple, means.tolist())), tuple(tuple(map(tuple, f.tolist())) for f in factors))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of ``docs`` (doc_id, text): a row of fixed width, so joins move no text."""
    return featured(docs, [F.col("doc_id").cast("long").alias("doc_id")])


def fit(rows: DataFrame, labels: DataFrame, *, label: str = "quality", learn_from: Column | None = None, pooled_share: float = 0.1, ridge: float = 0.01) -> Discriminant:
    """Fit on all labelled ``rows`` (of ``features``) for which ``learn_from`` (of the labels' id, _id) holds."""
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1))
    if learn_from is not None:
        marked = marked.where(learn_from)
    rows = stage(rows.join(marked, rows["doc_id"] == F.col("_id")).drop("doc_id", "_id"), "learned")
    d = len(FEATURES)
    x = [F.col(f"__x_{n}") for n in FEATURES]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    found = rows.groupBy("_y").agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("p")).collect()  # a row a class
    n, first, second = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in found:
        n[r["_y"]], first[r["_y"]] = r["n"], r["s"]
        for (i, j), v in zip(pairs, r["p"], strict=True):
            second[r["_y"], i, j] = second[r["_y"], j, i] = v
    model = from_moments(n, first, second, pooled_share, ridge)
    if model.flat is None:
        model = replace(model, cut=_cut(rows, model))
    unstage(rows)
    return model


def _cut(rows: DataFrame, model: Discriminant, fine: int = 32) -> float:
    """Where asinh of the log odds tells the learned rows apart with fewest errors: the middle of the best stretch."""
    at = F.floor(F.asinh(model.log_odds()) * fine).cast("long")
    counts = sorted((r["b"], r["n0"], r["n1"]) for r in rows.groupBy(at.alias("b")).agg(F.count(F.when(F.col("_y") == 0, 1)).alias("n0"), F.count(F.when(F.col("_y") == 1, 1)).alias("n1")).collect())  # asinh leaves a few thousand bins
    errors = sum(c[1] for c in counts)
    best, low, high = errors, counts[0][0], counts[0][0]
    for k, (b, n0, n1) in enumerate(counts):  # the cut above bin b
        errors += n1 - n0
        if errors < best:
            best, low, high = errors, b + 1, counts[k + 1][0] if k + 1 < len(counts) else b + 1
    return (low + high) / 2 / fine


def scored(docs: DataFrame, model: Discriminant) -> DataFrame:
    """All columns of ``docs`` and ``quality_score`` (double, 0 to 1; it replaces a column of that name)."""
    docs = docs.drop("quality_score")
    return featured(docs, [F.col(c) for c in docs.columns]).withColumn("quality_score", model.score()).select(*docs.columns, "quality_score")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
