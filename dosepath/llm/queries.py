"""The dealt queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dosepath.plans.staging import stage
from dosepath.llm import common, decontamination, html_extract, mixing, neighbours, ngram_join, packing, periodic, pii, quality, secret_scan, sharding, spans, topk, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0).drop("source")


def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return rows.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(quality.features(table(spark, sf_dir, "documents")), "features")
    model = quality.fit(rows, table(spark, sf_dir, "labels"), learn_from=~quality.held_out(F.col("_id")))
    scored = rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op6_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitised(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [spans.count_of(F.col("base_spans"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(spans.digest(F.col("base_spans")), 256).alias("base_sha256"), spans.digest(F.col("pii_spans")).alias("spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [spans.count_of(F.col("base_spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(spans.digest(F.col("base_spans")), 256).alias("base_sha256"), spans.digest(F.col("secret_spans")).alias("spans"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"), n=5, num=75, den=100)


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=packing.SPECIAL)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, a tenth of which is given a periodic tail as the query's contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def with_tail(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        period = 1 + F.floor((n - a) / (3 + g % 8))
        moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % period).cast("int")))
        return F.when(n > 0, F.array_join(moved, " "))

    tailed = F.transform(F.array(F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0))), with_tail)[0]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(h % 10 == 0, tailed).otherwise(F.col("text")).alias("text"))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    most = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    found = periodic.periodic_runs(docs).select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("_best"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    best = {c: F.col(f"_best.{c}") for c in ("start", "length", "period")}
    return found.withColumns(best | {"exponent_milli": F.floor(1000 * best["length"] / best["period"])}).drop("_best")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compressed(table(spark, sf_dir, "embeddings"), carry=["label"], parts=4, entries=256, rounds=4)
    digest = F.lit(None).cast("string")
    for length in found.books:
        digest = F.when(F.col("n_components") == length, found.digest(length)).otherwise(digest)
    sums = found.rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    rows = found.rows.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return rows.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.marked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), n=10)
    digest = F.sha2(F.array_join("hit_items", ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_cube_mixing, op2_feistel_sharding, op3_exact_top_k, op4_quality_classifier, op5_html_extraction, op6_pii_sanitisation, op7_secret_scan, op8_nearest_neighbours, op9_ngram_join, op10_vector_packing, op11_periodic_runs, op12_vector_codes, op13_decontamination)
}



def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds without bounds: every part against every entry, a CTE a round."""
    nearest = """
        a{k} AS MATERIALIZED (
            SELECT r, p, arg_min(e, {{'d': d, 'e': e}}) AS e, min(d) AS d
            FROM (SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN b{k} b USING (p))
            GROUP BY r, p
        )"""
    moved = """
        b{next} AS MATERIALIZED (
            SELECT p, e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
                SELECT p, e, list(s ORDER BY i) AS x FROM (SELECT a.p, a.e, i, (sum(x.x[i]) // count(*) - CASE WHEN sum(x.x[i]) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS s FROM a{k} a JOIN x USING (r, p), unnest(range(1, len(x.x) + 1)) AS t(i) GROUP BY a.p, a.e, i) GROUP BY p, e
            ) m USING (p, e)
        )"""
    steps = ",".join(nearest.format(k=k) + "," + moved.format(k=k, next=k + 1) for k in range(rounds)) + "," + nearest.format(k=rounds)
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), x AS MATERIALIZED (
            SELECT r, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM v, unnest(range({parts})) AS t(p)
        ), b0 AS MATERIALIZED (
            SELECT p, r - 1 AS e, x FROM x WHERE r <= {entries}
        ),{steps}, o AS (
            SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
            (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
        FROM v JOIN o USING (r)"""


ORACLES: dict[str, str] = {
    "op12_vector_codes": _codes_sql(),
    "op3_exact_top_k": """
        WITH v AS (
            SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.own, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.own <> c.own AND len(q.e) = len(c.e)
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 10""",
    "op8_nearest_neighbours": """
        WITH v AS (
            SELECT row_number() OVER () AS own, vec_id, embedding::DOUBLE[] AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), s AS (
            SELECT q.own, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
            FROM v q JOIN v c ON q.own <> c.own AND len(q.e) = len(c.e)
            WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS n FROM s
        )
        SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20""",
    "op9_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d
        ), n AS (
            SELECT doc_id, len(g) AS n FROM s
        ), e AS (
            SELECT doc_id, unnest(g) AS x FROM s
        ), p AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (
            SELECT u, v FROM p JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)
        ), b AS (
            SELECT u, v FROM l UNION ALL SELECT v, u FROM l
        ), r(doc_id, m) AS (
            SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.m
        )
        SELECT doc_id, any_value(n.n)::BIGINT AS n_shingles, min(m) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id""",
    "op11_periodic_runs": r"""
        WITH c AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, x:
                    list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS h
            FROM documents
        ), a AS (
            SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM c
        ), d AS (
            SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) END]) END AS w FROM a
        ), t AS (
            SELECT r, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM d
        ), e AS (
            SELECT x.r, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
        ), g AS (
            SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM e
        ), s AS (
            SELECT r, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)
        ), u AS (
            SELECT r, start, length, min(q) AS period FROM s GROUP BY r, start, length
        ), m AS (
            SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
                arg_min({'start': start, 'length': length, 'period': period}, {'x': -1000000000 * length // period, 'start': start, 'period': period}) AS best FROM u GROUP BY r
        ), k AS (
            SELECT r, string_agg(word, ' ' ORDER BY i) AS collapsed FROM t
            WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.r = t.r AND t.i >= u.start + u.period AND t.i < u.start + u.length) GROUP BY r
        )
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
            (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
        FROM d LEFT JOIN m USING (r) LEFT JOIN k USING (r)""",
    "op13_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), i AS (
            SELECT DISTINCT item_id::VARCHAR AS item, least(len(w), 10) AS l, w[k:k + least(len(w), 10) - 1] AS win FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(k) WHERE len(w) > 0
        ), h AS (
            SELECT r, k, l, item FROM (SELECT r, k, l, w[k:k + l - 1] AS win FROM d, (SELECT DISTINCT l FROM i), unnest(range(1, len(w) - l + 2)) AS t(k)) JOIN i USING (l, win)
        ), n AS (
            SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + l)) AS p FROM h) GROUP BY r
        ), x AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN n USING (r) LEFT JOIN x USING (r)""",
}
