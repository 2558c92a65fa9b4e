"""The registered queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, exact_dedup, hard_negatives, html_text, line_dedup, minhash, mixing, packing, pii, quality, suffix_dedup, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.classes(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").withColumnRenamed("class_id", "class_doc_id")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = pii.spans(docs, pii.fit(docs))
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "added"))
    return found.select(F.col("id").alias("doc_id"), *[count("base", k).alias(f"n_{kind}") for k, kind in enumerate(pii.RULES)], F.sha2(pii.named(F.col("base")), 256).alias("base_sha256"),
                        pii.named(every).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(every).cast("long").alias("n_spans"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    weights = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    return quality.scores(docs, weights).select(F.col("id").alias("doc_id"), quality.held_out(F.col("id")).alias("held_out"), "score",
                                                (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.classes(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", "url", html_text.rendered("html").alias("text"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start_word"), F.col("end").cast("long").alias("end_word"),
        (F.col("end") - F.col("start")).cast("long").alias("n_words"), "first_doc_id", "kept")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each document under both tokenizers; runs jobs (see ``alignment.aligned``)."""
    return alignment.aligned(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: ids divisible by 100; labels of ids divisible by 7 are one further. Runs jobs (see ``hard_negatives.mine``)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: ids divisible by 50. Runs a job (see ``topk.search``)."""
    rows = _table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where(F.col("vec_id") % 50 == 0))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_packing": op3_token_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_source_mixing": op7_source_mixing,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_html_text": op9_html_text,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_exact_topk": op13_exact_topk,
}

_WHOLE = """list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLE = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c,
                          regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t ORDER BY c DESC, doc_id)""",
    "op2_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g
               FROM i, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(s) WHERE len(w) > 0),
        dw AS (SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS g
               FROM d, (SELECT DISTINCT l FROM iw) AS k, unnest(generate_series(1, len(w) - l + 1)) AS t(s)),
        hits AS (SELECT doc_id, s, l, item_id FROM dw JOIN iw USING (l, g)),
        cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(generate_series(s, s + l - 1)) AS u(p) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op12_hard_negatives": f"""
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AND label IS NOT NULL),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.w, b.w) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10""",
    "op13_exact_topk": f"""
        WITH v AS (SELECT vec_id, {_WHOLE}),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.w, b.w) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
}
