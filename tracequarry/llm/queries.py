"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .context_tree import score_texts
from .embedding_dedup import embedding_near_duplicates
from .exact_dedup import mark_exact_duplicates
from .html_templates import extract
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack
from .secrets import secret_digests
from .toxicity import toxicity
from .url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(_table(spark, sf_dir, "documents"))


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("passages")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pack_sequences, op2_main_text, op3_secret_scan, op4_url_verdicts, op5_source_mix, op6_near_dedup, op7_exact_dedup,
        op8_embedding_dedup, op9_context_tree_score, op10_toxicity,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op5_source_mix": r"""
        WITH d AS (
          SELECT doc_id, source, coalesce(text, '') AS t,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
          FROM documents
        ), k AS (
          SELECT doc_id, source, size,
                 -ln((CAST('0x' || substr(md5('20|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || t), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))
                 / least(CAST(1 AS DOUBLE), greatest(CAST(0.25 AS DOUBLE), 1 - abs(CAST(length(t) AS DOUBLE) / greatest(size, 1) - CAST(6 AS DOUBLE)) / CAST(10 AS DOUBLE))) AS ord
          FROM d
        ), s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source
        ), r AS (
          SELECT *, [CAST(5 AS DOUBLE), CAST(2 AS DOUBLE), CAST(1 AS DOUBLE)][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight,
                 row_number() OVER (ORDER BY source ASC NULLS LAST) AS rnk, source_size * CAST(2 AS DOUBLE) AS ceiling
          FROM s
        ), l AS (
          SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
                     - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY ceiling / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach
          FROM r
        ), g AS (
          SELECT *, max(CASE WHEN reach <= ceiling / weight THEN reach END) OVER () AS water FROM l
        ), t AS (
          SELECT source, source_size, CASE WHEN water IS NULL OR ceiling / weight <= water THEN ceiling ELSE water * weight END AS target FROM g
        ), p AS (
          SELECT k.*, t.source_size, t.target, floor(t.target / greatest(t.source_size, 1)) AS whole,
                 coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.ord, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source, source_size, target,
               CAST(whole * size + greatest(0, least(size, round(target - whole * source_size) - before)) AS BIGINT) AS taken
        FROM p
    """,
    "op8_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (
          SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
          AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), p AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), r(n, m) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, r.m FROM r JOIN p ON p.a = r.n WHERE r.m < p.b),
        c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n), l AS (SELECT a, count(*) AS k FROM p GROUP BY a)
        SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN c ON c.n = v.vec_id LEFT JOIN l ON l.a = v.vec_id
    """,
}
