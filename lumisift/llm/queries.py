"""Registered queries of the training-data operators, and their SQL.

Every query applies its operator with production parameters to its whole
table and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import ORACLE as DECONTAMINATION_SQL
from .filter_audit import ORACLE as AUDIT_SQL
from .hard_negatives import ORACLE as NEGATIVES_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import store_documents

    return store_documents(_table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), 40)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit_filters

    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_packing": op4_packing,
    "op5_token_store": op5_token_store,
    "op6_html": op6_html,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_sharding": op10_sharding,
    "op11_url_filter": op11_url_filter,
    "op12_filter_audit": op12_filter_audit,
    "op13_hard_negatives": op13_hard_negatives,
}

#: The main text of pages whose article is marked, by plain patterns.
HTML_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_replace(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?p>|</?h1>|<br>', ' ', 'g'), '</?b>', '', 'g') AS body FROM pages
), t AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS decoded FROM a
), s AS (SELECT page_id, url, trim(regexp_replace(decoded, '\s+', ' ', 'g')) AS text FROM t)
SELECT page_id, url, text, length(text) AS n_chars FROM s
"""

ORACLE_SQL: dict[str, str] = {
    "op6_html": HTML_SQL,
    "op7_decontamination": DECONTAMINATION_SQL,
    "op12_filter_audit": AUDIT_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
