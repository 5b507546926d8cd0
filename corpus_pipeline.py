"""A training-data pipeline over ``documents``: every stage works on all that
its predecessor kept, is written as Parquet, and read again by the next.

All stages but the last return the columns that they got, extra ones included,
and rows as they were. An empty table stays empty. Null ids and repeated rows are
judged like others until the third stage, where one row of each group stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumisift.llm.common import filesystem, fresh_path
from lumisift.llm.decontamination import decontaminated
from lumisift.llm.packing import pack_documents
from lumisift.llm.quality_classifier import classifier_filtered
from lumisift.llm.quality_rules import rule_filtered
from lumisift.llm.simhash import near_copies_removed


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likely low in quality or toxic go. A null text has no
    words, a null source or language is a site of its own."""
    return classifier_filtered(docs, _table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or a rule, learned from all labelled
    documents, go; null, empty and wordless texts fail the base test."""
    return rule_filtered(docs, _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, edited ones included, the smallest id
    stays: of rows that tie in it the text with the least hash, of equal rows
    one, and a null id only if the group has no other."""
    return near_copies_removed(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover a twentieth or more go; a
    text without a word is clean."""
    return decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, packed into sequences; very long texts are
    cut into as many pieces as they take."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: Learned models and token ids are beyond SQL; tests hold each stage against
#: a brute-force version or held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over the whole of ``documents``. What a stage kept is
    removed when the next one has written its own."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            fs, place = filesystem(before)
            fs.delete_dir(place)
        before = path
    return docs
