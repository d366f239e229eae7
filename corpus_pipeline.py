"""A corpus pipeline: five stages, each one operator, over `documents`.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next one's docs.  All but the last give the
columns of documents.

quality        documents that the classifier rejects go
near_copies    of documents that shingle similarity of 0.75 or more joins, the smallest doc_id stays
decontaminate  documents that hold a benchmark item within its error budget go
pii            personal data in the texts gives way to its kind; n_chars follows
mixture        rows (doc_id, domain, lang, source, epoch, n_tokens) that meet the target weights

Empty tables give empty results; null texts are empty texts; rows that repeat
are rows of their own until near_copies; a null doc_id stays; texts are taken
whole, however long; ties go to the smallest doc_id.  Columns besides those of
documents go along until the last stage, whatever they are called, but for
_quality_score and _quality_class, which the first stage takes for itself and
drops, and domain, which the last one makes anew from source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate as _decontaminate
from pagemill.llm import mixing as _mixing
from pagemill.llm import ngram_join as _ngram_join
from pagemill.llm import pii as _pii
from pagemill.llm import quality as _quality
from pagemill.llm.common import scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _quality.scored(docs, table(spark, sf_dir, "labels"), "_quality_score", "_quality_class").where("_quality_class = 1").drop("_quality_score", "_quality_class")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _mixing.mixed(docs.withColumn("domain", _mixing.domain_of(F.col("source"))))


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontaminate", decontaminate), ("pii", pii), ("mixture", mixture)]

#: The classifier is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
