"""From raw documents to a training mix; each stage reads the Parquet its predecessor wrote.

A stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``. All but the last return the columns of
``documents``. A stage on an empty table returns an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, exact, mixing, near, quality
from cairn.llm.common import free_name, table
from cairn.plans.lineage import ensure_checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the co-trained views accept."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest id."""
    return exact.drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies keep the document with the largest id."""
    return near.drop_near(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with their size, their source's size and target, how often and how many words they are taken."""
    mixed = mixing.mix(docs, F.array("source"), carry=True)
    name = {n: free_name(docs, n) for n in ("size", "source_sizes", "targets", "repeats", "taken")}
    source_size, target = free_name(docs, "source_size"), free_name(docs, "target")
    return mixed.filter(F.col(name["taken"]) > 0).select(
        *[F.col(f"`{c}`") for c in docs.columns], name["size"], F.col(name["source_sizes"])[0].alias(source_size), F.col(name["targets"])[0].alias(target), name["repeats"], name["taken"]
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
]

# The first stage is a trained classifier, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
