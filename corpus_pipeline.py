"""A training corpus from raw documents, stage by stage.

Each stage works on all that its predecessor kept and is written before the next one reads it. Stage by stage:
documents that the quality rules reject go; repeated lines go from the texts; of each class of near copies one
document stays; documents that hold a benchmark item go; the rest is mixed to the sources' target weights, a row for
each time a document is taken. SQL can't express MinHash, edit matching and the drawing of blocks, so there is no
ORACLE_SQL; tests/llm holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import decontamination, line_dedup, near_dedup, quality_rules, source_mixing
from tickframe.llm.common import keep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without repeated lines; n_chars counts what is left. Every document stays, if with an empty text."""
    aside = {c: f"__{c}" for c in docs.columns if c in ("n_lines", "n_dropped")}
    out = line_dedup.line_dedup(docs.withColumnsRenamed(aside)).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs, shingle=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with epoch, shard and place."""
    return source_mixing.mixture(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing sources to target weights", mix),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return docs
