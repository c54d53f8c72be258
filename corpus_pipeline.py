"""Five stages over ``documents``, each written as a table before the next one reads it.

Quality and toxicity drop the documents that they reject, exact and near dedup keep one document of
each group, and packing lays what remains into sequences. All stages but the last return the columns of
their input. A stage bounds what readers and writers of long texts hold in the JVM, whose heap may be 1 GB
for eight tasks. Nulls, empty texts, repeated rows and empty tables are handled as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseloom.llm import exact_dedup, near_dedup, packing, quality, toxicity
from verseloom.llm.queries import BPE_FILE
from verseloom.llm.shared import materialize
from verseloom.runtime import bound_memory


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    bound_memory(spark)
    model = quality.train(*_labelled(spark, sf_dir))
    return quality.with_score(docs, model, score_col="__quality").where(F.col("__quality") >= quality.THRESHOLD).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    bound_memory(spark)
    lexicon = toxicity.train(*_labelled(spark, sf_dir))
    return toxicity.with_score(docs, lexicon, score_col="__toxicity").where(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_memory(spark)
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_memory(spark)
    return near_dedup.deduplicated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_memory(spark)
    return packing.pack(docs, BPE_FILE)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Trained models and packing have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
