"""Corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, then the mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenflow.llm import decontaminate, mixing, simhash, substring_dedup, toxicity
from sirenflow.llm.common import shared_dir


#: Rows of an Arrow batch: bounds what Python workers hold of long texts.
BATCH_ROWS = 1_000


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    _small_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies stays, the one with the smallest id."""
    return simhash.near_dedup(docs)


def _repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and sentences are cut out of all but their first document."""
    _small_batches(spark)
    cut = substring_dedup.substring_dedup(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("removed_chars") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def _leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words to take from each document for the sources' targets."""
    return mixing.mix(docs)


STAGES = [("toxicity", _toxicity), ("near duplicates", _near_duplicates), ("repeated passages", _repeats), ("benchmark leaks", _leaks), ("source mix", _mix)]

#: The classifier and the fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a Parquet table in the shared folder and the next one's input, removed once that is written."""
    at = f"{shared_dir(spark)}/pipeline-{spark.sparkContext.applicationId}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/{k - 1}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return docs
