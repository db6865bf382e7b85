"""A corpus pipeline: five stages, each a training-data operator over the last one's documents.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  A stage's result is written and read
again before the next, so a stage works on just what its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from parlance.llm.runtime import let_go, shared_dir, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine rejects go."""
    # the machine learns from the labelled documents of the corpus as it came
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.remove_scored(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each Jaccard component (five words, 0.8) stays."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards flatter source, language and topic shares."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and its slot there."""
    return sharding.assign(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing_sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: A string-kernel machine and seeded sampling have no SQL form; the stages are tested against plain Python.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    A stage's table goes once its successor's is written, and what it cut and shuffled once its own is;
    the last table stays for the caller to read.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    shared = shared_dir(spark)
    # Spark made a folder of its own in the one that was named
    before = spark.sparkContext._jsc.sc().getCheckpointDir().get().rsplit("/", 1)[0]
    folder = f"{shared}/pipeline-{uuid.uuid4().hex}"
    try:
        for k, (name, stage) in enumerate(STAGES):
            path, cuts = f"{folder}/{k}-{name}", f"{folder}/{k}-cuts"
            spark.sparkContext.setCheckpointDir(cuts)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            for old in (cuts, last) if last else (cuts,):
                _remove(spark, old)
            let_go(spark)
            last = path
    finally:
        spark.sparkContext.setCheckpointDir(before)
    return docs
