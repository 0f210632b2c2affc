"""The corpus pipeline: filtering, deduplication, decontamination and packing, stage by stage.

Each stage works on all rows its predecessor kept, written as Parquet and reread.
All but the last return the columns of ``documents``; the last returns the pieces
of the packed sequences with their token ids.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import remove_folder, shared_folder, table
from quern.llm.decontaminate import decontaminate
from quern.llm.exact_dedup import exact_dedup
from quern.llm.minhash_dedup import near_dedup
from quern.llm.packing import pack
from quern.llm.quality import keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; a null or empty text goes by the score of no bytes."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts; null and empty ones are one group."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component; texts without words all stay."""
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item's passage; null and empty texts stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces with their token ids; a null or empty text is its end token alone."""
    return pack(docs, with_ids=True)


STAGES = [("quality", quality), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", decontamination), ("packing", packing)]

#: The classifier and the tokenizer can't be told in SQL; tests compare each stage with a plain version of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Those between lie in the cluster's shared checkpoint
    folder until the next stage is written; the last stage's input stays there."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            remove_folder(spark, done)
        done = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
