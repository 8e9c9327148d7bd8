"""The corpus pipeline: five operators in a row over ``documents``.

Each stage gets what the one before kept, reread from Parquet, and returns the
columns of ``documents``; the last returns them with each row's shard and slot.
All stages take empty tables (and give empty ones), repeated rows (each is a row
of its own unless said otherwise), very long texts (whole) and columns of any
name that does not begin with two underscores, which they carry.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, mixing, ngram_join, quality, sharding
from factloom.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines above their host's limit.

    Null and empty texts go, as they have no words. A null source is a host of
    its own. A line in as many documents as the limit stays. Equal rows fare alike.
    """
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (an id with its text) of each group of near copies, that of the smallest doc_id, null last.

    Texts as similar as the limit are copies. Null and empty texts are copies of
    nothing but rows with their id; without id they stay. Repeated rows go.
    """
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a test item; null and empty texts have none and stay, and so does all if there are no items."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them.

    A null source is a source of its own. Null and empty texts have size 0: they
    are taken as often as others of their source, and not at all if nothing of
    it has words. Equal rows fare alike.
    """
    return mixing.mixture(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones and null texts too, with their shard and their slot in it, and size, checksum, law and old shard.

    Of a column with the name of one of these the result's stands.
    """
    return sharding.reshard(docs, carry=tuple(docs.columns))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mix),
    ("sharding", shards),
]

#: The cube method's draws can't be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and reread; a stage's files go when the next ones are there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
