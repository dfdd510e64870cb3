"""A training corpus from raw documents: five stages, each an operator of touchline.llm on all rows that the one before kept.

language   drop documents whose language can't be told (operator 4)
quality    drop documents that the rules or the importance ratio reject (operator 10)
near_copies  keep one document of each group of near copies (operator 8)
personal   replace personal data (operator 9)
packing    tokenise and pack into training sequences (operator 2)
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import langid, packing, pii, quality, simhash
from touchline.llm.common import read_table, shared_folder
from touchline.llm.queries import TOKENIZER


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("language", language), ("quality", good), ("near_copies", near_copies), ("personal", personal), ("packing", packed)]

#: Bloom filters, hashed n-grams, fingerprints and the tokenizer have no SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the folder that the cluster shares, and read again by the next one; once a stage
    is written, what it read is removed."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(f"{folder}/{name}"), f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
