"""The corpus pipeline: documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as
Parquet to shared storage and hands it to the next stage. All stages but the last return the
columns of documents:

1. quality rules reject texts (op 9), 2. of equal texts one stays (op 5), 3. of each group of
near copies one stays (op 1), 4. secrets are masked in the texts (op 7), 5. what is left is packed
(op 8).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tillpath.llm.common import read_table
from tillpath.llm.exact_dedup import drop_copies
from tillpath.llm.packing import pack
from tillpath.llm.quality_rules import drop_rejected
from tillpath.llm.secrets import redact
from tillpath.llm.simhash import drop_near_copies
from tillpath.session import scope, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("secret_scans", secrets),
    ("best_fit_packing", packing),
]

# The first stage is a trained classifier, which SQL cannot express; tests/llm compares with a
# plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    done = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, step in STAGES[:-1]:
        # What a stage keeps on its way goes when its result is written.
        with scope(spark):
            step(spark, docs, sf_dir).write.parquet(f"{done}/{name}")
        docs = spark.read.parquet(f"{done}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
