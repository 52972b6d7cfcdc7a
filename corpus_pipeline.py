"""A corpus pipeline: each stage takes the documents that the one before has kept.

Documents that the quality classifier rejects go; of near duplicates one stays;
documents that hold a benchmark item go; secrets are blotted out; the rest is put
in order of training, with how much of each is read. Every stage keeps the columns
of ``documents`` but the last, which adds its own.

Null or empty texts pass every stage until the mix, which takes no words of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storefront.llm.common import shared_folder
from storefront.llm.decontam import drop_leaks
from storefront.llm.mixing import mix
from storefront.llm.near_dup import keep_one
from storefront.llm.quality import keep_good
from storefront.llm.secrets import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that importance resampling accepts."""
    return keep_good(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id."""
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def blot_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; ``n_chars`` follows the text."""
    blotted = docs.withColumn("text", redact(F.col("text")))
    if "n_chars" in docs.columns:
        blotted = blotted.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))
    return blotted


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in order of training, with how many words are read and when; those not read go."""
    return mix(docs, keep=("text", "lang", "n_chars")).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", blot_secrets),
    ("mixing sources to target weights", mix_sources),
]

#: Several stages have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    out = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, folder).write.parquet(f"{out}/{number}")
        docs = spark.read.parquet(f"{out}/{number}")
    return docs
