"""Helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what parts words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a folder of the warehouse where the session names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder, so that what made them never runs again."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written as a table of the shared folder and read again: as ``cut``, but the size is known from there on.

    A join then sends a small table to the tasks instead of shuffling both sides.
    """
    folder = f"{shared_folder(rows.sparkSession)}/table-{uuid.uuid4()}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(rows: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    """``rows`` with their number (from 0) in a global order, without one task that holds them all.

    Rows are sorted by ranges and written; the driver gets one count per range.
    """
    done = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    numbered = done.withColumn("_part", F.spark_partition_id()).withColumn(
        rank, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = {r["_part"]: r["n"] for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(part, 0)
    starts = F.array(*[F.lit(n).cast("long") for n in before or [0]])
    return numbered.withColumn(rank, F.col(rank) + F.get(starts, F.col("_part"))).drop("_part")


def map_batches(
    rows: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``work`` on each Arrow batch; it returns one batch, none, or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return rows.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a text column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of about ``limit`` bytes together; a longer text is alone."""
    start = total = 0
    for n, text in enumerate(texts):
        if n > start and total + len(text) > limit:
            yield start, n
            start, total = n, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))
