"""Cutting a costly lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: that of ``spark.checkpoint.dir``, else one in the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialize(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read from there.

    For a narrow table that was costly to compute and is read more than once, or
    whose partitions must be the same each time: nothing before it runs again,
    also not after the loss of an executor.
    """
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)
