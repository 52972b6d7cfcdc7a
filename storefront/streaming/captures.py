"""Pages as they are captured.

Extraction is row-local, so the same function serves a table and a stream; this
adds only the file stream itself. Limits, duplicates and site look-ups need the
whole capture and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from storefront.operators.pages import extract_contacts
from storefront.sources.captures import PAGES


def read_capture_stream(
    spark: SparkSession, path: str, schema: T.StructType = PAGES, fmt: str = "parquet"
) -> DataFrame:
    """Capture files as they arrive in a folder."""
    return spark.readStream.format(fmt).schema(schema).load(path)


def stream_contacts(
    spark: SparkSession, path: str, schema: T.StructType = PAGES, fmt: str = "parquet", **options
) -> DataFrame:
    """``(page_id, url, email, one column per network)`` of every page that arrives."""
    return extract_contacts(read_capture_stream(spark, path, schema, fmt), **options)
