"""Tables of captured pages and listings.

Nothing is fetched: a capture is a row with the HTML some other process stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
RESULT_PAGES = T.StructType(
    [
        T.StructField("query_ord", T.IntegerType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
LISTINGS = T.StructType(
    [
        T.StructField("query_ord", T.IntegerType()),
        T.StructField("page_no", T.IntegerType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("card_html", T.StringType()),
        T.StructField("panel_html", T.StringType()),
    ]
)
# With what the last name rule reads of the result page; null where a table has no such columns.
NAMED_LISTINGS = T.StructType(
    [
        *LISTINGS.fields,
        T.StructField("page_name", T.StringType()),
        T.StructField("page_names", T.IntegerType()),
    ]
)


def read_captures(
    spark: SparkSession, path: str, schema: T.StructType = PAGES, fmt: str = "parquet"
) -> DataFrame:
    """Captured rows from a file table; the schema is stated, never inferred."""
    return spark.read.format(fmt).schema(schema).load(path)
