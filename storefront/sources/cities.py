"""City lists and the queries made from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storefront.functions.text import expand_template, utrim
from storefront.materialize import materialize
from storefront.params import check_template


def city_array(text: Column) -> Column:
    """The cities of one list: a line each, trimmed; blank and ``#`` lines do not count."""
    lines = F.transform(F.split(text, r"\r?\n"), utrim)
    return F.filter(lines, lambda line: (line != "") & ~line.startswith("#"))


def city_lists(files: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """``(*by, ord, city)`` for a table with the text of one list per row.

    Order and repeats are kept; ``ord`` counts the cities of a list from 0.
    """
    return files.select(*by, F.posexplode(city_array(F.col(text))).alias("ord", "city"))


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, city)`` of UTF-8 text, files in order of their paths; no city at all is an error.

    A file is read in splits. A line's place is that of its split in the file and its
    own in the split; the cities of each split are counted, so ``ord`` counts from 0
    over all of them and no task reads a whole file.
    """
    city, at = utrim(F.col("value")), F.col("_metadata")
    lines = spark.read.text(path, lineSep="\n").select(
        at["file_path"].alias("_file"),
        at["file_block_start"].alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
        city.alias("city"),
    )
    cities = materialize(lines.where((F.col("city") != "") & ~F.col("city").startswith("#")))
    if cities.isEmpty():
        raise ValueError("the city list is empty: one city per line is expected")
    split = ["_file", "_start"]
    # a row for each split
    counts = cities.groupBy(*split).agg(F.count("*").alias("_n"))
    before = counts.select(*split, (F.sum("_n").over(Window.orderBy(*split)) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*split).orderBy("_line")) - 1
    placed = cities.withColumn("_inside", inside).join(before, split)
    return placed.select((F.col("_before") + F.col("_inside")).cast("int").alias("ord"), "city")


def distinct_cities(cities: DataFrame) -> DataFrame:
    """``(city_ord, city)``: a repeated city keeps its first place."""
    return cities.groupBy("city").agg(F.min("ord").alias("city_ord")).select("city_ord", "city")


def city_queries(cities: DataFrame, template: str) -> DataFrame:
    """``cities`` with ``query``, the template with the city filled in."""
    return cities.withColumn("query", expand_template(check_template(template), F.col("city")))
