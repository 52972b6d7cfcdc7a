"""Output tables: columns, manifest, totals, widths and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from storefront.functions.text import sheet_name, utf16_length
from storefront.materialize import materialize
from storefront.operators.joins import spread_join
from storefront.params import (
    BLANK_NAME,
    COLUMN_MAX_WIDTH,
    COLUMN_PADDING,
    EXPORT_COLUMNS,
)
from storefront.sources.cities import distinct_cities

ColumnSpec = Sequence[tuple[str, str]]


def _filled(column: str) -> Column:
    value = F.coalesce(F.col(column), F.lit(""))
    return F.when(value == "", BLANK_NAME).otherwise(value) if column == "name" else value


def export_rows(
    rows: DataFrame, keep: Sequence[str] = (), columns: ColumnSpec = EXPORT_COLUMNS
) -> DataFrame:
    """The output table: ``keep`` columns, then the stated headers in order.

    A blank name reads ``N/A``, any other missing value is blank.
    """
    return rows.select(*keep, *(_filled(c).alias(header) for header, c in columns))


def export_links(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(*keep, website_link, email_link)``: link targets, null where there is no value."""
    website, email = F.col("website"), F.col("email")
    return rows.select(
        *keep,
        F.when(website != "", website).alias("website_link"),
        F.when(email != "", F.concat(F.lit("mailto:"), email)).alias("email_link"),
    )


def in_city_order(
    cities: DataFrame, rows: DataFrame, order: Sequence[str], city: str = "city"
) -> DataFrame:
    """Rows of all cities in the order of the list, then in their own order.

    A city without rows stays as one row of nulls. The rows meet the list in an
    inner join, where a city with a great share of them can be spread; the empty
    cities are added from the list. What makes the rows runs once: they are written
    before both of these read them.
    """
    listed = distinct_cities(cities).withColumnRenamed("city", city)
    rows = materialize(rows)
    payload = rows.drop("city_ord")
    filled = spread_join(payload, listed, [city], spread=order, how="inner")
    empty = listed.join(rows.select(city).distinct(), city, "left_anti")
    return filled.unionByName(empty, allowMissingColumns=True).orderBy("city_ord", *order)


def sheet_manifest(cities: DataFrame, rows: DataFrame) -> DataFrame:
    """``(city_ord, city, sheet, n, clash)``: one row per output table, empty ones too.

    ``clash`` marks cities whose table names are equal but for case. ``rows``
    needs ``city`` only; it is counted before it meets the list.
    """
    listed = distinct_cities(cities).withColumn("sheet", sheet_name(F.col("city")))
    counts = rows.groupBy("city").agg(F.count("*").alias("n"))
    names = listed.groupBy(F.lower("sheet").alias("_name")).agg((F.count("*") > 1).alias("clash"))
    return (
        listed.join(counts, "city", "left")
        .join(names, F.lower("sheet") == F.col("_name"))
        .select("city_ord", "city", "sheet", F.coalesce("n", F.lit(0)).alias("n"), "clash")
    )


def run_status(cities: DataFrame, counts: DataFrame) -> DataFrame:
    """``(city_ord, city, n_raw, n_kept, n_removed, is_empty)`` of every city.

    ``counts`` is what ``dedup_counts`` gives by ``city``.
    """
    zero = F.lit(0).cast("bigint")
    return (
        distinct_cities(cities)
        .join(counts, "city", "left")
        .select(
            "city_ord",
            "city",
            *(F.coalesce(n, zero).alias(n) for n in ("n_raw", "n_kept", "n_removed")),
            (F.coalesce("n_kept", zero) == 0).alias("is_empty"),
        )
    )


def batch_totals(status: DataFrame) -> DataFrame:
    """One row: rows kept and removed over all cities, cities, cities without rows."""
    zero = F.lit(0).cast("bigint")
    return status.agg(
        F.coalesce(F.sum("n_kept"), zero).alias("n_rows"),
        F.coalesce(F.sum("n_removed"), zero).alias("n_removed"),
        F.count("*").alias("n_cities"),
        F.count_if("is_empty").alias("n_empty"),
    )


def column_widths(
    rows: DataFrame, by: Sequence[str] = (), columns: ColumnSpec = EXPORT_COLUMNS
) -> DataFrame:
    """``(*by, pos, header, width)``: the longest value of each column plus a margin.

    One aggregation over all columns; without ``by`` a table without rows has
    the widths of its headers.
    """
    table = export_rows(rows, by, columns)
    longest = table.groupBy(*by).agg(
        *(F.max(utf16_length(F.col(f"`{header}`"))).alias(f"_{i}") for i, (header, _) in enumerate(columns))
    )
    entries = (
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(header).alias("header"),
            F.least(
                F.greatest(F.coalesce(f"_{i}", F.lit(0)), F.lit(len(header))) + COLUMN_PADDING,
                F.lit(COLUMN_MAX_WIDTH),
            ).alias("width"),
        )
        for i, (header, _) in enumerate(columns)
    )
    return longest.select(*by, F.inline(F.array(*entries)))


def write_table(
    rows: DataFrame,
    path: str,
    order: Sequence[str],
    fmt: str = "parquet",
    mode: str = "errorifexists",
) -> bool:
    """One table, rows in the stated order over the files of ``path``.

    Without rows nothing is written; the result tells. The rows are looked at
    more than once (any at all, range bounds, output), so what makes them runs
    once, into the shared folder.
    """
    rows = materialize(rows)
    if rows.isEmpty():
        return False
    _save(export_rows(rows.orderBy(*order)).write.mode(mode), path, fmt)
    return True


def write_batch(
    rows: DataFrame,
    cities: DataFrame,
    path: str,
    order: Sequence[str],
    fmt: str = "parquet",
    mode: str = "errorifexists",
) -> None:
    """One directory ``city_ord=…/sheet=…`` per city, and the manifest beside them.

    The rebalance lets Spark put small cities together and cut a large one into
    several files, each sorted; the ``order`` columns are written along, so the
    order over all files of a city can be had back. A city without rows has no
    directory and shows in the manifest only.
    """
    keys = [c for c in order if c not in ("city_ord", "city")]
    rows = materialize(rows)
    placed = rows.withColumn("sheet", sheet_name(F.col("city")))
    spread = placed.hint("rebalance", F.col("city_ord")).sortWithinPartitions("city_ord", *keys)
    table = export_rows(spread, ["city_ord", "sheet", *keys])
    _save(table.write.partitionBy("city_ord", "sheet").mode(mode), f"{path}/tables", fmt)
    manifest = sheet_manifest(cities, rows.select("city")).orderBy("city_ord")
    _save(manifest.write.mode(mode), f"{path}/manifest", fmt)


def _save(writer: DataFrameWriter, path: str, fmt: str) -> None:
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
