from pyspark.sql import functions as F

from storefront.operators.rows import dedup_counts
from storefront.params import BUSINESS_FIELDS
from storefront.sinks import export

BUSINESS = ", ".join(f"{f} string" for f in BUSINESS_FIELDS)


def _rows(spark, values):
    """``values``: (city_ord, city, ord, {field: value})."""
    rows = [(co, c, o, *(v.get(f, "") for f in BUSINESS_FIELDS)) for co, c, o, v in values]
    return spark.createDataFrame(rows, f"city_ord int, city string, ord int, {BUSINESS}").repartition(3)


def _cities(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "ord int, city string")


def test_columns_blanks_and_links(spark):
    rows = _rows(
        spark,
        [(0, "A", 0, {"name": "x", "email": "a@b.c", "website": "https://x.test/"}), (0, "A", 1, {"name": "", "phone": None})],
    )
    table = export.export_rows(rows, ["ord"])
    assert table.columns == [
        "ord", "Name", "Website", "Phone", "Email", "Address", "Facebook", "Instagram", "Twitter/X", "LinkedIn",
    ]
    assert [tuple(r) for r in table.orderBy("ord").collect()] == [
        (0, "x", "https://x.test/", "", "a@b.c", "", "", "", "", ""),
        (1, "N/A", "", "", "", "", "", "", "", ""),
    ]
    links = export.export_links(rows, ["ord"]).orderBy("ord").collect()
    assert [tuple(r) for r in links] == [(0, "https://x.test/", "mailto:a@b.c"), (1, None, None)]


def test_column_widths(spark):
    rows = _rows(
        spark,
        [
            (0, "A", 0, {"name": "1234567890", "website": "w" * 100, "phone": "😀" * 5}),
            (0, "A", 1, {"name": ""}),
            (1, "B", 0, {"name": "abc", "address": "a" * 56}),
        ],
    )
    whole = {r.header: r.width for r in export.column_widths(rows).collect()}
    assert whole == {
        "Name": 14, "Website": 60, "Phone": 14, "Email": 9, "Address": 60,
        "Facebook": 12, "Instagram": 13, "Twitter/X": 13, "LinkedIn": 12,
    }
    by_city = {(r.city, r.header): r.width for r in export.column_widths(rows, ["city"]).collect()}
    assert by_city["A", "Name"] == 14 and by_city["B", "Name"] == 8 and by_city["B", "Address"] == 60
    assert len(by_city) == 18
    none = {r.header: r.width for r in export.column_widths(rows.limit(0)).collect()}
    assert none["Name"] == 8 and none["Twitter/X"] == 13


def test_manifest_status_and_totals(spark):
    cities = _cities(spark, ["delhi", "Pune", "delhi", "PUNE", "Goa"])
    rows = _rows(
        spark,
        [(0, "delhi", 0, {"name": "a"}), (0, "delhi", 1, {"name": "A "}), (0, "delhi", 2, {"name": ""}), (1, "Pune", 0, {"name": "b"})],
    )
    manifest = sorted(tuple(r) for r in export.sheet_manifest(cities, rows).collect())
    assert manifest == [
        (0, "delhi", "Delhi", 3, False), (1, "Pune", "Pune", 1, True), (3, "PUNE", "Pune", 0, True), (4, "Goa", "Goa", 0, False),
    ]
    status = export.run_status(cities, dedup_counts(rows, ["city"]))
    assert sorted(tuple(r) for r in status.collect()) == [
        (0, "delhi", 3, 1, 2, False), (1, "Pune", 1, 1, 0, False), (3, "PUNE", 0, 0, 0, True), (4, "Goa", 0, 0, 0, True),
    ]
    assert [tuple(r) for r in export.batch_totals(status).collect()] == [(2, 2, 4, 2)]
    assert [tuple(r) for r in export.batch_totals(status.limit(0)).collect()] == [(0, 0, 0, 0)]


def test_city_order(spark):
    cities = _cities(spark, ["Z", "A", "Z", "M"])
    rows = spark.createDataFrame([("A", 1), ("Z", 2), ("A", 0), ("Z", 0)], "city string, ord int")
    out = [tuple(r) for r in export.in_city_order(cities, rows, ["ord"]).select("city_ord", "city", "ord").collect()]
    assert out == [(0, "Z", 0), (0, "Z", 2), (1, "A", 0), (1, "A", 1), (3, "M", None)]


def _counted(spark, rows):
    """``rows`` and a counter of how often one of them is computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(count, rows.schema), seen


def test_rows_are_computed_once(spark, tmp_path):
    """For the order of cities, a single table and a batch, whatever reads them how often."""
    rows = _rows(spark, [(n % 2, "AB"[n % 2], n, {"name": f"n{n}"}) for n in range(50)])
    cities = _cities(spark, ["A", "B", "C"])
    counted, seen = _counted(spark, rows)
    assert export.in_city_order(cities, counted, ["ord"]).count() == 51 and seen.value == 50
    counted, seen = _counted(spark, rows)
    assert export.write_table(counted, str(tmp_path / "one"), ["ord"]) and seen.value == 50
    counted, seen = _counted(spark, rows)
    export.write_batch(counted, cities, str(tmp_path / "many"), ["city_ord", "ord"])
    assert seen.value == 50


def test_single_table_files(spark, tmp_path):
    rows = _rows(spark, [(0, "A", i, {"name": f"n{i:02d}"}) for i in range(30)])
    path = str(tmp_path / "one")
    assert export.write_table(rows, path, ["ord"], fmt="csv") is True
    assert export.write_table(rows.limit(0), str(tmp_path / "none"), ["ord"]) is False
    assert not (tmp_path / "none").exists()
    back = spark.read.csv(path, header=True)
    assert back.columns[0] == "Name" and back.columns[-1] == "LinkedIn"
    assert [r.Name for r in back.collect()] == [f"n{i:02d}" for i in range(30)]


def test_batch_files(spark, tmp_path):
    cities = _cities(spark, ["new york", "Pune", "Empty"])
    rows = _rows(
        spark,
        [(0, "new york", i, {"name": f"n{i}"}) for i in range(200)] + [(1, "Pune", 0, {"name": "p", "email": "a@b.c"})],
    )
    path = str(tmp_path / "batch")
    export.write_batch(rows, cities, path, ["city_ord", "ord"])
    folders = sorted(str(p.relative_to(tmp_path / "batch" / "tables")) for p in (tmp_path / "batch" / "tables").glob("*/*"))
    assert folders == ["city_ord=0/sheet=New York", "city_ord=1/sheet=Pune"]
    back = spark.read.parquet(f"{path}/tables")
    assert back.columns[0] == "ord" and "Twitter/X" in back.columns
    assert [r.Name for r in back.where("city_ord = 0").orderBy("ord").collect()] == [f"n{i}" for i in range(200)]
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("city_ord").collect()
    assert [(r.sheet, r.n) for r in manifest] == [("New York", 200), ("Pune", 1), ("Empty", 0)]


def test_batch_files_split_a_large_city(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.lit(0).alias("city_ord"), F.lit("Hot").alias("city"), F.col("id").cast("int").alias("ord"),
        *(F.sha2(F.concat(F.lit(f), "id"), 256).alias(f) for f in BUSINESS_FIELDS),
    ).repartition(8)
    saved = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        export.write_batch(rows, _cities(spark, ["Hot"]), str(tmp_path / "b"), ["city_ord", "ord"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", saved)
    assert len(list((tmp_path / "b" / "tables").glob("*/*/*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "b" / "tables")).count() == 60_000
