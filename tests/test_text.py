import pytest
from pyspark.sql import functions as F

from storefront.functions import text
from storefront.params import WHITESPACE
from storefront.sources.cities import (
    city_lists,
    city_queries,
    distinct_cities,
    read_cities,
)


def test_utrim_takes_every_unicode_space(evaluate):
    spaces = WHITESPACE
    assert evaluate([f"{spaces}a b{spaces}", spaces, "", None], text.utrim) == ["a b", "", "", None]


def test_utf16_length(evaluate):
    assert evaluate(["abc", "é", "😀x", ""], text.utf16_length) == [3, 1, 3, 0]


def test_template_takes_the_city_literally(evaluate):
    expand = lambda c: text.expand_template("gym in [City] [city]", c)
    assert evaluate(["A$1", "B\\2", "Pune"], expand) == [
        "gym in A$1 A$1",
        "gym in B\\2 B\\2",
        "gym in Pune Pune",
    ]


def test_sheet_names(evaluate):
    cities = ["New york/[x]: CITY  ab", "new-york", "***", "a" * 40, "straße ßa", " delhi "]
    assert evaluate(cities, text.sheet_name) == [
        "New Yorkx- City  Ab",
        "New-york",
        "Sheet",
        "A" + "a" * 30,
        "Straße SSa",
        "Delhi",
    ]


def test_phone_clean_keeps_spaces_of_any_kind(evaluate):
    assert evaluate(
        ["Tel: +91 (0) 2-3", "09 100", "x", "９１2", "a·0123é4​5"], text.phone_clean
    ) == ["+91 (0) 2-3", "09 100", "", "2", "012345"]


def test_phone_shapes(evaluate):
    texts = ["091000 00000", "123456", "1" * 20, "1" * 21, "call 1234567", "+1 (2) 3-4"]
    assert evaluate(texts, text.is_phone) == [True, False, True, False, False, True]
    tails = ["Open 24 hours · 091000 00000", "a · b · 1234567", "·123456", "· 1234567 x", "1234567", "· 123456"]
    # In the last one the space after the dot is the seventh phone character.
    assert evaluate(tails, text.phone_tail) == ["091000 00000", "1234567", "", "", "", "123456"]
    runs = ["Call 091000 00000 now", "4785380592391139", "1 2 3x", "a       b 1234567"]
    assert evaluate(runs, text.phone_run) == ["091000 00000", "4785380592391139", "", ""]


def test_address_clean(evaluate):
    assert evaluate(
        ["Address: 1 Main St", "aDDress: 1 Main St", "⁦Address: 1 Main St⁩", "12 ⁦A, B⁩"],
        text.address_clean,
    ) == ["1 Main St", "1 Main St", "Address: 1 Main St", "12 A, B"]


def test_address_shape(evaluate):
    texts = [
        "12 Main Road, Town",
        "Open, closes 9 pm",
        "closed, opens 9 am",
        "9:00, Monday morning",
        "12 Amber Road, Town",
        "Springfield, IL",
        "Short, x",
        "x" * 195 + ", y,z",
        "no comma in this one",
    ]
    assert evaluate(texts, text.is_address) == [
        True, False, False, False, False, True, False, False, False,
    ]


def test_city_line(evaluate):
    assert evaluate(["Abc, X", "A, BC", "Open, now", "Pune, India"], text.is_city_line) == [
        True, False, False, True,
    ]


def test_name_key(evaluate):
    assert evaluate([" Cafe ", "CAFÉ", "İ"], text.name_key) == ["cafe", "café", "i̇"]


def test_city_list(spark, tmp_path):
    path = tmp_path / "cities.txt"
    path.write_bytes(b"# c\n Delhi \n\nMumbai\r\nDelhi\n#x\nPune")
    cities = read_cities(spark, str(path))
    rows = sorted((r.ord, r.city) for r in cities.collect())
    assert rows == [(0, "Delhi"), (1, "Mumbai"), (2, "Delhi"), (3, "Pune")]
    assert sorted(tuple(r) for r in distinct_cities(cities).collect()) == [
        (0, "Delhi"), (1, "Mumbai"), (3, "Pune"),
    ]
    queries = {r.city: r.query for r in city_queries(cities, "gym in [city], [CITY]").collect()}
    assert queries["Pune"] == "gym in Pune, Pune"


def test_city_list_without_a_city_is_an_error(spark, tmp_path):
    path = tmp_path / "cities.txt"
    path.write_text("# only\n\n   \n#comments")
    with pytest.raises(ValueError):
        read_cities(spark, str(path))


def test_a_city_file_read_in_many_splits(spark, tmp_path):
    """Lines, also those cut by the end of a split, keep their order, blanks and comments do not count."""
    lines, cities = [], []
    for n in range(4000):
        name = f"City {n % 700} é{'x' * (n % 40)}"
        lines += [f"  {name} \r", "", "# not " + name, " \u00a0"][: 1 + n % 4]
        cities.append(name)
    path = tmp_path / "cities.txt"
    path.write_bytes("\n".join(lines).encode())
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 8
        rows = read_cities(spark, str(path))
        assert [tuple(r) for r in rows.orderBy("ord").collect()] == list(enumerate(cities))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_several_city_files_in_order_of_their_paths(spark, tmp_path):
    for name, text in (("b.txt", "C\nD"), ("a.txt", "A\r\n\r\nB\r\n"), ("c.txt", "# none\n")):
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in read_cities(spark, str(tmp_path)).orderBy("ord").collect()] == [(0, "A"), (1, "B"), (2, "C"), (3, "D")]


def test_many_city_lists(spark):
    files = spark.createDataFrame([(1, "a\n#b\nc"), (2, "\r\n"), (3, None)], "f int, t string")
    rows = sorted(tuple(r) for r in city_lists(files, ["f"], "t").collect())
    assert rows == [(1, 0, "a"), (1, 1, "c")]


def test_template_must_hold_the_placeholder(spark):
    cities = spark.createDataFrame([(0, "a")], "ord int, city string")
    with pytest.raises(ValueError):
        city_queries(cities, "gym in [CITY]")


def test_template_column(spark):
    df = spark.createDataFrame([("x [CITY]", "a"), ("none", "b")], "t string, c string")
    out = df.select(text.expand_template(F.col("t"), F.col("c")).alias("q")).collect()
    assert sorted(r.q for r in out) == ["none", "x a"]
