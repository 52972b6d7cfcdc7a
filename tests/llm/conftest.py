import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Texts by id: plain, copies, near copies, shared passages, short, empty, null, long, odd characters."""
    rng = random.Random(1)
    out: dict[int, str | None] = {}
    for n in range(40):
        out[n] = " ".join(words(rng, rng.randrange(30, 160)))
    for n in range(40, 52):  # copies, and copies that differ in a few words
        base = out[n % 6].split()
        if n % 3:
            for _ in range(n % 3 * 2):
                base[rng.randrange(len(base))] = f"edit{rng.randrange(99)}"
        out[n] = " ".join(base)
    passage = " ".join(words(rng, 60))
    for n in range(52, 60):
        out[n] = " ".join([*words(rng, 20), passage, *words(rng, 15)])
    out[60], out[61], out[62], out[63] = None, "", " \t\n ", "two words"
    out[64] = "abc " * 300  # repeats itself
    out[65] = " ".join(words(rng, 9000))  # long
    out[66] = "é ü 漢字 \x0b 😀 " * 60
    out[67] = "x" * 5000  # one long word
    out[68] = out[0].upper()
    out[69] = out[0] + " " + out[1]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(n, t, "en", None if n % 7 == 0 else f"src{n % 3}", len(t or "")) for n, t in texts.items()]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def odd_docs(spark, docs):
    """The same with a null id, a row twice, and columns whose names an operator may use."""
    from pyspark.sql import functions as F

    more = spark.createDataFrame(
        [(None, "alone among all others here", None, None, None), (3, docs.where("doc_id = 3").first()["text"], "en", "src0", 0)],
        DOCS,
    )
    names = ["size", "bucket", "key", "vid", "comp", "row_key", "digest", "place", "target", "position", "rule", "host"]
    return docs.unionByName(more).select("*", *[F.lit(-1).alias(n) for n in names])


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
