"""Order MinHash: fingerprints that feel the order of a text, not only its parts.

A text is cut into units (words, long ones in pieces; characters where a script has no
blanks), and every ``K`` neighbouring units are a k-mer. K-mers are numbered by
occurrence, so that the second "a b c" is another element than the first. Elements
fall by hash into 2 x ``TUPLES`` bins; of each bin the least element is selected. The
two selected of neighbouring bins keep their order in the text, and the pair so ordered
is hashed: a tuple agrees between two texts if both elements are minimal in both and
stand in the same order.

Main path: DataFrame functions only. Documents are dealt into buckets of
neighbouring ids once; everything after that stays in its bucket.

Defined cases: a null text counts as empty; a text without units has no tuples, and
two such texts are fully alike; texts of fewer units than a k-mer are one k-mer;
ids in descending order, null last, equal ids by a hash of the text; the document
after the last is the first, so a single document follows itself; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storefront.llm.common import shuffle_partitions

#: Writing without blanks between words: there each character is a unit, so that an insertion shifts none.
UNBROKEN = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{10FFFF}"
UNIT = rf"[{UNBROKEN}]|[^\x20\x09-\x0D{UNBROKEN}]{{1,16}}"
K = 3
TUPLES = 64
#: Buckets for each shuffle partition: a bucket's k-mers are sorted in memory.
BUCKETS_EACH = 8


def _bucket_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are above the id; null goes last. A search in two steps."""
    if not bounds:
        return F.when(doc_id.isNull(), 1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]  # descending
    lasts = F.array(*[F.lit(g[-1]).cast("long") for g in groups])
    fine = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in [*groups, []]])
    whole = F.size(F.filter(lasts, lambda x: x > doc_id))
    rest = F.size(F.filter(F.get(fine, whole), lambda x: x > doc_id))
    # the last group may be short
    below = F.least(whole * step, F.lit(len(bounds))) + rest
    return F.when(doc_id.isNull(), len(bounds) + 1).otherwise(below)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """``bucket, rid, doc_id, text, next_text, filler`` in ``parts`` partitions by bucket.

    Rows of a bucket are numbered in order of descending id. A bucket ends with a
    filler: a copy of the first row of the next bucket, so that every row finds the
    one after it in its own bucket. The driver gets the bounds of the buckets and
    one id for each.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [n / parts for n in range(1, parts)]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10 * parts + 1000)).first()[0] or []
    bounds = sorted(set(found), reverse=True)
    rows = rows.withColumn("bucket", _bucket_of(F.col("doc_id"), bounds).cast("int")).withColumn("_h", F.xxhash64("text"))
    tops = {
        r["bucket"]: r["top"]
        for r in rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "_h")).alias("top")).collect()
    }
    order = sorted(tops)
    size = len(bounds) + 2
    before = {b: order[n - 1] for n, b in enumerate(order)}  # the first bucket follows the last
    at = F.col("bucket")
    top_id = F.get(F.array(*[F.lit(tops[b]["doc_id"] if b in tops else None).cast("long") for b in range(size)]), at)
    top_hash = F.get(F.array(*[F.lit(tops[b]["_h"] if b in tops else None).cast("long") for b in range(size)]), at)
    previous = F.get(F.array(*[F.lit(before.get(b, 0)) for b in range(size)]), at)
    is_top = F.col("doc_id").eqNullSafe(top_id) & (F.col("_h") == top_hash)
    own = F.struct(at.alias("bucket"), F.lit(False).alias("filler"))
    copy = F.struct(previous.alias("bucket"), F.lit(True).alias("filler"))
    dealt = rows.select(
        "doc_id", "text", "_h", F.inline(F.when(is_top, F.array(own, copy)).otherwise(F.array(own)))
    ).repartition(parts, "bucket")
    inside = W.partitionBy("bucket").orderBy("filler", F.col("doc_id").desc_nulls_last(), F.col("_h").desc())
    return dealt.select(
        "bucket",
        F.row_number().over(inside).alias("rid"),
        "doc_id",
        "text",
        F.lead("text").over(inside).alias("next_text"),
        "filler",
    )


def kmer_hashes(units: str) -> Column:
    """Hashes of all k-mers, in order, from a column of units (not an expression: it is read for each k-mer)."""
    units = F.col(units)
    many = F.transform(
        F.sequence(F.lit(0), F.size(units) - K), lambda i: F.xxhash64(*[F.get(units, i + n) for n in range(K)])
    )
    few = F.when(F.size(units) > 0, F.array(F.xxhash64(units))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(units) >= K, many).otherwise(few)


def order_minhash(rows: DataFrame, bucket: str, rid: str, variant: str, text: str) -> DataFrame:
    """``bucket, rid, variant, tuples``: for each row an array of ``TUPLES`` hashes, null where a bin pair is empty.

    ``rows`` is partitioned by ``bucket``, and a row is known by bucket, rid and variant.
    """
    keys = [bucket, rid, variant]
    units = rows.select(*keys, F.regexp_extract_all(F.col(text), F.lit(UNIT), F.lit(0)).alias("_units"))
    kmers = units.select(*keys, F.posexplode_outer(kmer_hashes("_units")).alias("_pos", "_h"))
    # equal k-mers of one text, in one sortable number; the bucket keeps the rows where they are
    kmers = kmers.withColumn("_same", F.xxhash64(*keys, "_h"))
    numbered = kmers.select(
        *keys, "_pos", "_h", F.row_number().over(W.partitionBy("_same", bucket).orderBy("_pos")).alias("_nth")
    )
    element = F.when(F.col("_h").isNotNull(), F.xxhash64("_h", "_nth"))
    elements = numbered.select(*keys, "_pos", element.alias("_element")).withColumn(
        "_bin", F.col("_element").bitwiseAND(F.lit(2 * TUPLES - 1)).cast("int")
    )
    least = elements.groupBy(*keys, "_bin").agg(F.min("_element").alias("_least"), F.min_by("_pos", "_element").alias("_at"))
    pairs = least.groupBy(*keys, F.shiftright("_bin", 1).alias("_tuple")).agg(
        F.min_by("_least", "_at").alias("_one"), F.max_by("_least", "_at").alias("_two")
    )
    hashed = F.xxhash64("_one", "_two").bitwiseAND(F.lit(0xFFFFFFFF))
    listed = pairs.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("_tuple").isNotNull(), F.struct(F.col("_tuple"), hashed.alias("_hash"))))
        ).alias("_map")
    )
    places = F.sequence(F.lit(0), F.lit(TUPLES - 1))
    return listed.select(*keys, F.transform(places, lambda n: F.try_element_at("_map", n)).alias("tuples"))


def as_text(tuples: Column) -> Column:
    """A fingerprint as hex digits, eight for a tuple; ``--------`` where there is none."""
    return F.array_join(F.transform(tuples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "", "--------")


def likeness(left: Column, right: Column) -> Column:
    """Share of tuples that agree, of those that either text has; 1 if neither has any."""
    either = F.size(F.filter(F.zip_with(left, right, lambda x, y: x.isNotNull() | y.isNotNull()), lambda z: z))
    agree = F.size(F.filter(F.zip_with(left, right, lambda x, y: x == y), lambda z: z))
    return F.when(either == 0, F.lit(1.0)).otherwise(agree / either)


def edited(text: Column, following: Column) -> Column:
    """The last half of the text replaced by the first as many characters of the following one."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, tuples, edited_tuples, next_tuples`` of each document."""
    parts = BUCKETS_EACH * shuffle_partitions(docs.sparkSession)
    rows = with_next(docs, parts).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    variants = F.array(
        F.struct(F.lit(0).alias("variant"), F.col("text").alias("own")),
        F.struct(F.lit(1).alias("variant"), F.col("edited").alias("own")),
    )
    texts = rows.select("bucket", "rid", F.inline(F.when(F.col("filler"), F.slice(variants, 1, 1)).otherwise(variants)))
    tuples = order_minhash(texts, "bucket", "rid", "variant", "own")
    both = tuples.groupBy("bucket", "rid").agg(
        F.max(F.when(F.col("variant") == 0, F.col("tuples"))).alias("tuples"),
        F.max(F.when(F.col("variant") == 1, F.col("tuples"))).alias("edited_tuples"),
    )
    following = F.lead("tuples").over(W.partitionBy("bucket").orderBy("rid"))
    both = both.withColumn("next_tuples", following)
    own = rows.where("NOT filler").select(
        "bucket", "rid", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")
    )
    return own.join(both, ["bucket", "rid"]).drop("bucket", "rid")
