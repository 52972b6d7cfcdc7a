"""Mixing sources to target weights along a curriculum that changes over training.

Each source has a weight curve over training time 0..1, given by straight lines
between knots. The area under the curve is the source's weight: its share of all
tokens. The curve's shape says when in training the source is read. A document's
token offset in its source is turned into a training position by inverting the
source's cumulative demand, and documents are range-sorted by position.

Main path: DataFrame functions only. A source of any size is spread over buckets
of its hash order; only bucket totals meet per source.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; rows with equal ``doc_id`` are rows of their own; an empty table gives
no rows; only the named columns are read, so extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storefront.llm.common import cut, ranked, shuffle_partitions, word_count

Curve = Sequence[tuple[float, float]]

#: Areas 5, 2, 1: the first fades, the second peaks halfway, the third grows.
CURVES: tuple[Curve, ...] = (
    ((0.0, 6.0), (1.0, 4.0)),
    ((0.0, 1.0), (0.5, 3.0), (1.0, 1.0)),
    ((0.0, 0.0), (1.0, 2.0)),
)
MAX_REPEATS = 3


def area(curve: Curve) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(curve, curve[1:]))


def position_of(share: Column, curve: Curve) -> Column:
    """The time by which ``share`` (0..1) of the curve's area has been used."""
    total, used = area(curve), 0.0
    result = F.lit(float(curve[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1) in zip(curve, curve[1:]):
        piece = (t1 - t0) * (w0 + w1) / 2
        if piece > 0:
            rest = F.greatest(share * total - used, F.lit(0.0))
            slope = (w1 - w0) / (t1 - t0)
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0)))
            # the root of slope/2 x^2 + w0 x = rest that stays exact for slope 0
            at = F.when(rest <= 0, F.lit(0.0)).otherwise(rest * 2 / (root + w0))
            pieces.append((used + piece, F.least(at + t0, F.lit(float(t1)))))
        used += piece
    for end, at in reversed(pieces):
        result = F.when(share * total < end, at).otherwise(result)
    return result


def source_targets(sources: DataFrame, curves: Sequence[Curve], max_repeats: float) -> DataFrame:
    """``sources`` (source, source_size) with ``rank``, ``curve`` and ``target``.

    Curves are dealt in order of source, repeating. What goes beyond
    ``max_repeats`` times a source's size is shared again by weight until no
    source is above; each step moves two sums to the driver and settles at
    least one source.
    """
    weights = F.array(*[F.lit(float(area(c))) for c in curves])
    table = ranked(sources, F.col("source").asc_nulls_last()).withColumn(
        "curve", (F.col("rank") % len(curves)).cast("int")
    )
    table = table.withColumn("_w", F.get(weights, F.col("curve"))).withColumn(
        "_cap", F.col("source_size") * float(max_repeats)
    )
    left = table.agg(F.sum("source_size")).first()[0] or 0
    level, settled = 0.0, 0
    while True:
        # a source is full once level * weight reaches its cap
        full = F.col("_w") * F.lit(level) >= F.col("_cap")
        sums = table.agg(
            F.count_if(full).alias("n"),
            F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("caps"),
            F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("weights"),
        ).first()
        if (level > 0 and sums["n"] == settled) or not sums["weights"]:
            break
        settled = sums["n"]
        level = max(level, (left - sums["caps"]) / sums["weights"])
        if level <= 0:
            break
    return table.withColumn("target", F.least(F.col("_w") * F.lit(float(level)), F.col("_cap"))).drop("_w", "_cap")


def mix(
    docs: DataFrame,
    curves: Sequence[Curve] = CURVES,
    max_repeats: int = MAX_REPEATS,
    seed: int = 7,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document, in the order of training.

    ``size`` words of the text, ``source_size`` and ``target`` of its source,
    ``taken`` words the mix takes (a document may be read up to ``max_repeats``
    times; the one at the end of the demand is cut), ``positions`` the training
    times (0..1) of its readings and ``position`` the first of them (null if
    not taken). ``keep`` names further columns of ``docs`` to carry along.
    """
    parts = 4 * shuffle_partitions(docs.sparkSession)
    extra = [F.col(c).alias(f"_keep_{c}") for c in keep]
    sized = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        # rows without an id are many, maybe: their texts spread them
        F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.xxhash64("text"))).alias("_h"),
        *extra,
    )
    narrow = cut(sized) if not keep else sized
    narrow = narrow.withColumn("_bucket", F.pmod(F.col("_h"), F.lit(parts)).cast("int"))
    totals = cut(narrow.groupBy("source", "_bucket").agg(F.sum("size").alias("_n")))
    sources = totals.groupBy("source").agg(F.sum("_n").alias("source_size"))
    sources = cut(source_targets(sources, curves, max_repeats))
    sized_sources = sources.select(F.col("source").alias("_s"), "source_size", "curve", "target")
    before = totals.withColumn(
        "_before", F.sum("_n").over(W.partitionBy("source").orderBy("_bucket")) - F.col("_n")
    ).select(F.col("source").alias("_bs"), F.col("_bucket").alias("_bb"), "_before")
    before = before.join(sized_sources, F.col("_bs").eqNullSafe(F.col("_s"))).drop("_s")

    inside = W.partitionBy("source", "_bucket").orderBy("_h", "doc_id", "size")
    placed = narrow.withColumn(
        "_start", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    ).join(before, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("_bucket") == F.col("_bb")))
    start = F.col("_start") + F.col("_before")
    demand = F.floor(F.col("target") + 1e-6).cast("long")
    passes = [start + F.col("source_size") * e for e in range(max_repeats)]
    takes = [F.least(F.greatest(demand - at, F.lit(0)), F.col("size")) for at in passes]
    at_time = []
    for at, take in zip(passes, takes):
        share = at / F.col("target")
        time = F.lit(None).cast("double")
        for n, curve in enumerate(curves):
            time = F.when(F.col("curve") == n, position_of(share, curve)).otherwise(time)
        at_time.append(F.when(take > 0, time))
    taken = takes[0]
    for take in takes[1:]:
        taken = taken + take
    times = F.array_compact(F.array(*at_time))
    out = placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        F.get(times, F.lit(0)).alias("position"),
        times.alias("positions"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")
