"""Importance resampling of documents towards labelled good text.

Generative models over hashed n-grams, for the target (labelled good documents) and
for raw text (all documents), of two families: byte n-grams with one symbol for a
word that follows itself, and the beginnings of words. The log ratio of the two
models, shrunk where both know little, is the evidence of an n-gram. A document's
statistic in a family is the sum of its clear evidence against the target (n-grams
``strong`` e-folds rarer there than in raw text) over the root of its length, so
that a few bad words in a long text and junk throughout a short one both show.
Each family is scaled by a bound set on labelled documents that were not used to
fit, one that loses few good ones; the worse family counts.

How many documents are taken, ``k``, is how many pass the bound; which ones is
drawn by Gumbel top-k: log weight plus Gumbel noise, the ``k`` largest. The noise
comes from a hash of ``doc_id``, so reruns agree.

Bounded on purpose: the labelled sample, ``max_labels`` rows in hash order. Counts,
scores and the selection cover all documents.

Defined cases: a null or empty text has weight as if without evidence (statistic
0) and is kept; no labels of one kind: nothing can be told, all are kept; labels
with a null id or quality are not used, of several labels for one document the
worst holds; equal keys at the bound are all kept; repeated rows score alike.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storefront.llm.common import chunks, cut, text_bytes

GRAM = 4
BEGIN = 5  # bytes of a word's beginning
BITS = 18
#: First number of each family, and the end; the last number of the first is 'a word again'.
FAMILIES = (0, (1 << BITS) + 1, (2 << BITS) + 1)
STRONG = (1.0, 1.5)
PIECES = 512
STEP = -(-FAMILIES[-1] // PIECES)
MAX_LABELS = 40_000
#: Share of good documents that a bound may cost.
MAX_LOSS = 0.004
#: Divides the log weight: small against the gap between good and bad documents.
TEMPERATURE = 0.002
BINS = 1024
SEED = 11


@dataclass(frozen=True)
class Model:
    """Clear evidence per n-gram, and each family's bound (below zero)."""

    evidence: np.ndarray
    bounds: tuple[float, float] = (-1.0, -1.0)


def gram_ids(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family, the numbers of all n-grams of all texts, and the text each belongs to."""
    gap = b"\n" * BEGIN
    joined = gap.join(texts) + gap + bytes(8)
    data = np.frombuffer(joined, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + BEGIN)
    ends = np.cumsum(lengths + BEGIN) - BEGIN
    count = len(owner)
    code = np.ndarray((count,), "<u4", joined, 0, (1,)) * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    inside = np.flatnonzero(np.arange(GRAM, count + GRAM) <= ends[owner])
    ids = (code[inside] >> np.uint32(32 - BITS)).astype(np.int64)
    again = np.fromiter(
        (sum(map(operator.eq, words, words[1:])) for words in map(bytes.split, texts)), np.int64, len(texts)
    )
    first = (
        np.concatenate([ids, np.full(int(again.sum()), 1 << BITS)]),
        np.concatenate([owner[inside], np.repeat(np.arange(len(texts), dtype=np.int32), again)]),
    )
    blank = (data[:count] == 32) | ((data[:count] >= 9) & (data[:count] <= 13))
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])[:count])
    word = np.ndarray((count,), "<u8", joined.lower(), 0, (1,))[starts] & np.uint64((1 << (8 * BEGIN)) - 1)
    word = word * np.uint64(0x9E3779B97F4A7C15)
    word ^= word >> np.uint64(29)
    word *= np.uint64(0xBF58476D1CE4E5B9)
    second = ((word >> np.uint64(64 - BITS)).astype(np.int64) + FAMILIES[1], owner[starts])
    return [first, second]


def statistics(texts: list[bytes], evidence: np.ndarray) -> np.ndarray:
    """For each family and text, clear evidence over the root of the number of n-grams; 0 without n-grams."""
    out = np.zeros((len(FAMILIES) - 1, len(texts)))
    for start, end in chunks(texts):
        for row, (ids, owner) in zip(out, gram_ids(texts[start:end])):
            total = np.bincount(owner, weights=evidence[ids], minlength=end - start)
            row[start:end] = total / np.sqrt(np.maximum(np.bincount(owner, minlength=end - start), 1))
    return out


def labelled_sample(labels: DataFrame, max_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and whether they are good, of at most ``max_labels`` documents in hash order."""
    good = (F.col("quality") > 0) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    rows = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min(good.cast("int")).alias("good"))
        .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id")
        .limit(max_labels)
        .toPandas()
        .sort_values("doc_id")
    )
    return rows["doc_id"].to_numpy(np.int64), rows["good"].to_numpy(np.int64) > 0


def fits(ids: np.ndarray) -> np.ndarray:
    """Which labelled documents fit the target model (three of four); the others set the bounds."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)) % np.uint64(4) != 0


def gram_counts(docs: DataFrame, ids: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of n-grams over all documents, and over the labelled good ones that fit the model.

    Each task sends its counts once, in ``PIECES`` pieces that are summed apart, as a
    stream; the driver gets one vector of fixed length.
    """
    target_ids = ids[good & fits(ids)]

    def count(batches):
        sums = np.zeros((2, PIECES * STEP), np.int64)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            numbers = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(target_ids, numbers), max(0, len(target_ids) - 1))
            chosen = known & (target_ids[at] == numbers) if len(target_ids) else np.zeros(len(texts), bool)
            for start, end in chunks(texts):
                wanted = chosen[start:end]
                for found, owner in gram_ids(texts[start:end]):
                    sums[0] += np.bincount(found, minlength=PIECES * STEP)
                    if wanted.any():
                        sums[1] += np.bincount(found[wanted[owner]], minlength=PIECES * STEP)
        sides = [pa.array([p.tobytes() for p in side], pa.binary()) for side in sums.reshape(2, PIECES, STEP)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), *sides], ["piece", "raw", "target"])

    def merge(batches):
        # rows come sorted by piece; the sums of one piece are held at a time
        current, sums = None, np.zeros((2, STEP), np.int64)

        def done() -> pa.RecordBatch:
            sides = [pa.array([side.tobytes()], pa.binary()) for side in sums]
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), *sides], ["piece", "raw", "target"])

        for batch in batches:
            for n, piece in enumerate(batch.column("piece").to_pylist()):
                if piece != current:
                    if current is not None:
                        yield done()
                    current, sums = piece, np.zeros((2, STEP), np.int64)
                for side, name in zip(sums, ("raw", "target")):
                    side += np.frombuffer(batch.column(name)[n].as_buffer(), np.int64)
        if current is not None:
            yield done()

    schema = "piece int, raw binary, target binary"
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, schema)
    together = parts.repartition(F.col("piece")).sortWithinPartitions("piece")
    out = np.zeros((2, PIECES, STEP), np.int64)
    for row in together.mapInArrow(merge, schema).collect():
        out[0, row["piece"]] = np.frombuffer(row["raw"], np.int64)
        out[1, row["piece"]] = np.frombuffer(row["target"], np.int64)
    raw, target = out.reshape(2, -1)[:, : FAMILIES[-1]]
    return raw, target


def clear_evidence(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability, with one count of doubt on either side, where clearly below 0."""
    out = np.zeros(FAMILIES[-1], np.float32)
    for start, end, strong in zip(FAMILIES, FAMILIES[1:], STRONG):
        own, all_ = target[start:end], raw[start:end]
        ratio = np.log((own + 1.0) / (all_ * (own.sum() / max(1, all_.sum())) + 1.0))
        out[start:end] = np.where(ratio < -strong, ratio, 0.0)
    return out


def bound_of(good: np.ndarray, bad: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """The value that parts good from bad best and has at most ``max_loss`` of the good below.

    Halfway between the two nearest values; below zero.
    """
    if not len(good) or not len(bad):
        return -np.inf
    values = np.concatenate([good, bad])
    order = np.argsort(values, kind="stable")
    is_good = np.concatenate([np.ones(len(good)), np.zeros(len(bad))])[order]
    values = np.append(values[order], 0.0)
    # a cut before position i has the values before it below
    bad_below = np.concatenate([[0], np.cumsum(1 - is_good)]) / len(bad)
    good_below = np.concatenate([[0], np.cumsum(is_good)]) / len(good)
    gain = np.where(good_below <= max_loss, bad_below - good_below, -1.0)
    gain[1:][values[1:] == values[:-1]] = -1.0  # equal values stay together
    at = int(np.argmax(gain))
    return -np.inf if at == 0 else min(float((values[at - 1] + values[at]) / 2), -1e-9)


def statistic(text: Column, evidence: np.ndarray) -> Column:
    """A struct of the two families' statistics; ``evidence`` has a fixed size of two MB."""
    kind = T.StructType([T.StructField(name, T.DoubleType()) for name in ("grams", "words")])

    @F.arrow_udf(kind)
    def score(texts: pa.Array) -> pa.Array:
        rows = statistics(text_bytes(texts), evidence)
        return pa.StructArray.from_arrays([pa.array(r, pa.float64()) for r in rows], names=kind.names)

    return score(text)


def log_weight(stat: Column, bounds: tuple[float, float], temperature: float) -> Column:
    """Above 0 if both families pass; the worse one counts."""
    scaled = [stat[name] / F.lit(-b) if np.isfinite(b) else F.lit(0.0) for name, b in zip(("grams", "words"), bounds)]
    return (F.least(*scaled) + 1.0) / F.lit(temperature)


def noise(doc_id: Column) -> Column:
    """Gumbel noise from a hash."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 1), doc_id), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The ``k``-th largest value, by counts over ever finer bins: no sort, no collection."""
    if k <= 0:
        return np.inf
    low, high, above = *rows.agg(F.min(column), F.max(column)).first(), 0
    if low is None or low == high:
        return -np.inf if low is None else low
    while True:
        width = (high - low) / BINS
        inside = rows.where((F.col(column) >= low) & (F.col(column) <= high))
        if width <= 0 or low + width == low:
            return low
        bin_of = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        bins = inside.groupBy(bin_of.alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                break
            above += row["n"]
        if row["low"] == row["high"] or above + 1 == k:
            return row["low"] if row["low"] == row["high"] else row["high"]
        if above + row["n"] == k:
            return row["low"]
        if (row["low"], row["high"]) == (low, high):
            return low
        low, high = row["low"], row["high"]


@dataclass(frozen=True)
class Selection:
    model: Model
    scores: DataFrame
    least_key: float


def select(
    docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, temperature: float = TEMPERATURE
) -> Selection:
    """Scores of all documents (``doc_id, grams, words, log_weight, key``) and the least key that is taken."""
    ids, good = labelled_sample(labels, max_labels)
    evidence = clear_evidence(*gram_counts(docs, ids, good))
    stat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistic(F.col("text"), evidence).alias("_s"))
    scores = cut(stat.select("doc_id", "_s.grams", "_s.words"))
    held = scores.sparkSession.createDataFrame(
        [(int(i), bool(g)) for i, g in zip(ids[~fits(ids)], good[~fits(ids)])], "doc_id long, good boolean"
    )
    known = scores.join(F.broadcast(held), "doc_id").groupBy("doc_id", "good").agg(F.min("grams"), F.min("words"))
    known = known.toPandas().to_numpy()
    is_good = known[:, 1].astype(bool)
    model = Model(evidence, tuple(bound_of(*(known[side, n].astype(float) for side in (is_good, ~is_good))) for n in (2, 3)))
    weight = log_weight(F.struct("grams", "words"), model.bounds, temperature)
    scores = scores.withColumn("log_weight", weight).withColumn("key", F.col("log_weight") + noise(F.col("doc_id")))
    k = scores.where(F.col("log_weight") >= 0).count()
    return Selection(model, scores, kth_largest(scores, "key", k))


def resample(
    docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, temperature: float = TEMPERATURE
) -> DataFrame:
    """``doc_id, grams, words, log_weight, key, accepted`` of each document."""
    chosen = select(docs, labels, max_labels, temperature)
    return chosen.scores.withColumn("accepted", F.col("key") >= F.lit(float(chosen.least_key)))


def keep_good(
    docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, temperature: float = TEMPERATURE
) -> DataFrame:
    """The accepted rows of ``docs``, as they are; texts are scored again rather than shuffled."""
    chosen = select(docs, labels, max_labels, temperature)
    weight = log_weight(statistic(F.col("text"), chosen.model.evidence), chosen.model.bounds, temperature)
    return docs.where(weight + noise(F.col("doc_id").cast("long")) >= F.lit(float(chosen.least_key)))
