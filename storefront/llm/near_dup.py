"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Each document becomes its set of hashed five-word shingles, ``PERMS`` minima of
   it, ``BANDS`` band keys over the full minima, and a packed signature of the low
   ``B`` bits of each minimum. Documents with equal sets are one class from there
   on, so copies cost nothing.
2. Classes that share a band key are candidates. A bucket is not expanded into
   pairs: its members are first held against one of them by bit counts of the packed
   signatures, corrected for chance collisions. Those alike, with room for the error
   of the estimate, are connected by it. In buckets that have others too, all members
   are compared so. What is connected is a cluster.
3. Within a cluster all full sets are compared.

Both comparisons are dealt into blocks of bounded size: a task holds two blocks of
one bucket or cluster, and sends on one row per member at most, for whom it is
connected to. So neither rows nor a task grow with the square of a group.

A pair at the threshold shares no band with probability (1 - 0.75^4)^32 < 1e-5.

Defined cases: null, empty or blank texts have an empty set and are linked with
nothing; texts of fewer words than a shingle count as one shingle; rows with equal
``doc_id`` are rows of their own; a null ``doc_id`` is a component's id only if all
are null; an empty table gives no rows; extra columns are not read. ``keep_one`` keeps
one row of a component whatever ids and repeats it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storefront.llm.common import stored, text_bytes
from storefront.llm.hashing import mixed

SHINGLE = 5
THRESHOLD = 75  # in hundredths
PERMS = 128
ROWS = 4
BANDS = PERMS // ROWS
B = 2
#: Estimates so much below the threshold still go on to the full sets: over five standard deviations.
SLACK = 0.25
BLOCK = 4096
#: A task compares two blocks of about so many sets and shingles, or signatures.
BLOCK_SETS, BLOCK_SHINGLES, BLOCK_SIGS = 512, 1 << 20, 1024
COLUMNS = 4096
SEEDS = np.random.default_rng(3).integers(0, 1 << 63, PERMS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = np.random.default_rng(4).integers(0, 1 << 63, PERMS, np.uint64)
GOLD = np.uint64(0x9E3779B97F4A7C15)
LOST = -(1 << 63)  # stands for a null id in joins


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - SHINGLE + 1
    total = hashes[:count]
    for i in range(1, SHINGLE):
        total = mixed(total * GOLD + hashes[i : i + count])
    total = np.sort(total)
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    least = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), BLOCK):
        part = shingles[None, start : start + BLOCK] * SEEDS[:, None]
        least = np.minimum(least, (part + SHIFTS[:, None]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    total = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        total = mixed(total * GOLD + column)
    return total.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low ``B`` bits of each minimum, in 64-bit words."""
    low = mixed(least) & np.uint64((1 << B) - 1)
    lanes = low.reshape(-1, 64 // B) << (np.arange(64 // B, dtype=np.uint64) * np.uint64(B))
    return np.bitwise_or.reduce(lanes, axis=1).view(np.int64)


def estimate(left: Column, right: Column) -> Column:
    """Similarity by equal lanes of two packed signatures, less what chance makes equal."""
    words = PERMS * B // 64
    lane = int("01" * (64 // B), 2)  # the low bit of each lane, for B = 2
    differ = F.lit(0)
    for n in range(words):
        x = F.get(left, F.lit(n)).bitwiseXOR(F.get(right, F.lit(n)))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(lane))
        differ = differ + F.bit_count(any_bit)
    chance = 2.0**-B
    return ((F.lit(1.0) - differ / PERMS) - chance) / (1 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, n_shingles, digest, bands, sig``; an empty set has a null digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, bands, sigs = [], [], [], []
            for text in text_bytes(batch.column("text")):
                shingles = shingle_set(text)
                counts.append(len(shingles))
                if len(shingles):
                    least = minima(shingles)
                    digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    bands.append(band_keys(least))
                    sigs.append(packed(least))
                else:
                    digests.append(None)
                    bands.append([])
                    sigs.append([])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("row_key"),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sigs, pa.list_(pa.int64())),
                ],
                ["doc_id", "row_key", "n_shingles", "digest", "bands", "sig"],
            )

    return docs.select(_id(F.col("doc_id")), row_key(F.col("text")).alias("row_key"), "text").mapInArrow(
        work, "doc_id long, row_key long, n_shingles long, digest binary, bands array<long>, sig array<long>"
    )


def _id(doc_id: Column) -> Column:
    return doc_id.cast("long").alias("doc_id")


def row_key(text: Column) -> Column:
    return F.xxhash64(text)


def _known_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LOST))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``vid, shingles`` of the classes in ``wanted`` (vid, row: id and text hash of one of its documents, digest)."""
    ids = wanted.select("vid", F.col("row._id").alias("_id"), F.col("row.row_key").alias("_key"), F.col("digest").alias("_digest"))
    texts = docs.select(_known_id(F.col("doc_id")).alias("_id"), row_key(F.col("text")).alias("_key"), "text")
    texts = texts.join(ids.hint("merge"), ["_id", "_key"])  # the ids grow with the corpus: the same plan at every size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (vid, shingles.view(np.int64))
                for vid, digest, text in zip(
                    batch.column("vid").to_pylist(), batch.column("_digest").to_pylist(), text_bytes(batch.column("text"))
                )
                # another text may share the hash
                if xxhash.xxh3_128_digest((shingles := shingle_set(text)).tobytes()) == digest
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                ["vid", "shingles"],
            )

    sets = texts.select("vid", "_digest", "text").mapInArrow(work, "vid long, shingles array<long>")
    return sets.groupBy("vid").agg(F.first("shingles").alias("shingles"))


def components(links: DataFrame) -> DataFrame:
    """``vid, comp``: the least vid reachable, for all vids with links.

    In each round every vid hooks to its least neighbour, hooks are followed to
    their roots, and links are drawn between roots. Each round leaves half of the
    vids that still have links at most, and a star is done after one.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = stored(ends.groupBy(F.col("a").alias("vid")).agg(F.min(F.least("a", "b")).alias("comp")))
        while True:
            up = roots.select(F.col("vid").alias("_v"), F.col("comp").alias("_up"))
            jumped = stored(
                roots.join(up, F.col("comp") == F.col("_v")).select("vid", F.col("_up").alias("comp"), (F.col("_up") != F.col("comp")).alias("_moved"))
            )
            roots = jumped.drop("_moved")
            if jumped.where("_moved").isEmpty():
                break
        labels = roots if labels is None else stored(relabelled(labels, roots))
        left = roots.select(F.col("vid").alias("a"), F.col("comp").alias("_a"))
        right = roots.select(F.col("vid").alias("b"), F.col("comp").alias("_b"))
        drawn = edges.join(left, "a").join(right, "b").where("_a != _b")
        edges = stored(drawn.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    return labels


def relabelled(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """``labels`` (vid, comp) with each comp replaced by what ``roots`` (vid, comp) has for it."""
    to = roots.select(F.col("vid").alias("_v"), F.col("comp").alias("_to"))
    return labels.join(to, F.col("comp") == F.col("_v"), "left").select("vid", F.coalesce("_to", "comp").alias("comp"))


def classes_of(signed: DataFrame) -> DataFrame:
    """``vid, doc_id, row, digest, n_shingles, bands, sig``: one row per distinct set that is not empty."""
    groups = signed.where("digest IS NOT NULL").groupBy("digest")
    row = F.struct(_known_id(F.col("doc_id")).alias("_id"), "row_key")
    return stored(
        groups.agg(F.min("doc_id").alias("doc_id"), F.min(row).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        .withColumn("vid", F.monotonically_increasing_id())
    )


def clusters(classes: DataFrame) -> DataFrame | None:
    """``vid, comp`` of all classes that are alike by estimate to one that shares a band; None if none is."""
    placed = classes.select("vid", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("vid").alias("pivot")).where("n > 1")
    sigs = classes.select("vid", "sig")
    members = placed.join(shared, "key").where("vid != pivot").join(sigs, "vid")
    pivots = sigs.select(F.col("vid").alias("pivot"), F.col("sig").alias("_p"))
    close = estimate(F.col("sig"), F.col("_p")) >= THRESHOLD / 100 - SLACK
    members = stored(members.join(pivots, "pivot").withColumn("close", close).drop("_p"))
    links = members.where("close").select(F.col("vid").alias("a"), F.col("pivot").alias("b"))
    # who is close to the pivot is connected by it; who is not meets all others of the bucket
    several = members.where("NOT close").select("key").distinct()
    rest = members.join(several, "key").select(
        "key",
        F.when(F.col("close"), F.col("pivot")).otherwise(F.col("vid")).alias("label"),
        F.ceil((F.col("n") - 1) / BLOCK_SIGS).cast("int").alias("blocks"),
        F.col("sig").alias("value"),
        "vid",
    )
    rest = rest.withColumn("block", block_of("vid", "blocks")).drop("vid")
    links = stored(links.unionByName(compared(rest, alike)).distinct())
    return None if links.isEmpty() else components(links)


def block_of(vid: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(vid), F.col(blocks)).cast("int")


def alike(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Which packed signatures of ``left`` are alike by estimate to which of ``right`` (of ``left`` if None)."""
    one = np.array(left, np.int64).view(np.uint64)
    two = one if right is None else np.array(right, np.int64).view(np.uint64)
    lane = np.uint64(int("01" * (64 // B), 2))
    differ = np.zeros((len(one), len(two)), np.int16)
    for word in range(one.shape[1]):
        x = one[:, word, None] ^ two[None, :, word]
        differ += np.bitwise_count((x | (x >> np.uint64(1))) & lane)
    chance = 2.0**-B
    return ((1.0 - differ / PERMS) - chance) / (1 - chance) >= THRESHOLD / 100 - SLACK


def compared(rows: DataFrame, near: Callable[..., np.ndarray]) -> DataFrame:
    """Pairs ``a, b`` of labels of one ``key`` that are connected where ``near`` tells for the ``value`` of each two.

    ``rows`` has key, label, block (of ``blocks``) and value. Every two blocks of a key meet once.
    """
    pairs_of_blocks = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "label", "value"
    )

    def compare(key: tuple[int, int, int], members: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        _, low, high = key
        left = [m for m in members if m[0] == low]
        right = [m for m in members if m[0] != low]
        labels = [m[1] for m in (*left, *right)]
        if low == high:
            table = near([m[2] for m in left])
        elif left and right:
            table = np.zeros((len(labels), len(labels)), bool)
            table[: len(left), len(left) :] = near([m[2] for m in left], [m[2] for m in right])
            table |= table.T
        else:
            return []
        found = {(labels[i], labels[r]) for i, r in enumerate(forest(table).tolist())}
        return [(a, b) for a, b in found if a != b]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by pair of blocks; one is held at a time
        current, members, pairs = None, [], []

        def found(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            sides = list(zip(*pairs)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in sides], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in ("key", "low", "high"))))
            block, label = batch.column("block").to_pylist(), batch.column("label").to_pylist()
            for n, key in enumerate(keys):
                if key != current:
                    if len(members) > 1:
                        pairs += compare(current, members)
                    current, members = key, []
                members.append((block[n], label[n], batch.column("value")[n].values.to_numpy().copy()))
            if len(pairs) > 10_000:
                yield found(pairs)
                pairs = []
        if len(members) > 1:
            pairs += compare(current, members)
        yield found(pairs)

    parts = pairs_of_blocks.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return parts.mapInArrow(work, "a long, b long").distinct()


def linked(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Which sets of ``left`` reach the threshold with which of ``right`` (of ``left`` if None)."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1  # a shingle of one set adds to no pair
    column, owner = (np.cumsum(often) - 1)[column[often[column]]], owner[often[column]]
    split = len(left)
    both = np.zeros((split, len(right) if right else split), np.float32)
    # columns are in order, so a slice of the entries is a slice of the columns
    width = COLUMNS
    edges = np.searchsorted(column, np.arange(0, int(column[-1]) + width + 1 if len(column) else 1, width))
    for n, (start, end) in enumerate(zip(edges, edges[1:])):
        table = np.zeros((len(sets), width), np.float32)
        table[owner[start:end], column[start:end] - n * width] = 1
        both += table[:split] @ (table[split:] if right else table).T
    either = sizes[:split, None] + (sizes[split:] if right else sizes)[None, :] - both
    return 100 * both >= THRESHOLD * either


def forest(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric table of links, the first row it is connected to."""
    root = np.full(len(near), -1)
    for start in range(len(near)):
        if root[start] < 0:
            reached = np.zeros(len(near), bool)
            reached[start] = True
            fresh = np.array([start])
            while len(fresh):
                found = near[fresh].any(axis=0) & ~reached
                reached |= found
                fresh = np.flatnonzero(found)
            root[reached] = start
    return root


def confirmed(docs: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of classes connected by links that their full sets confirm."""
    sized = classes.join(labels, "vid").select("vid", "comp", "row", "digest", "n_shingles")
    totals = sized.groupBy("comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = sized.join(totals.select("comp", blocks.alias("blocks")), "comp").select(
        "vid", F.col("comp").alias("key"), "row", "digest", "blocks", block_of("vid", "blocks").alias("block")
    )
    dealt = stored(dealt)
    sets = full_sets(docs, dealt.select("vid", "row", "digest")).withColumnRenamed("shingles", "value")
    return compared(dealt.select("vid", "key", "block", "blocks").join(sets, "vid").withColumnRenamed("vid", "label"), linked)


def class_components(docs: DataFrame, classes: DataFrame) -> DataFrame | None:
    """``vid, comp`` of all classes with confirmed links; None if there are none."""
    labels = clusters(classes)
    if labels is None:
        return None
    links = stored(confirmed(docs, classes, labels))
    return None if links.isEmpty() else components(links)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, n_shingles, component_id, kept, component`` of each row of ``docs``.

    ``component_id`` is the least ``doc_id`` that can be reached over links. ``component``
    is a number of the component, null for a text that is linked with nothing.
    """
    signed = stored(signatures(docs))
    classes = classes_of(signed)
    labels = class_components(docs, classes)
    known = classes.select("vid", "digest", F.col("doc_id").alias("_least"))
    if labels is None:
        owned = known.select("digest", F.col("_least").alias("component_id"), F.col("vid").alias("component"))
    else:
        known = stored(known.join(labels, "vid", "left").withColumn("comp", F.coalesce("comp", "vid")))
        least = known.groupBy("comp").agg(F.min("_least").alias("component_id"))
        owned = known.join(least, "comp").select("digest", "component_id", F.col("comp").alias("component"))
    rows = signed.select("doc_id", "row_key", "n_shingles", "digest").join(owned, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select(
        "doc_id",
        "row_key",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "component",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that with the least id, then the least text hash.

    Rows of one id and text count as one wherever they are, texts without words included.
    Repeats are cut within each task first, so a row that comes very often is not gathered.
    """
    rows = stored(near_duplicates(docs).select(_known_id(F.col("doc_id")).alias("_id"), "row_key", "kept", "component"))
    first = rows.where("kept AND component IS NOT NULL").groupBy("component")
    chosen = first.agg(F.min(F.struct("_id", "row_key")).alias("row")).select("row.*")
    chosen = stored(chosen.unionByName(rows.where("component IS NULL").select("_id", "row_key").distinct()))
    keys = ["_id", "row_key"]
    plain = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    same = Window.partitionBy(*(f"_row.{k}" for k in keys)).orderBy("_row.order")
    key = F.struct(_known_id(F.col("doc_id")).alias("_id"), row_key(F.col("text")).alias("row_key"), F.xxhash64(*plain).alias("order"))
    single = docs.select(key.alias("_row"), F.struct(*docs.columns).alias("_doc"))
    single = single.withColumn("_nth", F.row_number().over(same)).where("_nth = 1")
    met = (single["_row._id"] == chosen["_id"]) & (single["_row.row_key"] == chosen["row_key"])
    return single.join(chosen.hint("merge"), met, "left_semi").select("_doc.*")
