"""Prefix trie of conversations, peeled from its deepest level.

A turn sequence is known by a 128-bit key that each further turn changes, so a prefix
of any length is one narrow row and no text is shuffled. Every prefix is a node. The
trie is peeled: at a depth, conversations that end there meet the nodes that survive
from one level deeper; rows of one key are merged by aggregation; then the last turn is
stripped, which leaves the parent's key with what the subtree adds up to, for the level
above. A part of a conversation that no other shares holds nothing to merge and is
peeled in one step, so the number of levels is that of the deepest shared prefix.

All grouping is by Spark aggregation, which combines on the map side: a first turn that
a third of all conversations share is one row per task. Places in a conversation and
prefix keys come from sorted ranges (``running``), so one conversation may be of any
length; the hash over the members that end at a node is streamed from sorted pieces.

Defined cases: a null role or text counts as empty; turns are in order of ``turn``, null
first, equal ones by role, then by a hash of the text; rows without a conversation id
belong to none and are left out; a row twice is two turns; an empty table gives no
rows, not even a root; extra columns are not read. Equal keys are taken for equal
sequences (two 64-bit hashes).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storefront.llm.common import shared_folder, stored
from storefront.llm.running import SUM, XOR, in_ranges, running

#: Ids of one node are handed on in texts of about so many characters.
PIECE = 1 << 16
KEY = ["depth", "k1", "k2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()
FORKS, SHARED_TURNS = 5, 9


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, h1, h2, bytes``: a turn by its hashes and the bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("h1"),
        F.xxhash64(F.lit(2), text, role).alias("h2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, place, h1, h2, bytes``: the turns of ``digests`` with their place (from 1)."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")]
    ranges = in_ranges(turns.withColumn("place", F.lit(1).cast("long")), "conv_id", *order)
    return running(ranges, "conv_id", ["place"], SUM).select("conv_id", "place", "h1", "h2", "bytes")


def forked(turns: DataFrame) -> DataFrame:
    """Conversations rebuilt as forks: the first turns come from the first id of each five.

    ``turns`` as ``numbered`` makes them; so is the result, with the places the turns had.
    At most eight turns of a conversation are handed on, to at most five.
    """

    def head(c: Column) -> Column:
        return F.crc32(c.cast("string")) % SHARED_TURNS

    conv = F.col("conv_id")
    ids = turns.where("place = 1").select((conv - conv % FORKS).alias("_base"), conv.alias("_fork"))
    heads = turns.where((conv % FORKS == 0) & (F.col("place") < SHARED_TURNS)).withColumnRenamed("conv_id", "_base")
    heads = heads.join(ids, "_base").where(F.col("place") <= head(F.col("_fork")))
    own = turns.where(F.col("place") > head(conv))
    return own.unionByName(heads.withColumnRenamed("_fork", "conv_id").drop("_base"))


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, bytes``: the key of each prefix and of the one a turn shorter."""
    rows = turns.withColumn("depth", F.lit(1).cast("long"))
    ranges = in_ranges(rows, "conv_id", F.col("place"), F.col("h1"), F.col("h2"))
    deep = running(ranges, "conv_id", ["depth"], SUM)
    # a turn counts by its depth too, so the order of turns changes the key
    mixed = deep.withColumns({h: F.xxhash64("depth", h) for h in ("h1", "h2")}).withColumns({"k1": F.col("h1"), "k2": F.col("h2")})
    keyed = running(mixed, "conv_id", ["k1", "k2"], XOR)
    before = [F.col(k).bitwiseXOR(F.col(h)).alias(p) for k, h, p in (("k1", "h1", "p1"), ("k2", "h2", "p2"))]
    return keyed.select("conv_id", *KEY, *before, "bytes")


def id_hashes(members: DataFrame) -> DataFrame:
    """``depth, k1, k2, n_ends, ends_sha256`` of ``members`` (conv_id, depth, k1, k2).

    Ids are sorted by ranges, which may cut a node of many; each range joins its ids to
    texts of bounded length, and the texts of a node go through one running hash.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "start", "n", "ids"]
        key, ids, size, rows = None, [], 0, []

        def flush() -> None:
            if ids:
                rows.append((*key, int(ids[0]), len(ids), ",".join(ids)))
                ids.clear()

        def taken() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            kinds = [pa.int64()] * 5 + [pa.string()]
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
            rows.clear()
            return done

        for batch in batches:
            for conv, *now in zip(*(batch.column(n).to_pylist() for n in ("conv_id", *KEY))):
                if now != key or size > PIECE:
                    flush()
                    key, size = now, 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if rows:
                yield taken()
        flush()
        yield taken()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "n_ends", "ends_sha256"]
        key, state, n = None, None, 0
        for batch in batches:
            rows = []
            for *now, more, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "n", "ids"))):
                if now != key:
                    if key is not None:
                        rows.append((*key, n, state.hexdigest()))
                    key, state, n = now, hashlib.sha256(ids.encode()), more
                else:
                    state.update(b"," + ids.encode())
                    n += more
            yield batch_of(rows, names)
        if key is not None:
            yield batch_of([(*key, n, state.hexdigest())], names)

    def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    by = [*KEY, "conv_id"]
    sliced = members.select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    sliced = sliced.mapInArrow(pieces, "depth long, k1 long, k2 long, start long, n long, ids string")
    together = sliced.repartition(*KEY).sortWithinPartitions(*KEY, "start")
    return together.mapInArrow(hashed, "depth long, k1 long, k2 long, n_ends long, ends_sha256 string")


def _stripped(nodes: DataFrame) -> DataFrame:
    """What nodes leave to their parents: a child each, and what their subtrees add up to."""
    return nodes.select(
        F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens"
    )


def peeled(nodes: DataFrame) -> DataFrame:
    """``nodes`` (depth, k1, k2, p1, p2, bytes, conv_id, n_convs, n_ends) with what their subtrees hold.

    ``n_children``, ``n_leaves`` and ``saved_tokens`` follow, one job and one small table a level.
    """
    spark, folder = nodes.sparkSession, f"{shared_folder(nodes.sparkSession)}/table-{uuid.uuid4()}"
    deepest = nodes.where("n_convs > 1").agg(F.max("depth")).first()[0] or 0
    alone = nodes.where(F.col("depth") > deepest).withColumns(
        {
            "n_children": 1 - F.col("n_ends"),
            "n_leaves": F.lit(1).cast("long"),
            "saved_tokens": F.lit(0).cast("long"),
        }
    )
    schema, paths = alone.schema, [f"{folder}/alone"]
    alone.write.parquet(paths[0])

    def level(path: str) -> DataFrame:
        return spark.read.schema(schema).parquet(path)

    zero = F.lit(0).cast("long")
    below = level(paths[0]).where(F.col("depth") == deepest + 1)
    for depth in range(deepest, 0, -1):
        ended = nodes.where(F.col("depth") == depth).withColumns({"n_children": zero, "n_leaves": zero, "saved_tokens": zero})
        merged = ended.unionByName(_stripped(below), allowMissingColumns=True).groupBy("k1", "k2")
        known = [F.max(c).alias(c) for c in ("depth", "p1", "p2", "bytes", "conv_id", "n_convs", "n_ends")]
        sums = [F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
        done = merged.agg(*known, *sums).withColumns(
            {
                "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")),
                "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes"),
            }
        )
        paths.append(f"{folder}/{depth}")
        done.select(*schema.names).write.parquet(paths[-1])
        below = level(paths[-1])
    return spark.read.schema(schema).parquet(*paths)


def trie_of(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of conversations ``ids`` (conv_id, each once) whose turns ``numbered`` or ``forked`` made.

    ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_ends``,
    ``n_children``, ``n_leaves``, ``bytes`` of the last turn's text, ``saved_tokens``,
    ``ends_sha256`` and the node's key ``k1, k2``. The root has depth 0 and the key 0, 0.
    """
    rows = stored(prefixes(turns))
    finals = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("_end")).select("conv_id", "_end.*")
    zero = F.lit(0).cast("long")
    turnless = ids.join(finals, "conv_id", "left_anti").select("conv_id", *(zero.alias(k) for k in KEY))
    ends = stored(id_hashes(finals.unionByName(turnless)))
    found = rows.groupBy(*KEY).agg(
        F.first("p1").alias("p1"),
        F.first("p2").alias("p2"),
        F.first("bytes").alias("bytes"),
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
    )
    found = found.join(ends, KEY, "left").withColumns(
        {"n_ends": F.coalesce("n_ends", zero), "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_ENDS))}
    )
    # files of few depths each: a level reads its own
    nodes = stored(found.repartitionByRange("depth", "k1"))
    subtrees = peeled(nodes.drop("ends_sha256"))
    shared = nodes.where("n_convs > 1").select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_above")
    )
    totals = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()
    hashes = nodes.select(*KEY, "ends_sha256")
    # a prefix that only one conversation has has a parent of the same least member
    below_root = F.when(F.col("depth") == 1, F.lit(totals["conv_id"]).cast("long"))
    inner = (
        subtrees.join(shared, ["depth", "p1", "p2"], "left")
        .withColumn("parent_conv_id", F.coalesce(below_root, "_above", "conv_id"))
        .join(hashes, KEY)
    )
    top = subtrees.where("depth = 1").agg(F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens")).first()
    at_root = ends.where("depth = 0").select("n_ends", "ends_sha256").first() or (0, NO_ENDS)
    values = {
        "conv_id": totals["conv_id"],
        "depth": 0,
        "parent_conv_id": None,
        "n_convs": totals["n_convs"],
        "n_ends": at_root[0],
        "n_children": top[0],
        "n_leaves": top[1] or 1,
        "bytes": 0,
        "saved_tokens": top[2] or 0,
        "ends_sha256": at_root[1],
        "k1": 0,
        "k2": 0,
    }
    root = ids.sparkSession.range(1 if totals["n_convs"] else 0).select(
        *(F.lit(v).cast("string" if c == "ends_sha256" else "long").alias(c) for c, v in values.items())
    )
    return inner.select(*values).unionByName(root)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie (``trie_of``) of a table ``conv_id, turn, role, text`` as it stands."""
    turns = stored(numbered(digests(conversations)))
    return trie_of(turns, turns.where("place = 1").select("conv_id"))


def forked_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations that ``forked`` rebuilds."""
    turns = stored(numbered(digests(conversations)))
    return trie_of(forked(turns), turns.where("place = 1").select("conv_id"))
