"""Limits and duplicates within each city (or query).

Every rule here is "first wins" in a stated order, so the order is always an
argument. A city or name may hold a great share of all rows: each operator cuts
or combines per map task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storefront.functions.text import name_key
from storefront.materialize import materialize
from storefront.params import check_limit

# Up to this limit Spark cuts groups in each task before it shuffles them.
_CUT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"


def _cut_in_tasks(rows: DataFrame, limit: int) -> DataFrame:
    """``rows``, of whose groups Spark may send on ``limit`` rows of each task.

    A limit beyond the session's threshold raises it; a session that has turned
    this cut off (-1) keeps it off.
    """
    conf = rows.sparkSession.conf
    if 0 <= int(conf.get(_CUT_SETTING, "1000")) <= limit:
        conf.set(_CUT_SETTING, str(limit + 1))
    return rows


def dedup(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "name"
) -> DataFrame:
    """First row of each name within ``by``; rows with a blank name are dropped."""
    first = Window.partitionBy(*by, "_name_key").orderBy(*order)
    return (
        rows.withColumn("_name_key", name_key(F.col(name)))
        .where(F.col("_name_key") != "")
        .withColumn("_rank", F.row_number().over(first))
        .where("_rank = 1")
        .drop("_name_key", "_rank")
    )


def dedup_counts(rows: DataFrame, by: Sequence[str], name: str = "name") -> DataFrame:
    """``(*by, n_raw, n_kept, n_removed)``: what ``dedup`` keeps, without running it."""
    key = name_key(F.col(name))
    counted = rows.groupBy(*by).agg(
        F.count("*").alias("n_raw"),
        F.countDistinct(F.when(key != "", key)).alias("n_kept"),
    )
    return counted.withColumn("n_removed", F.col("n_raw") - F.col("n_kept"))


def limit_rows(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], limit: int
) -> DataFrame:
    """The first ``limit`` rows of each group."""
    limit = check_limit(limit)
    position = Window.partitionBy(*by).orderBy(*order)
    return (
        _cut_in_tasks(rows, limit)
        .withColumn("_rank", F.row_number().over(position))
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )


def _starts(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """The rows that differ from the one before in any of ``columns``, the first row included."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for name in columns:
        before, now = batch.column(name)[:-1], batch.column(name)[1:]
        differs = pc.or_(pc.fill_null(pc.not_equal(before, now), False), pc.xor(pc.is_null(before), pc.is_null(now)))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _pages(
    batches: Iterator[pa.RecordBatch], by: Sequence[str], page: str
) -> Iterator[tuple[pa.RecordBatch, list[tuple[tuple, tuple, int, int]]]]:
    """Batches with their pages ``(group, page, start, end)``; a page may go on in the next batch."""
    for batch in batches:
        if batch.num_rows:
            starts = _starts(batch, [*by, page])
            first = batch.take(pa.array(starts))
            groups = list(zip(*(first.column(c).to_pylist() for c in by))) or [()] * len(starts)
            pages = first.column(page).to_pylist()
            yield batch, list(zip(groups, pages, starts.tolist(), [*starts[1:].tolist(), batch.num_rows]))


def _quotas_before(ranges: DataFrame, by: Sequence[str], page: str, limit: int) -> dict[int, int]:
    """How many cards are still wanted where a range of pages begins, for ranges that begin within a group.

    What a page takes depends on how many cards are wanted, and pages only ever
    close places: of the numbers 0..limit-1 a page whose valid cards stand at
    places *p* closes the *p*-th open ones, and of *n* wanted cards as many are
    left as there are open numbers below *n*. So a range of pages is the list of
    numbers it leaves open, whatever is wanted before it, and ranges are read side
    by side. The lists of a group, ``limit`` numbers at most for each range, are
    then followed in order; the driver gets one number per range.
    """

    def left_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, first, place, number = None, None, None, None, 0
        is_open = np.arange(limit)
        closed: list[np.ndarray] = []

        def close_page() -> None:
            nonlocal is_open
            if closed:
                places = np.concatenate(closed)
                is_open = np.delete(is_open, places[places < len(is_open)])
                closed.clear()

        def row(batch_schema: pa.Schema) -> pa.RecordBatch:
            close_page()
            columns = [pa.array([part], pa.int64()), pa.array([number], pa.int64())]
            columns += [pa.array([v], batch_schema.field(c).type) for c, v in zip(by, current)]
            columns.append(pa.array([is_open], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(columns, ["_part", "_number", *by, "_open"])

        schema = None
        for batch, pages in _pages(batches, by, page):
            schema = batch.schema
            part = batch.column("_part")[0].as_py()
            at = batch.column("_at").to_numpy()
            for group, now, start, end in pages:
                if group != current or first is None:
                    if first is not None and number == 0:
                        yield row(schema)  # the first group of the range ends here
                    if first is not None:
                        number += 1
                    first, current, place = group, group, now
                    is_open = np.arange(limit)
                    closed.clear()
                elif now != place:
                    close_page()
                    place = now
                closed.append(at[start:end])
        if first is not None:
            yield row(schema)  # the last group, which may be the first

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begun, left = None, False, limit
        for batch in batches:
            groups = list(zip(*(batch.column(c).to_pylist() for c in by))) or [()] * batch.num_rows
            parts, numbers = batch.column("_part").to_pylist(), batch.column("_number").to_pylist()
            found = []
            for n, group in enumerate(groups):
                if not begun or group != current:
                    begun, current, left = True, group, limit
                if numbers[n] == 0:
                    found.append((parts[n], left))
                left = int(np.searchsorted(batch.column("_open")[n].values.to_numpy(), left))
            columns = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_part", "_left"])

    kinds = dict(ranges.dtypes)
    schema = ", ".join(["_part long", "_number long", *(f"`{c}` {kinds[c]}" for c in by), "_open array<long>"])
    placed = ranges.select(*by, page, "_at", F.spark_partition_id().cast("long").alias("_part"))
    summed = placed.mapInArrow(left_open, schema)
    together = summed.repartition(*by) if by else summed.coalesce(1)
    rows = together.sortWithinPartitions(*by, "_part", "_number").mapInArrow(follow, "_part long, _left long").collect()
    return {r["_part"]: r["_left"] for r in rows}


def limit_page_quota(
    cards: DataFrame,
    by: Sequence[str],
    page: str,
    idx: str,
    limit: int,
    valid: Column,
) -> DataFrame:
    """The limit as result pages are read: a card that fails is not replaced.

    On each page in turn only the first ``limit - taken`` cards are looked at,
    and those that are ``valid`` are taken. What one page takes therefore
    depends on all pages before it.

    A page takes something only while more cards are wanted than lie before its
    first valid card. Pages whose first valid card has the same position *p*
    are hence used in order, one card or more each, never more than ``limit - p``
    of them, and at the *n*-th at most ``limit - n + 1`` cards are still wanted. Only
    such pages are kept. They are sorted by ranges, so that a group with many pages
    spans many tasks, and written; each range is read on its own, first for what it
    leaves (``_quotas_before``), then, with what was left before it, for its cards.
    """
    limit, columns = check_limit(limit), cards.columns
    on_page = Window.partitionBy(*by, page)
    looked_at = (
        _cut_in_tasks(cards, limit)
        .withColumn("_place", F.row_number().over(on_page.orderBy(idx)))
        .where(F.col("_place") <= limit)
        .where(valid)
        .withColumn("_at", (F.col("_place") - 1).cast("long"))
        .withColumn("_first", F.min("_at").over(on_page))
    )
    same_start = Window.partitionBy(*by, "_first").orderBy(page)
    usable = (
        looked_at.withColumn("_nth", F.dense_rank().over(same_start))
        .where((F.col("_nth") <= limit) & (F.col("_nth") <= limit - F.col("_first")))
        .where(F.col("_at") <= limit - F.col("_nth"))
        .select(*columns, "_at")
    )
    ranges = materialize(usable.repartitionByRange(*by, page).sortWithinPartitions(*by, page, "_at"))
    before = _quotas_before(ranges, by, page, limit)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, current, place, left, quota = False, None, None, limit, limit
        for batch, pages in _pages(batches, by, page):
            at = batch.column("_at").to_numpy()
            keep = np.zeros(len(at), bool)
            for group, now, start, end in pages:
                if not begun:
                    left = quota = before[batch.column("_part")[0].as_py()]
                elif group != current:
                    left = quota = limit
                elif now != place:
                    quota = left
                begun, current, place = True, group, now
                taken = int(np.searchsorted(at[start:end], quota))
                keep[start : start + taken] = True
                left -= taken
            yield batch.select(columns).filter(pa.array(keep))

    return ranges.withColumn("_part", F.spark_partition_id().cast("long")).mapInArrow(read, cards.schema)
