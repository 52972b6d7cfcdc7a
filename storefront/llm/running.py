"""Running totals within a key, without one task that holds a whole key.

Rows are sorted by ranges of (key, order), so a key of any size spans as many tasks
as it needs. One pass tells what each range holds of its last key; the driver adds up
one row per range; a second pass starts each range with what the ranges before it
hold of its first key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storefront.llm.common import cut

#: How values add up, and what takes a part off again.
SUM = (np.add, np.subtract)
XOR = (np.bitwise_xor, np.bitwise_xor)


def in_ranges(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """``rows`` in ranges of (key, order), written: later passes find the same ranges."""
    by = [F.col(key), *order]
    return cut(rows.repartitionByRange(*by).sortWithinPartitions(*by))


def _values(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.array([batch.column(n).to_numpy(zero_copy_only=False) for n in names], np.int64)


def running(ranges: DataFrame, key: str, values: Sequence[str], how: tuple[np.ufunc, np.ufunc]) -> DataFrame:
    """``ranges`` (of ``in_ranges``) with the running total of each of ``values``, in place of it.

    The key is a long without nulls, the values are longs without nulls.
    """
    fold, undo = how
    zero = np.zeros(len(values), np.int64)
    names = ["part", "first", "last", *values]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        total = zero
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            if part is None:
                part, first = batch.column("_part")[0].as_py(), int(keys[0])
            start = int(np.searchsorted(keys, keys[-1]))
            here = fold.reduce(_values(batch, values)[:, start:], axis=1)
            total = fold(total, here) if start == 0 and last == int(keys[-1]) else here
            last = int(keys[-1])
        if part is not None:
            row = [part, first, last, *map(int, total)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names)

    placed = ranges.withColumn("_part", F.spark_partition_id().cast("long"))
    found = placed.mapInArrow(ends, ", ".join(f"`{n}` long" for n in names)).collect()
    carried: dict[int, np.ndarray] = {}
    held, total = None, zero
    for row in sorted(found, key=lambda r: r["part"]):
        own = np.array([row[v] for v in values], np.int64)
        if row["first"] == held:
            carried[row["part"]] = total
        total = fold(total, own) if row["first"] == held and row["last"] == held else own
        held = row["last"]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, zero
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, own = batch.column(key).to_numpy(), _values(batch, values)
            if last is None:
                last, total = int(keys[0]), carried.get(batch.column("_part")[0].as_py(), zero)
            new = np.concatenate([[int(keys[0]) != last], keys[1:] != keys[:-1]])
            so_far = fold.accumulate(own, axis=1)
            # what stood before the key's first row in this batch
            start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
            before = undo(so_far[:, start], own[:, start])
            result = undo(so_far, before)
            if not new[0]:
                same = slice(0, int(np.searchsorted(keys, keys[0], "right")))
                result[:, same] = fold(result[:, same], total[:, None])
            last, total = int(keys[-1]), result[:, -1]
            arrays = [
                pa.array(result[values.index(f.name)], pa.int64()) if f.name in values else batch.column(f.name)
                for f in schema_fields
            ]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema_fields])

    values = list(values)
    schema_fields = list(ranges.schema.fields)
    return placed.mapInArrow(add_up, T.StructType(schema_fields))
