"""A join that no single key can slow down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(
    rows: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """Join ``rows`` to a narrow table with few rows per key, spreading each key.

    Where ``small`` passes Spark's broadcast size check nothing is shuffled.
    Beyond it, the rows of a key go to ``salts`` tasks (as many as a shuffle has
    by default) by a hash of ``spread`` and ``small`` is repeated that often, so a key with a third of all rows does
    not end up in one task. ``how`` is ``left`` or ``inner``.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    if salts is None:
        salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
