"""Evaluate an expression once and use it many times within one Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated a single time per row.

    Writing a costly Column twice into an expression evaluates it twice wherever
    code generation cannot share it, and nested use multiplies the plan.
    """
    return F.get(F.transform(F.array(value), body), 0)


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` whose columns no filter above is moved below.

    A filter that moves below a Python column has it computed twice, once for
    the filter. Spark does not move one below the columns a generator makes.
    """
    return rows.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))))
