"""Joins by key that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def join_by_key(rows: DataFrame, table: DataFrame, keys: Sequence[str], held: str, share: int = HOT_SHARE,
                how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``rows`` with ``table``, which has one row per key and in ``held`` the number of rows with that key.

    A key that holds more than one ``share``-th of what the table counts is hot. There are fewer than ``share`` hot keys, whatever the
    size of the data, so they are broadcast and their rows are not shuffled; all other keys are joined by shuffle. The table should be stored.
    """
    total = table.agg(F.sum(held)).first()[0]
    if not total:
        return rows.join(table.drop(held), list(keys), how)
    limit = F.col(held) > total / share
    hot, rest = F.broadcast(table.where(limit).drop(held)), table.where(~limit).drop(held)
    cold = rows.join(hot, list(keys), "left_anti").join(rest, list(keys), how)
    return rows.join(hot, list(keys)).unionByName(cold)
