"""Equi-joins whose tasks stay as small as they are, however large the tables become."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Rows of the larger side that a task of a dealt join has, about.
PART_ROWS = 500_000


def parts_of(rows: int) -> int:
    """Into how many parts a table of so many rows is dealt."""
    return max(1, -(-rows // PART_ROWS))


def dealt_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """An inner join on columns of both sides, dealt by them into parts of a fixed size.

    The number of parts follows the counts, not the session's shuffle partitions,
    so more rows make more tasks.  Tables of one part are left to Catalyst.
    """
    parts = parts_of(max(left.count(), right.count()))
    if parts > 1:
        left, right = left.repartition(parts, *on), right.repartition(parts, *on).hint("merge")
    return left.join(right, list(on))
