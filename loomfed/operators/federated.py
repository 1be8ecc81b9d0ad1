"""Weighted federated averaging of tensors contributed by peers.

Contributions are rows ``(round, peer, seq, i, v, num_samples)``: one row for
each element of a peer's tensor.  A peer's later contribution to a round
replaces the earlier one; contributions without samples are rejected.  NaN and
infinities pass through and poison their element, as they must.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contribute(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contributions that count, and the rejected ones with ``reason``.

    The latest ``seq`` of each (round, peer) is an aggregate joined back, so no
    peer's rows have to meet in one task.
    """
    bad = F.col("num_samples").isNull() | (F.col("num_samples") <= 0)
    rejected = rows.filter(bad).withColumn("reason", F.lit("BadInput"))
    good = rows.filter(~bad)
    latest = good.groupBy("round", "peer").agg(F.max("seq").alias("seq"))
    return good.join(latest, ["round", "peer", "seq"], "left_semi"), rejected


def aggregate(contributions: DataFrame) -> DataFrame:
    """``round, i, v, num_samples``: the average weighted by samples.  An empty round has no rows."""
    weighted = F.sum(F.col("v") * F.col("num_samples")) / F.sum("num_samples")
    return contributions.groupBy("round", "i").agg(weighted.alias("v"), F.sum("num_samples").alias("num_samples"))


def fedavg(rows: DataFrame) -> DataFrame:
    return aggregate(contribute(rows)[0])


def hierarchical(contributions: DataFrame, group_col: str) -> DataFrame:
    """Two levels: each group averages its peers, and a parent averages the groups by their samples."""
    weighted = F.sum(F.col("v") * F.col("num_samples")) / F.sum("num_samples")
    children = contributions.groupBy("round", group_col, "i").agg(weighted.alias("v"), F.sum("num_samples").alias("num_samples"))
    return aggregate(children)
