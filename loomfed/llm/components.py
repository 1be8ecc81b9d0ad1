"""Connected components of a table of links, on executors only.

Each round first contracts links inside Arrow batches with a union-find of
bounded size, then applies a large-star and a small-star step, both of which
are aggregations and equi-joins.  Of the nodes that many links point to fewer
than ``HOT_SHARE`` are hot; what these point to is broadcast, so no task has all
links of a hub.  Rounds are written to the shared folder, and they end when no
link changes.  Nothing of the graph reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialise

CONTRACT_ROWS = 1 << 18
HOT_SHARE = 4_096
HOT_LEAST = 64


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same components with at most one link a node, run by run."""
    def flush(links: list[tuple[int, int]]) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in links:
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        out = [(x, r) for x in parent if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], ["u", "v"])

    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        if len(held) >= CONTRACT_ROWS:
            yield flush(held)
            held = []
    yield flush(held)


def connected_components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of a link: the smallest node reachable."""
    spark = links.sparkSession
    pairs = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).filter("u > v")
    edges, path = materialise(pairs.mapInArrow(_contract, "u long, v long").distinct(), "links")
    for _ in range(max_rounds):
        # large-star: a node points to the smallest neighbour of the smaller node that it points to
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        many = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(HOT_LEAST, edges.count() // HOT_SHARE)).select("v")
        hot = F.broadcast(many.join(least, "v", "left"))
        rest = edges.join(hot.select("v"), "v", "left_anti").join(least, "v", "left")
        large = edges.join(hot, "v").unionByName(rest).select("u", F.coalesce("m", "v").alias("v")).distinct()
        # small-star: a node and its smaller neighbours point to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        step = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after, new_path = materialise(step, "links")
        # finished when every node has one link and no target is itself linked on
        open_ = after.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty() and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        discard(spark, path)
        edges, path = after, new_path
        if open_:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
