"""Approximate nearest neighbours by vantage-point trees, one a shard.

Vectors are dealt into cells by the nearest of a few pivots (means of a bounded
sample), and a cell of more than ``SHARD_ROWS`` rows into several shards.  Each
shard becomes one tree, kept as one row of arrays in the shared folder:
a node holds a vantage point, and its rows are halved by their distance to it,
so equal distances halve as well.

A query first visits one shard of its own cell, which gives its bound.  It then
goes to those other shards whose cell may hold something nearer: by the triangle
inequality on the distances to the cell's pivot, and by the plane between that
pivot and the query's own.  A tree is walked once for all queries that meet it,
and a half is visited for the queries whose lower bound, times ``factor``, does
not exceed their bound; so are cells.  ``factor=1`` prunes nothing that could be
nearer, and the search is exact; a larger one prunes more.

Queries and trees meet by an equi-join on the shard.  A shard that is asked by
more than its share is sent in copies, so that no task has all its queries.
Every shard's best ``k`` meet in a window per query.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component take no part, as queries or candidates; rows with a null
id neither (ids are cast to long; a text that is no number is null); vectors of
another length than the query's are no candidates; a query's own id is no
candidate; each of the rows that repeat an id is one, and as a query they are one,
with the vector that sorts first; ties go to the smaller id; an empty table
gives an empty one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, materialise

SHARD_ROWS = 4_096
PIVOTS = 1_024  # at most, for vectors of one length
PIVOT_SAMPLE = 16_384  # vectors that the pivots are means of
HOT_SHARE = 4_096
BLOCK_QUERIES = 2_048
WALK_QUERIES = 256
LEAF = 64
FACTOR = 1.15


@dataclass
class Tree:
    """A tree over rows ``ids`` and ``rows`` (in tree order).

    Node ``j`` covers rows ``low[j]:high[j]``; its vantage point is its first
    row.  ``child[j]`` is -1 for a leaf, else the inner half, and the outer half
    is the node after it.  ``bounds[j]`` has the least and largest distance of
    the inner and of the outer half to the vantage point.
    """

    ids: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF, seed: int = 7) -> Tree:
        rng = np.random.Generator(np.random.PCG64(seed))
        order = np.argsort(ids, kind="stable")
        low, high, child, bounds = [0], [len(ids)], [-1], [(0.0, 0.0, 0.0, 0.0)]
        at = 0
        while at < len(low):
            a, b = low[at], high[at]
            if b - a > max(leaf, 2):
                pick = a + int(rng.integers(b - a))
                order[a], order[pick] = order[pick], order[a]
                rest = order[a + 1 : b]
                gap = np.sqrt(((rows[rest].astype(np.float64) - rows[order[a]].astype(np.float64)) ** 2).sum(1))
                by = np.argsort(gap, kind="stable")
                order[a + 1 : b], gap = rest[by], gap[by]
                mid = len(gap) // 2
                child[at] = len(low)
                bounds[at] = (gap[0], gap[mid - 1], gap[mid], gap[-1])
                low += [a + 1, a + 1 + mid]
                high += [a + 1 + mid, b]
                child += [-1, -1]
                bounds += [(0.0, 0.0, 0.0, 0.0)] * 2
            at += 1
        return Tree(ids[order], np.ascontiguousarray(rows[order]), np.array(low), np.array(high), np.array(child), np.array(bounds, dtype=np.float64))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of each query's best ``k``; -1 and infinity where there are fewer.

        ``known`` bounds what is looked for: nothing farther is needed.
        """
        n = len(queries)
        best_d = np.full((n, k), np.inf)
        best_id = np.full((n, k), -1, dtype=np.int64)
        queries = queries.astype(np.float64)

        def meet(who: np.ndarray, a: int, b: int) -> np.ndarray:
            """Measure rows a:b for some queries; returns the distances."""
            block = self.rows[a:b].astype(np.float64)
            d = np.sqrt(((queries[who][:, None, :] - block[None]) ** 2).sum(-1))
            own = self.ids[None, a:b] == query_ids[who][:, None]
            cd = np.concatenate([best_d[who], np.where(own, np.inf, d)], axis=1)
            ci = np.concatenate([best_id[who], np.where(own, -1, np.broadcast_to(self.ids[a:b], d.shape))], axis=1)
            # a missing one has the distance infinity, so it goes last
            top = np.lexsort((ci, cd), axis=1)[:, :k]
            best_d[who], best_id[who] = np.take_along_axis(cd, top, 1), np.take_along_axis(ci, top, 1)
            return d

        # a first bound: the leaf that each query falls into (measured again below, so it is taken back)
        bound = np.full(n, np.inf)
        todo = [(0, np.arange(n))]
        while todo:
            node, who = todo.pop()
            if not len(who):
                continue
            a, b, c = self.low[node], self.high[node], self.child[node]
            if c < 0:
                meet(who, a, b)
                bound[who] = best_d[who, -1]
                continue
            d = np.sqrt(((queries[who] - self.rows[a].astype(np.float64)) ** 2).sum(1))
            inner = d <= (self.bounds[node][1] + self.bounds[node][2]) / 2
            todo += [(c, who[inner]), (c + 1, who[~inner])]
        best_d[:], best_id[:] = np.inf, -1
        if known is not None:
            bound = np.minimum(bound, known)
        todo = [(0, np.arange(n))]
        while todo:
            node, who = todo.pop()
            if not len(who):
                continue
            a, b, c = self.low[node], self.high[node], self.child[node]
            if c < 0:
                meet(who, a, b)
                bound[who] = np.minimum(bound[who], best_d[who, -1])
                continue
            d = meet(who, a, a + 1)[:, 0]
            bound[who] = np.minimum(bound[who], best_d[who, -1])
            for half, (near, far) in ((c + 1, self.bounds[node][2:]), (c, self.bounds[node][:2])):
                least = np.maximum(np.maximum(d - far, near - d), 0.0)
                # rounding must not prune what lies on the bound itself
                todo.append((half, who[least * factor <= bound[who] * (1 + 1e-12) + 1e-12]))
        return best_id, best_d


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.chunks[0] if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row, and the distance to it."""
    cell, gap = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for at in range(0, len(x), 1_024):
        d = pivot_distances(x[at : at + 1_024], pivots)
        cell[at : at + 1_024], gap[at : at + 1_024] = d.argmin(1), d.min(1)
    return cell, gap


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(pivots)))
    for c in range(pivots.shape[1]):  # component by component: no array of all differences
        out += (x[:, c, None].astype(np.float64) - pivots[None, :, c]) ** 2
    return np.sqrt(out)


def choose_pivots(sample: np.ndarray, n: int, rounds: int = 3) -> np.ndarray:
    """``n`` means of a sample, by a few rounds of k-means; fewer if the sample has fewer distinct rows."""
    pivots = np.unique(sample[: 4 * n].astype(np.float64), axis=0)
    pivots = pivots[np.random.Generator(np.random.PCG64(1)).permutation(len(pivots))[:n]]
    for _ in range(rounds):
        cell, _ = nearest_pivots(sample, pivots)
        for c in np.unique(cell):
            pivots[c] = sample[cell == c].astype(np.float64).mean(0)
    return pivots


def cell_bounds(queries: np.ndarray, pivots: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The least distance that each query can have to a vector of each cell."""
    d = pivot_distances(queries, pivots)
    own = d.argmin(1)
    apart = pivot_distances(pivots[own], pivots)
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(apart > 0, (d**2 - d[np.arange(len(d)), own, None] ** 2) / (2 * apart), 0.0)
    return np.maximum(np.maximum(np.maximum(d - far, near - d), plane), 0.0)


@dataclass
class Cells:
    """Of the vectors of one length: pivots, least and largest distance to them, and shards of each cell."""

    pivots: np.ndarray
    near: np.ndarray
    far: np.ndarray
    shards: np.ndarray


SHARD = ["dim", "cell", "sub"]


class VPIndex:
    """The trees of a table of vectors, written to the shared folder."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> None:
        self.spark = vectors.sparkSession
        own = self._usable(vectors, id_col, vector_col)
        sizes = {r["dim"]: r["n"] for r in own.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
        sample = own.select("dim", "x").orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()
        drawn: dict[int, list] = {}
        for r in sample:
            drawn.setdefault(r["dim"], []).append(r["x"])
        pivots = {d: choose_pivots(np.array(rows), min(PIVOTS, -(-sizes[d] // shard_rows))) for d, rows in drawn.items()}
        # a length that the sample lacks has one cell, around the origin
        pivots |= {d: np.zeros((1, d)) for d in sizes if d not in pivots}
        self.cells = self._measure(own, pivots, shard_rows)
        sent = self.spark.sparkContext.broadcast(self.cells)

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passed = 0
            for dim, ids, x, column in _by_length(batches):
                own = sent.value[dim]
                cell, _ = nearest_pivots(x, own.pivots)
                # the place in the task too: rows that repeat an id are dealt to all shards of their cell
                sub = (ids + passed + np.arange(len(ids))) % own.shards[cell]
                passed += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids), column, *[pa.array(c.astype(np.int32)) for c in (np.full(len(ids), dim), cell, sub)]], ["id", "x", *SHARD])

        kind = own.schema["x"].dataType.simpleString()
        dealt = own.mapInArrow(deal, f"id long, x {kind}, dim int, cell int, sub int")

        def build(table: pa.Table) -> pa.Table:
            key = {c: table[c].slice(0, 1) for c in SHARD}
            x = _matrix(table["x"], key["dim"][0].as_py())
            tree = Tree.build(table["id"].to_numpy(), x, seed=key["cell"][0].as_py())
            arrays = {f: getattr(tree, f) for f in ("ids", "rows", "low", "high", "child", "bounds")}
            return pa.table({**key, "kind": [str(x.dtype)], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()}})

        schema = "dim int, cell int, sub int, kind string, ids binary, rows binary, low binary, high binary, child binary, bounds binary"
        self.trees, self.path = materialise(dealt.groupBy(*SHARD).applyInArrow(build, schema), "trees")
        self.paths = [self.path]

    @staticmethod
    def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        own = vectors.select(F.expr(f"try_cast(`{id_col}` AS long)").alias("id"), F.col(f"`{vector_col}`").alias("x"))
        return own.filter(F.col("id").isNotNull() & usable(F.col("x"))).withColumn("dim", F.size("x"))

    def _measure(self, own: DataFrame, pivots: dict[int, np.ndarray], shard_rows: int) -> dict[int, Cells]:
        """One row a cell comes to the driver."""
        sent = self.spark.sparkContext.broadcast(pivots)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for dim, _, x, _ in _by_length(batches):
                cell, gap = nearest_pivots(x, sent.value[dim])
                cells, at, n = np.unique(cell, return_inverse=True, return_counts=True)
                near, far = np.full(len(cells), np.inf), np.zeros(len(cells))
                np.minimum.at(near, at, gap)
                np.maximum.at(far, at, gap)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), dim, dtype=np.int32)), pa.array(cells.astype(np.int32)), pa.array(n), pa.array(near), pa.array(far)], ["dim", "cell", "n", "near", "far"])

        parts = own.mapInArrow(run, "dim int, cell int, n long, near double, far double")
        found = parts.groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far")).collect()
        out = {d: Cells(p, np.full(len(p), np.inf), np.full(len(p), -np.inf), np.zeros(len(p), dtype=np.int64)) for d, p in pivots.items()}
        for r in found:
            own_cells = out[r["dim"]]
            own_cells.near[r["cell"]], own_cells.far[r["cell"]], own_cells.shards[r["cell"]] = r["near"], r["far"], -(-r["n"] // shard_rows)
        return out

    def _walk(self, sent: DataFrame, k: int, factor: float) -> DataFrame:
        """``query_id, vec_id, score``: the best of each shard for the queries ``dim, cell, sub, id, x, bound`` sent to it."""
        asked = sent.groupBy(*SHARD).agg(F.count(F.lit(1)).alias("n"))
        asked, path = materialise(asked, "asked")
        self.paths.append(path)
        total = asked.agg(F.sum("n")).first()[0] or 0
        # fewer than HOT_SHARE shards have more than their share of the queries
        hot = F.broadcast(asked.filter(F.col("n") > max(BLOCK_QUERIES, total // HOT_SHARE)).select(*SHARD, F.ceil(F.col("n") / BLOCK_QUERIES).cast("int").alias("copies")))
        copies = F.coalesce("copies", F.lit(1))
        held = self.trees.join(asked.select(*SHARD), SHARD, "left_semi").join(hot, SHARD, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
        asking = sent.join(hot, SHARD, "left").withColumn("copy", F.pmod(F.xxhash64("id"), copies).cast("int")).drop("copies")

        def find(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if left.num_rows and right.num_rows:
                dim = left["dim"][0].as_py()
                got = {c: left[c][0].as_py() for c in left.column_names}
                as_array = lambda c, kind: np.frombuffer(got[c], dtype=kind)
                tree = Tree(as_array("ids", np.int64), as_array("rows", got["kind"]).reshape(-1, dim), *(as_array(c, np.int64) for c in ("low", "high", "child")), as_array("bounds", np.float64).reshape(-1, 4))
                q_ids, q, known = right["id"].to_numpy(), _matrix(right["x"], dim), right["bound"].to_numpy()
                for at in range(0, len(q_ids), WALK_QUERIES):
                    part = slice(at, at + WALK_QUERIES)
                    ids, d = tree.search(q_ids[part], q[part], k, factor, known[part])
                    ok = np.isfinite(d)
                    out.append((np.repeat(q_ids[part], ok.sum(1)), ids[ok], d[ok]))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

        keys = [*SHARD, "copy"]
        return held.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(find, "query_id long, vec_id long, score double")

    def search(self, queries: DataFrame, k: int = 10, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """``query_id, rank, vec_id, score``: the nearest found, nearest first."""
        usable_ones = self._usable(queries, id_col, vector_col)
        asked = usable_ones.groupBy("id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))
        kind = asked.schema["x"].dataType.simpleString()
        sent = self.spark.sparkContext.broadcast(self.cells)

        def to_shards(rows: DataFrame, home: bool) -> DataFrame:
            """Each query to the first shard of its own cell, or to the others that its bound does not rule out."""
            def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for dim, ids, x, column, bound in _by_length(batches, with_bound=True):
                    own = sent.value.get(dim)
                    if own is None:
                        continue
                    least = cell_bounds(x, own.pivots, own.near, own.far)
                    least[:, own.shards == 0] = np.inf
                    first = np.where(own.shards[None] > 0, pivot_distances(x, own.pivots), np.inf).argmin(1)
                    if home:
                        row, cell, sub = np.arange(len(ids)), first, np.zeros(len(ids), dtype=np.int64)
                    else:
                        row, cell = np.nonzero(least * factor <= bound[:, None] * (1 + 1e-12) + 1e-12)
                        n = own.shards[cell]
                        row, cell = np.repeat(row, n), np.repeat(cell, n)
                        sub = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                        other = (cell != first[row]) | (sub != 0)
                        row, cell, sub = row[other], cell[other], sub[other]
                    for at in range(0, len(row), 4_096):
                        part = slice(at, at + 4_096)
                        ints = [pa.array(c[part].astype(np.int32)) for c in (np.full(len(row), dim), cell, sub)]
                        yield pa.RecordBatch.from_arrays([*ints, pa.array(ids[row[part]]), column.take(pa.array(row[part])), pa.array(bound[row[part]])], [*SHARD, "id", "x", "bound"])

            return rows.select("id", "x", "bound").mapInArrow(run, f"dim int, cell int, sub int, id long, x {kind}, bound double")

        unbound = asked.withColumn("bound", F.lit(float("inf")))
        near, path = materialise(self._walk(to_shards(unbound, True), k, factor), "near")
        self.paths.append(path)
        reach = near.groupBy("query_id").agg(F.max("score").alias("far"), F.count(F.lit(1)).alias("n"))
        bound = F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf")))
        bounded = asked.join(reach.withColumnRenamed("query_id", "id"), "id", "left").select("id", "x", "dim", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
        found = near.unionByName(self._walk(to_shards(bounded, False), k, factor))
        w = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    def close(self) -> None:
        """Delete the trees and what searches have written, when their results have been read."""
        discard(self.spark, *self.paths)
        self.paths = []


def _by_length(batches: Iterable[pa.RecordBatch], with_bound: bool = False) -> Iterator[tuple]:
    """``dim, ids, matrix, column`` (and bounds) of the rows of each batch (id, x, ...) that have vectors of one length."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4_096):
            batch = whole.slice(at, 4_096)
            dims = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                out = (dim, own.column(0).to_numpy(), _matrix(own.column(1), dim), own.column(1))
                yield (*out, own.column(2).to_numpy()) if with_bound else out


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The exact search: the same trees with a factor of one."""
    return VPIndex(vectors, id_col, vector_col).search(queries, k, 1.0, id_col, vector_col)
