"""A vector index over a table of ``(id, embedding)``: add, remove, exact and inverted-file search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut

#: Up to this many queries go to every task; more are dealt in blocks of as many, by a shuffle.
BROADCAST_QUERIES = 4_096
SHARD_ROWS = 65_536
#: In an inverted-file search so many rows of a list and so many queries meet in one task.
LIST_ROWS, LIST_QUERIES = 32_768, 16_384
STEP_ROWS = 512
FOUND = "query_id long, vec_id long, distance double"


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision; unequal lengths give null."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))


def add(index: DataFrame, vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The index with new vectors; a known id keeps its old vector."""
    return index.unionByName(vectors.join(index.select(id_col), id_col, "left_anti"))


def remove(index: DataFrame, ids: DataFrame, id_col: str = "vec_id") -> DataFrame:
    return index.join(ids.select(id_col), id_col, "left_anti")


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def _by_length(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The places and the matrix of the vectors of each length; null vectors are in none, null components are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    starts, sizes = column.offsets.to_numpy()[:-1], pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    found = {}
    for dim in np.unique(sizes[sizes >= 0]).tolist():
        own = np.flatnonzero(sizes == dim)
        found[dim] = own, flat[starts[own, None] + np.arange(dim)]
    return found


class _Best:
    """The best ``k`` of each query among the vectors met so far; ties go to the smaller id.

    A matrix product gives all squared distances up to rounding; those that may be
    among the best, with its error allowed for, are computed component by component.
    A query's ``reach`` is a distance beyond which nothing is asked for.
    """

    def __init__(self, query_ids: np.ndarray, queries: pa.Array | pa.ChunkedArray, k: int, reach: np.ndarray | None = None) -> None:
        self.ids, self.k, self.x = query_ids, k, _by_length(queries)
        self.reach = np.full(len(query_ids), np.inf) if reach is None else reach
        self.d, self.v = np.full((len(query_ids), k), np.inf), np.full((len(query_ids), k), -1, dtype=np.int64)

    def meet(self, ids: np.ndarray, vectors: pa.Array | pa.ChunkedArray) -> None:
        for dim, (own, x) in _by_length(vectors).items():
            who, q = self.x.get(dim, ((), None))
            for at in range(0, len(own), STEP_ROWS):
                for part in range(0, len(who), STEP_ROWS):
                    self._step(who[part : part + STEP_ROWS], q[part : part + STEP_ROWS], ids[own[at : at + STEP_ROWS]], x[at : at + STEP_ROWS])

    def _step(self, who: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        with np.errstate(all="ignore"):  # what overflows is not passed over
            size = (q * q).sum(1)[:, None] + (x * x).sum(1)
            error = 1e-15 * (q.shape[1] + 16)  # relative, several times that of the sums and the product
            limit = np.minimum(self.d[who, -1], self.reach[who]) ** 2 * (1 + 1e-12)
            row, col = np.nonzero(~(size * (1 - error) - 2 * (q @ x.T) > limit[:, None]))
            if not len(row):
                return
            gap = np.zeros(len(row))
            for c in range(q.shape[1]):  # component by component: no array of all differences
                gap += (q[row, c] - x[col, c]) ** 2
        rows = np.unique(row)
        to = np.concatenate([np.repeat(rows, self.k), row])
        d = np.concatenate([self.d[who[rows]].ravel(), np.sqrt(gap)])
        v = np.concatenate([self.v[who[rows]].ravel(), ids[col]])
        order = np.lexsort((v, d, to))
        first = np.searchsorted(to[order], rows)
        top = order[first[:, None] + np.arange(self.k)]
        self.d[who[rows]], self.v[who[rows]] = d[top], v[top]

    def found(self) -> dict[str, pa.Array]:
        ok = np.isfinite(self.d)
        return {"query_id": pa.array(np.repeat(self.ids, ok.sum(1)), pa.int64()), "vec_id": pa.array(self.v[ok], pa.int64()), "distance": pa.array(self.d[ok], pa.float64())}


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", query_col: str = "query_id") -> DataFrame:
    """Exact top ``k`` of each query, ties to the smaller id; ids are integers.

    Each task keeps the best ``k`` of the index rows it reads, so the index is
    not shuffled and no pair leaves a task.  More than ``BROADCAST_QUERIES``
    queries are dealt in blocks of as many, the index in shards of
    ``SHARD_ROWS``, and each block meets each shard in one task.
    """
    stored = index.select(F.col(id_col).cast("long").alias("vec_id"), F.col("embedding").alias("x")).filter("vec_id is not null")
    asked = queries.select(F.col(query_col).cast("long").alias("query_id"), F.col("embedding").alias("x")).filter("query_id is not null")
    few = asked.limit(BROADCAST_QUERIES + 1).collect()
    if len(few) <= BROADCAST_QUERIES:
        sent = index.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in few], dtype=np.int64), pa.array([r["x"] for r in few], pa.list_(pa.float64()))))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(*sent.value, k)
            for batch in batches:
                best.meet(batch.column(0).to_numpy(), batch.column(1))
            yield pa.RecordBatch.from_pydict(best.found())

        return _nearest(stored.mapInArrow(run, FOUND), k)
    blocks, shards = -(-asked.count() // max(BROADCAST_QUERIES, 1)), max(1, -(-stored.count() // SHARD_ROWS))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = stored.withColumn("shard", deal("vec_id", shards)).withColumn("block", every(blocks))
    right = asked.withColumn("block", deal("query_id", blocks)).withColumn("shard", every(shards))

    def meet(own: pa.Table, asking: pa.Table) -> pa.Table:
        best = _Best(asking["query_id"].to_numpy(), asking["x"], k)
        best.meet(own["vec_id"].to_numpy(), own["x"])
        return pa.table(best.found())

    keys = ["shard", "block"]
    return _nearest(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND), k)


def train(index: DataFrame, lists: int, rounds: int = 10, sample: int = 10_000, id_col: str = "vec_id") -> list[list[float]]:
    """Centroids of an inverted file by k-means on a bounded sample (the ``sample`` smallest id hashes)."""
    rows = index.select("embedding", F.xxhash64(id_col).alias("h"), id_col).orderBy("h", id_col).limit(sample).collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    if not len(x):
        return []
    centres = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = ((x[:, None, :] - centres[None]) ** 2).sum(-1).argmin(1) if len(x) * len(centres) < 4e6 else np.array([((centres - row) ** 2).sum(1).argmin() for row in x])
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(0)
    return centres.tolist()


def _ranked(df: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Rows of ``id, x`` with ``lists`` and their distances ``offs``, the nearest first.

    Vectors that have no distance to the centroids (null, of another length, not finite) have no lists.
    """
    kind = df.schema["x"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.array(centres, dtype=np.float64)
        for batch in batches:
            lists, offs = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            own, x = _by_length(batch.column(1)).get(c.shape[1], ((), None)) if len(c) else ((), None)
            if len(own):
                with np.errstate(all="ignore"):
                    gap = np.stack([np.sqrt(((x - row) ** 2).sum(1)) for row in c], 1)
                order = np.argsort(gap, 1, kind="stable")
                for at in np.flatnonzero(np.isfinite(gap).all(1)).tolist():
                    lists[own[at]], offs[own[at]] = order[at].tolist(), gap[at, order[at]].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32())), pa.array(offs, pa.list_(pa.float64()))], names=["id", "x", "lists", "offs"])

    return df.mapInArrow(run, f"id long, x {kind}, lists array<int>, offs array<double>")


def search_ivf(index: DataFrame, queries: DataFrame, centres: list[list[float]], k: int, probes: int = 4, id_col: str = "vec_id", query_col: str = "query_id") -> DataFrame:
    """Exact top ``k``: each query's ``probes`` nearest lists, then those others that may hold a nearer vector.

    By the triangle inequality no vector of a list is nearer than the list's
    centroid less the list's radius, so a list beyond the k-th distance is passed over.
    Lists are cut into shards and queries dealt in blocks, which meet in one task
    each; list -1 has the vectors without a list, and every query asks it.
    """
    ids = lambda df, c: df.select(F.col(c).cast("long").alias("id"), F.col("embedding").alias("x")).filter("id is not null")
    own = _ranked(ids(index, id_col), centres)
    stored = own.select(F.col("id").alias("vec_id"), "x", F.coalesce(F.get("lists", F.lit(0)), F.lit(-1)).alias("list"), F.get("offs", F.lit(0)).alias("off"))
    about = {r["list"]: r for r in stored.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius")).collect()}
    of_list = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("list") + 1)
    every = range(-1, len(centres))
    shards = of_list([-(-about[n]["n"] // LIST_ROWS) if n in about else 0 for n in every])
    radius = of_list([float(about[n]["radius"] or 0.0) if n in about else 0.0 for n in every])
    asked = _ranked(ids(queries, query_col), centres)
    blocks = max(1, -(-asked.count() // LIST_QUERIES))
    turns = F.array_insert(F.arrays_zip("lists", "offs"), 1, F.struct(F.lit(-1).alias("lists"), F.lit(0.0).alias("offs")))
    asked = asked.select(F.col("id").alias("query_id"), "x", F.posexplode(turns).alias("turn", "to"))
    asked = asked.select("query_id", "x", "turn", F.col("to.lists").alias("list"), F.col("to.offs").alias("centre")).filter(shards > 0)
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    keys = ["list", "shard", "block"]

    def meet(rows: pa.Table, asking: pa.Table) -> pa.Table:
        reach = asking["reach"].to_numpy()
        best = _Best(asking["query_id"].to_numpy(), asking["x"], k, np.where(np.isnan(reach), np.inf, reach))
        best.meet(rows["vec_id"].to_numpy(), rows["x"])
        return pa.table(best.found())

    def measured(asking: DataFrame) -> DataFrame:
        right = asking.select("query_id", "x", "list", "reach", deal("query_id", F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), shards.cast("int") - 1)).alias("shard"))
        left = stored.select("vec_id", "x", "list", deal("vec_id", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND)

    first = cut(_nearest(measured(asked.filter(F.col("turn") <= probes).withColumn("reach", F.lit(None).cast("double"))), k))
    reach = first.groupBy("query_id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
    near = (F.col("centre") - radius) <= F.col("far") * (1 + 1e-9)
    others = asked.filter(F.col("turn") > probes).join(reach, "query_id", "left").filter(F.col("far").isNull() | near)
    return _nearest(first.drop("rank").unionByName(measured(others.withColumnRenamed("far", "reach"))), k)
