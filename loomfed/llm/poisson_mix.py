"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the target over its
size.  A document's number of copies is the inverse of the Poisson
distribution of that mean at a number in [0, 1) hashed from the seed and the
document's id, so it depends on neither partitioning nor retries.  Documents
are exploded by their counts and shuffled globally: each copy has a hashed
ticket, by which it is dealt to a partition and placed in it.

A rate times its source's size is right in expectation, and the Poisson spread
of a source is the square root of its sum.  Sizes are one partial aggregation
by source; the distribution tables go with the rates.

A ticket is hashed from the seed, the id, the copy and the number of the input
partition, so rows that repeat an id or have none are dealt to many tasks; a
retried task deals its rows as before.

Defined results: a null source is a source of its own; rows that repeat an id
get equal counts, each row its own copies; a source without a weight, or with
weight or size 0, gives no rows; an empty table gives an empty one.  All
columns are kept, whatever their names: they travel inside one column.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import parallelism, unit_hash

#: The most sources whose rates are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
TAIL = 1e-15
_NULL = "\x00null"


def poisson_cdf(rate: float, tail: float = TAIL) -> list[float]:
    """``P(X <= k)`` for k = 0, 1, ... until less than ``tail`` is above."""
    if rate <= 0:
        return [1.0]
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(total)
        if k > rate and (1.0 - total < tail or k > rate + 40 * math.sqrt(rate) + 60):
            return out
        k += 1


def source_sizes(docs: DataFrame, source_col: str, size: Column) -> DataFrame:
    """``_source, _size`` of each source."""
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(_NULL))
    return docs.groupBy(source.alias("_source")).agg(F.sum(size).cast("double").alias("_size"))


def _rates(sizes: Mapping[str, float], weights: Mapping[str | None, float] | None, temperature: float, epochs: float) -> dict[str, float]:
    """The mean repetition rate of each source that has rows and a weight."""
    if weights is None:
        weighted = {s: n**temperature for s, n in sizes.items() if n > 0}
    else:
        named = {_NULL if s is None else str(s): float(w) for s, w in weights.items()}
        weighted = {s: named[s] for s, n in sizes.items() if n > 0 and named.get(s, 0) > 0}
    # Every source's size counts for the target; shares are among those that have a weight and rows.
    whole, total = math.fsum(sizes.values()), math.fsum(weighted.values())
    return {s: w / total * whole * epochs / sizes[s] for s, w in weighted.items()}


def _many_rates(sizes: DataFrame, weights: Mapping[str | None, float] | None, temperature: float, epochs: float) -> DataFrame:
    """``_source, _rate`` as a table: the same for more sources than the driver takes."""
    if weights is None:
        weighted = sizes.withColumn("_weight", F.when(F.col("_size") > 0, F.pow("_size", F.lit(temperature))).otherwise(0.0))
    else:
        rows = [(_NULL if k is None else str(k), float(v)) for k, v in weights.items()]
        weighted = sizes.join(sizes.sparkSession.createDataFrame(rows, "_source string, _weight double"), "_source")
    live = weighted.filter((F.col("_weight") > 0) & (F.col("_size") > 0))
    whole, total = sizes.agg(F.sum("_size")).first()[0], live.agg(F.sum("_weight")).first()[0]
    return live.select("_source", (F.col("_weight") / F.lit(total) * F.lit(whole) * epochs / F.col("_size")).alias("_rate"))


def poisson_mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    *,
    source_col: str = "source",
    id_col: str = "doc_id",
    size: Column | None = None,
    temperature: float = 0.5,
    epochs: float = 1.0,
    seed: int = 17,
    partitions: int | None = None,
    copy_col: str | None = None,
) -> DataFrame:
    """The documents replicated to the target weights and shuffled globally.

    ``size`` measures a document (default: 1, so weights are shares of
    documents).  Without weights they are the sizes to the power
    ``temperature``; the target's size is ``epochs`` times the whole of the
    input.  ``copy_col`` names a column for the number of the copy, from 0; a
    column of the documents that has this name gives way to it.
    """
    spark = docs.sparkSession
    sizes = source_sizes(docs, source_col, F.lit(1) if size is None else size)
    schema = T.StructType([T.StructField("_source", T.StringType()), T.StructField("_cdf", T.ArrayType(T.DoubleType()))])
    few = {r["_source"]: r["_size"] or 0.0 for r in sizes.limit(BROADCAST_SOURCES + 1).collect()}
    if len(few) <= BROADCAST_SOURCES:
        rates = _rates(few, weights, temperature, epochs)
        tables = F.broadcast(spark.createDataFrame([(s, poisson_cdf(r)) for s, r in rates.items()], schema))
    else:
        cdf = F.udf(poisson_cdf, T.ArrayType(T.DoubleType()))  # once a source, not once a document
        tables = _many_rates(sizes, weights, temperature, epochs).select("_source", cdf("_rate").alias("_cdf"))
    kept = [c for c in docs.columns if c != copy_col]
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(_NULL))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), F.col(f"`{id_col}`").cast("string").alias("_id"), source.alias("_source"))
    u = unit_hash(seed, F.col("_id"))
    count = F.size(F.filter("_cdf", lambda p: p <= u))
    copies = packed.withColumn("_part", F.spark_partition_id()).join(tables, "_source").withColumn("_count", count).filter("_count > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    ticket = F.xxhash64(F.lit(seed), F.col("_id"), F.col("_copy"), F.col("_part"))
    dealt = copies.select("_doc", "_copy", ticket.alias("_ticket")).repartition(partitions or parallelism(spark), "_ticket").sortWithinPartitions("_ticket")
    return dealt.select("_doc.*", *([F.col("_copy").alias(copy_col)] if copy_col else []))
