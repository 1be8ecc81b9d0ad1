"""Messages between peers, composites and structural operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values equal to the reference's: what a deadline falls back to without an estimate.
STATIC_BUDGET_NS = 100_000_000


def send(messages: DataFrame, book: DataFrame, now_ns: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One envelope for each peer of a message, and unresolved ones with ``reason``.

    ``messages``: ``req_id, payload, peers array, deadline_ns`` (null takes the
    static budget from ``now_ns``); ``book``: ``peer, addresses``.  An empty list
    of peers sends nothing, and an unknown peer does not stop the others.
    """
    now = F.lit(0) if now_ns is None else now_ns
    each = messages.withColumn("_deadline", F.coalesce(F.col("deadline_ns"), now + F.lit(STATIC_BUDGET_NS))).withColumn("peer", F.explode("peers")).drop("peers", "deadline_ns")
    resolved = each.join(book, "peer", "left").withColumnRenamed("_deadline", "deadline_ns")
    known = F.coalesce(F.size("addresses"), F.lit(0)) > 0
    return resolved.filter(known), resolved.filter(~known).withColumn("reason", F.lit("NotRegistered")).drop("addresses")


def recv(envelopes: DataFrame, peer: str) -> DataFrame:
    """What has arrived at ``peer``."""
    return envelopes.filter(F.col("peer") == peer)


def collect_fills(fields: Sequence[tuple[str, Column, bool]]) -> Column:
    """One fill an input: ``dest, payload, trigger_only, type_hash``; a trigger has no payload."""
    def one(dest: str, value: Column, trigger: bool) -> Column:
        payload = F.lit(None).cast("binary") if trigger else F.encode(value.cast("string"), "UTF-8")
        return F.struct(F.lit(dest).alias("dest"), payload.alias("payload"), F.lit(bool(trigger)).alias("trigger_only"), F.xxhash64(F.typeof(value)).alias("type_hash"))

    return F.array(*[one(dest, value, trigger) for dest, value, trigger in fields])


def deliver(envelopes: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each fill of an envelope, and fills whose type does not match ``dest, type_hash``; siblings pass."""
    fills = envelopes.withColumn("_f", F.explode("fills")).drop("fills").select("*", "_f.*").drop("_f")
    want = expected.select("dest", F.col("type_hash").alias("_want"))
    checked = fills.join(want, "dest", "left")
    ok = F.col("_want").eqNullSafe(F.col("type_hash"))
    return checked.filter(ok).drop("_want"), checked.filter(~ok).drop("_want").withColumn("reason", F.lit("TypeMismatch"))


def bundle(df: DataFrame, name: str, children: Sequence[str]) -> DataFrame:
    if not children:
        raise ValueError("a composite has one child at least")
    return df.withColumn(name, F.struct(*children))


def unbundle(df: DataFrame, name: str, arity: int) -> DataFrame:
    """The children of a composite as columns; their number is checked."""
    have = len(df.schema[name].dataType.fields)
    if have != arity:
        raise ValueError(f"{name} has {have} children, not {arity}")
    return df.select("*", f"{name}.*").drop(name)


def pass_through(column: Column, name: str) -> Column:
    return column.alias(name)


def tee(df: DataFrame, fanout: int = 2) -> list[DataFrame]:
    """The same plan for each consumer; Spark reuses common exchanges."""
    return [df] * fanout


def constant(df: DataFrame, name: str, value: object) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def learn_addresses(claimed: DataFrame, observed: DataFrame) -> DataFrame:
    """``peer, addresses``: what a peer claims, then where it was seen, without repeats."""
    both = claimed.select("peer", "address", F.lit(0).alias("k"), "ts").unionByName(observed.select("peer", "address", F.lit(1).alias("k"), "ts"))
    first = both.groupBy("peer", "address").agg(F.min(F.struct("k", "ts")).alias("o"))
    listed = first.groupBy("peer").agg(F.array_sort(F.collect_list(F.struct("o", "address"))).alias("a"))
    return listed.select("peer", F.transform("a", lambda s: s["address"]).alias("addresses"))
