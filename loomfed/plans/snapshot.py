"""Snapshots of the state tables of a node, and their restoration.

A state is a set of named tables: registry, address books, back-off states,
held slots, rings, queues.  Each is written as Parquet, and the manifest, which
names the tables and their schemas, comes last: a folder without one is not a
snapshot, so a run that is cut short leaves nothing that could be restored.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "_manifest"
VERSION = 1


class SnapshotError(ValueError):
    """The folder holds no whole snapshot of this version."""


def snapshot(spark: SparkSession, state: Mapping[str, DataFrame], path: str) -> None:
    """Write the tables of a state into a new folder."""
    if MANIFEST in state or not all(name.isidentifier() for name in state):
        raise SnapshotError(f"names of tables: {sorted(state)}")
    for name, table in state.items():
        table.write.parquet(f"{path}/{name}")
    rows = [(VERSION, name, table.schema.json()) for name, table in state.items()]
    spark.createDataFrame(rows, "version int, name string, schema string").coalesce(1).write.parquet(f"{path}/{MANIFEST}")


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot by name, with the schemas they had."""
    try:
        rows = spark.read.parquet(f"{path}/{MANIFEST}").select("version", "name", "schema").collect()
    except AnalysisException as e:
        raise SnapshotError(f"{path} holds no whole snapshot") from e
    if any(r["version"] != VERSION for r in rows):
        raise SnapshotError(f"{path} is of another version")
    return {r["name"]: spark.read.schema(T.StructType.fromJson(json.loads(r["schema"]))).parquet(f"{path}/{r['name']}") for r in rows}


def resume(snapshotted: DataFrame, events: DataFrame, order: str = "ts_ns") -> DataFrame:
    """A log that goes on after a snapshot: its rows, and those events that are later than all of them."""
    last = snapshotted.agg(F.max(order)).first()[0]
    return snapshotted.unionByName(events if last is None else events.filter(F.col(order) > F.lit(last)))
