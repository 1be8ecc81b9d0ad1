"""Readers and writers: the fixture tables, and the common file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Explicit schemas of the inputs of stateful operators, so that no reader has to infer one.
SCHEMAS = {
    "contributions": "round long, peer string, seq long, i int, v double, num_samples long",
    "announces": "ts_ns long, id long, peer string, addresses array<string>",
    "link_events": "ts_ns long, id long, peer string, ok boolean",
    "queue_events": "ts long, id long, queue string, action string, payload string",
    "limit_events": "ts long, id long, name string, action string",
    "messages": "req_id long, payload binary, peers array<string>, deadline_ns long",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table."""
    if name not in TABLES:
        raise ValueError(f"no table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as messages of peers: ``id, ts_ns, peer, event_type, value, ok``; an error is a failure."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.unix_micros(ts) * 1000).alias("ts_ns"),
        F.col("user_id").alias("peer"),
        "event_type",
        "value",
        (F.col("event_type") != "error").alias("ok"),
    )


def as_timestamps(df: DataFrame) -> DataFrame:
    """Timestamps without zone as UTC timestamps, which watermarks need."""
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in df.schema])


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table of any built-in format; text formats need a schema."""
    if schema is None and fmt in ("csv", "json", "text"):
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: str) -> None:
    df.write.format(fmt).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", max_files: int = 64) -> DataFrame:
    """A stream of the files of a folder, a bounded number of them a micro-batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)
