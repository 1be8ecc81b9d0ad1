import pytest
from pyspark.sql import functions as F

from loomfed.operators import coordination, health, peers, timers
from loomfed.sources.tables import as_timestamps
from loomfed.sources.tables import stream as file_stream
from loomfed.streaming import folds

SF = "/root/testdata/sf0.001"


@pytest.fixture
def files(spark, tmp_path):
    """Events in four files, as a stream reads them one a micro-batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", folds.STATE_STORE)
    df = spark.read.parquet(f"{SF}/events.parquet").select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("id"), F.col("user_id").alias("name"),
        F.when(F.col("event_type").isin("click", "view"), "acquire").otherwise("release").alias("action"), F.col("event_id").alias("payload"), "event_type",
    ).orderBy("ts", "id").collect()
    step = len(df) // 4 + 1
    for k in range(4):
        spark.createDataFrame(df[k * step : (k + 1) * step]).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    schema = spark.read.parquet(str(tmp_path / "in/p0")).schema
    for k in range(4):
        part = next((tmp_path / f"in/p{k}").glob("*.parquet"))
        (tmp_path / "flat").mkdir(exist_ok=True)
        part.rename(tmp_path / f"flat/{k}.parquet")
    return lambda: file_stream(spark, str(tmp_path / "flat"), schema, max_files=1), spark.read.parquet(str(tmp_path / "flat"))


def drain(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def same(a, b, *cols):
    assert sorted(map(str, a.select(*cols).collect())) == sorted(map(str, b.select(*cols).collect()))


def test_limit_equals_its_batch_form(spark, files, tmp_path):
    stream, batch = files
    same(drain(spark, folds.limit(stream(), 2), tmp_path, "limits"), coordination.limit(batch, 2), "id", "granted", "inflight")


def test_queue_equals_its_batch_form(spark, files, tmp_path):
    stream, batch = files
    as_queue = lambda d: d.withColumn("action", F.when(F.col("action") == "acquire", "enqueue").otherwise("dequeue")).withColumnRenamed("name", "queue")
    got = drain(spark, folds.serialize(as_queue(stream()), 3), tmp_path, "queues")
    same(got.selectExpr("id", "cast(taken as long) taken", "dropped", "depth"), coordination.serialize(as_queue(batch), 3), "id", "taken", "dropped", "depth")


def test_count_window_equals_its_batch_form(spark, files, tmp_path):
    stream, batch = files
    same(drain(spark, folds.dedup_count_window(stream(), "name", "event_type", 2), tmp_path, "windows"), health.dedup_count_window(batch, "name", "event_type", 2), "id")


def test_tables_with_capacities_equal_their_batch_forms(spark, files, tmp_path):
    stream, batch = files
    slots = lambda d: d.selectExpr("ts", "id", "name % 5 AS node", "name AS slot", "if(action = 'acquire', 'stash', 'flush') AS action", "payload")
    got = drain(spark, folds.hold_table(slots(stream()), 2), tmp_path, "slots")
    same(got.selectExpr("id", "cast(taken AS long) taken", "dropped"), coordination.hold_table(slots(batch), 2), "id", "taken", "dropped")
    heap = lambda d: d.selectExpr("ts AS ts_ns", "id", "name % 5 AS node", "if(action = 'acquire', 'schedule', 'poll') AS action", "ts + id % 7 * 40000000000 AS maturity_ns")
    same(drain(spark, folds.scheduler(heap(stream()), 3), tmp_path, "heaps"), timers.scheduler(heap(batch), 3), "id", "fired", "dropped")
    book = lambda d: d.selectExpr("ts", "id", "name % 5 AS book", "name AS peer", "if(action = 'acquire', 'add', 'drop') AS action", "array(concat('/', id % 3)) AS given")
    same(drain(spark, folds.address_book(book(stream()), 3), tmp_path, "books"), peers.address_book(book(batch), 3), "id", "status", "refs", "addresses")
    depth = lambda d: d.selectExpr("ts AS ts_ns", "id", "name AS peer", "cast(id % 100 AS int) AS depth")
    same(drain(spark, folds.backpressure(depth(stream()), 100, 3_600_000_000), tmp_path, "depths"), health.backpressure(depth(batch), 100, 3_600_000_000), "id", "verdict")


def test_first_arrivals_and_totals(spark, files, tmp_path):
    stream, batch = files
    timed = stream().withColumn("at", F.timestamp_micros("ts"))
    got = drain(spark, folds.first_arrival(timed, ["name"], "at", "365 days"), tmp_path, "firsts")
    assert got.count() == batch.select("name").distinct().count()
    totals = drain(spark, folds.incr_metric(stream(), "event_type"), tmp_path, "totals", "complete")
    same(totals, coordination.incr_metric(batch, "event_type"), "event_type", "total")


def test_timestamps_without_zone_become_utc(spark):
    df = as_timestamps(spark.read.parquet(f"{SF}/events.parquet"))
    assert dict(df.dtypes)["ts"] == "timestamp"
