"""Timer and trigger sources.  Times are integer nanoseconds unless a column is a timestamp."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folds import ordered_fold

PERIOD_NS = 1_000_000_000
SCHEDULER_CAP = 65_536


def interval(spark: SparkSession, start_ns: int, until_ns: int, period_ns: int = PERIOD_NS) -> DataFrame:
    """Ticks at the start and every period after it, before ``until_ns``: ``tick, ts_ns``."""
    n = max(0, -(-(until_ns - start_ns) // period_ns))
    return spark.range(n).select(F.col("id").alias("tick"), (F.col("id") * period_ns + start_ns).alias("ts_ns"))


def interval_per(df: DataFrame, start: str, until: str, period_ns: int = PERIOD_NS) -> DataFrame:
    """Ticks of each row's own timer."""
    count = F.ceil((F.col(until) - F.col(start)) / period_ns)
    ticks = df.filter(count > 0).withColumn("tick", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return ticks.withColumn("ts_ns", F.col(start) + F.col("tick") * period_ns)


def after(ts_ns: Column, delay_ns: int = 0) -> Column:
    """When a one-shot trigger fires."""
    return ts_ns + F.lit(delay_ns)


sleep = after


def pulse(spark: SparkSession) -> DataFrame:
    """One trigger."""
    return spark.range(1).select(F.lit(True).alias("trigger"))


def on_trigger(df: DataFrame) -> DataFrame:
    return df


def event_source(events: DataFrame, kind: str, kind_col: str = "event_type") -> DataFrame:
    """Events of one kind; the filter reaches the scan."""
    return events.filter(F.col(kind_col) == kind)


def clock() -> Column:
    """Nanoseconds since the epoch, one value a query."""
    return F.unix_micros(F.current_timestamp()) * 1_000


def rng_u64(seed: int, *by: Column) -> Column:
    """A reproducible random 64-bit number of each row, signed: the first half of the MD5 of the seed and the columns."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in by]))
    halves = [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9)]
    return F.shiftleft(halves[0], 32).bitwiseOR(halves[1])


def lifecycle_phase(steps: DataFrame, phase: str) -> DataFrame:
    """The operators that are enrolled in a phase."""
    return steps.filter(F.col("phase") == phase)


def bootstrap_dispatch(requests: DataFrame) -> DataFrame:
    """A command id for each request: unique, from its own content."""
    return requests.withColumn("cmd", F.md5(F.to_json(F.struct(*requests.columns))))


def bootstrap_output(commands: DataFrame, completions: DataFrame) -> DataFrame:
    """Completed commands."""
    return commands.join(completions, "cmd")


Heap = list[tuple[int, int]]


def schedule_step(heap: Heap, action: str, ts_ns: int, maturity_ns: int, timer: int, cap: int) -> tuple[Heap, list[int], bool]:
    """The heap after an action, the timers that a poll fires, oldest first, and whether a new timer was dropped."""
    if action == "poll":
        fired = []
        while heap and heap[0][0] <= ts_ns:
            fired.append(heapq.heappop(heap)[1])
        return heap, fired, False
    if len(heap) >= cap:
        return heap, [], True
    heapq.heappush(heap, (maturity_ns, timer))
    return heap, [], False


def scheduler(events: DataFrame, cap: int = SCHEDULER_CAP, key: str = "node") -> DataFrame:
    """Each event with ``fired`` (polls) and ``dropped`` (new timers while the heap holds ``cap``).

    ``events``: ``node, ts_ns, id, action, maturity_ns``; ``schedule`` adds the
    timer ``id`` and ``poll`` takes those that have matured at its time.
    """
    def step(heap: Heap, row: dict) -> tuple[Heap, dict]:
        heap, fired, dropped = schedule_step(heap, row["action"], row["ts_ns"], row["maturity_ns"], row["id"], cap)
        return heap, {"fired": fired, "dropped": dropped}

    return ordered_fold(events, [key], ["ts_ns", "id"], list, step, "fired array<long>, dropped boolean")
