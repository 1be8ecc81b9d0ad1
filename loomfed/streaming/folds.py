"""Streaming forms: the ordered folds of the batch operators with their state in the state store.

Rows of one key that come in one micro-batch are applied in the given order;
rows of later micro-batches after them.  Each operator uses the transition
function of its batch form.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import coordination, health, peers, timers
from ..operators.folds import Step

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FoldProcessor(StatefulProcessor):
    """Keeps one state a key, as bytes; its size is bounded by the operator's own capacity."""

    def __init__(self, order: Sequence[str], init: Callable[[], Any], step: Step, columns: Sequence[str], added: Sequence[str]) -> None:
        self.order, self.make, self.step, self.columns, self.added = list(order), init, step, list(columns), list(added)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("state", "blob binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = pickle.loads(self.held.get()[0]) if self.held.exists() else self.make()
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out = []
        for row in batch.to_dict("records"):
            state, new = self.step(state, row)
            if new is not None:
                out.append(row | {n: new.get(n) for n in self.added})
        self.held.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=[*self.columns, *self.added])

    def close(self) -> None:
        pass


def stream_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], init: Callable[[], Any], step: Step, out: str) -> DataFrame:
    """The streaming form of :func:`loomfed.operators.folds.ordered_fold`; the session uses ``STATE_STORE``."""
    added = T._parse_datatype_string(out)
    schema = T.StructType([*df.schema.fields, *added.fields])
    processor = FoldProcessor(order, init, step, df.columns, [f.name for f in added.fields])
    return df.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="None")


def limit(events: DataFrame, n: int = 1, key: str = "name") -> DataFrame:
    def step(state: int, row: dict) -> tuple[int, dict | None]:
        state, granted = coordination.limit_step(state, row["action"], n)
        return state, (None if granted is None else {"granted": granted, "inflight": state})

    return stream_fold(events, [key], ["ts", "id"], lambda: 0, step, "granted boolean, inflight int")


def serialize(events: DataFrame, cap: int = coordination.QUEUE_CAP, key: str = "queue", payload: str = "payload") -> DataFrame:
    kind = events.schema[payload].dataType.simpleString()

    def step(state: deque, row: dict) -> tuple[deque, dict]:
        state, taken, dropped = coordination.queue_step(state, row["action"], row[payload], cap)
        return state, {"taken": taken, "dropped": dropped, "depth": len(state)}

    return stream_fold(events, [key], ["ts", "id"], deque, step, f"taken {kind}, dropped boolean, depth int")


def hold(events: DataFrame, key: str = "slot", payload: str = "payload") -> DataFrame:
    kind = events.schema[payload].dataType.simpleString()

    def step(state: Any, row: dict) -> tuple[Any, dict | None]:
        state, taken = coordination.hold_step(state, row["action"], row[payload])
        return state, ({"taken": taken} if row["action"] == "flush" else None)

    return stream_fold(events, [key], ["ts", "id"], lambda: None, step, f"taken {kind}")


def hold_table(events: DataFrame, cap: int = coordination.HOLD_CAP, key: str = "node", slot: str = "slot", payload: str = "payload") -> DataFrame:
    kind = events.schema[payload].dataType.simpleString()

    def step(state: dict, row: dict) -> tuple[dict, dict]:
        state, taken, dropped = coordination.hold_table_step(state, row["action"], row[slot], row[payload], cap)
        return state, {"taken": taken, "dropped": dropped}

    return stream_fold(events, [key], ["ts", "id"], dict, step, f"taken {kind}, dropped boolean")


def scheduler(events: DataFrame, cap: int = timers.SCHEDULER_CAP, key: str = "node") -> DataFrame:
    def step(heap: timers.Heap, row: dict) -> tuple[timers.Heap, dict]:
        heap, fired, dropped = timers.schedule_step(heap, row["action"], row["ts_ns"], row["maturity_ns"], row["id"], cap)
        return heap, {"fired": fired, "dropped": dropped}

    return stream_fold(events, [key], ["ts_ns", "id"], list, step, "fired array<long>, dropped boolean")


def address_book(events: DataFrame, cap: int = peers.BOOK_CAP, key: str = "book", order: Sequence[str] = ("ts", "id")) -> DataFrame:
    def step(state: peers.Book, row: dict) -> tuple[peers.Book, dict]:
        state, status = peers.book_step(state, row["action"], row["peer"], row["given"], cap)
        refs, addresses = state.get(row["peer"], (0, ()))
        return state, {"status": status, "refs": refs, "addresses": list(addresses)}

    return stream_fold(events, [key], order, dict, step, "status string, refs long, addresses array<string>")


def backpressure(df: DataFrame, cap: int, window_ns: int, strikes: int = health.PRESSURE_STRIKES, key: str = "peer") -> DataFrame:
    def step(state: tuple[int | None, int], row: dict) -> tuple[tuple[int | None, int], dict]:
        overloaded = row["depth"] * 100 >= cap * health.PRESSURE_PERCENT
        state, verdict = health.backpressure_step(state, row["ts_ns"], overloaded, False, window_ns, strikes)
        return state, {"verdict": verdict}

    return stream_fold(df, [key], ["ts_ns", "id"], lambda: (None, 0), step, "verdict string")


def rtt_ema(samples: DataFrame, key: str = "site", sample: str = "sample_ns", order: Sequence[str] = ("seq",)) -> DataFrame:
    def step(state: tuple[int, int, int] | None, row: dict) -> tuple[tuple[int, int, int], dict]:
        state = health.rtt_step(state, int(row[sample]))
        return state, {"srtt": state[0], "rttvar": state[1], "budget_ns": state[0] + 4 * state[1], "warm": state[2] >= health.WARM_SAMPLES}

    return stream_fold(samples, [key], order, lambda: None, step, "srtt long, rttvar long, budget_ns long, warm boolean")


def dedup_count_window(df: DataFrame, by: str, key: str, size: int = health.DEDUP_WINDOW) -> DataFrame:
    def step(state: OrderedDict, row: dict) -> tuple[OrderedDict, dict | None]:
        state, new = health.dedup_window_step(state, row[key], size)
        return state, ({"passed": True} if new else None)

    return stream_fold(df, [by], ["ts", "id"], OrderedDict, step, "passed boolean")


def first_arrival(df: DataFrame, group: Sequence[str], ts: str, lateness: str = "1 hour") -> DataFrame:
    """The first row of each group within the watermark; its state leaves with the watermark."""
    return df.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(group))


def incr_metric(df: DataFrame, key: str = "name", delta: str | None = None) -> DataFrame:
    """Running totals, for the update or complete mode."""
    return df.groupBy(key).agg(F.sum(F.col(delta) if delta else F.lit(1)).cast("long").alias("total"))


def counts_by_window(df: DataFrame, ts: str, width: str, key: str, lateness: str = "1 day") -> DataFrame:
    """Tumbling counts that close when the watermark passes."""
    return df.withWatermark(ts, lateness).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"))


def gate(values: DataFrame, triggers: DataFrame, on: str, ts: str, within: str = "1 hour") -> DataFrame:
    """Values whose trigger comes within an interval around them: a stream-stream join with bounded state."""
    v = values.withWatermark(ts, within).alias("v")
    t = triggers.select(F.col(on).alias("_on"), F.col(ts).alias("_ts")).withWatermark("_ts", within)
    near = (F.col("_ts") >= F.col(f"v.{ts}") - F.expr(f"INTERVAL {within}")) & (F.col("_ts") <= F.col(f"v.{ts}") + F.expr(f"INTERVAL {within}"))
    return v.join(t, (F.col(f"v.{on}") == F.col("_on")) & near).drop("_on", "_ts")
