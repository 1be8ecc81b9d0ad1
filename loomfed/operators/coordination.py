"""Stateful coordination: limits, latches, gates, queues, holds, deadlines, records, metrics.

Each operator has a batch form that an ordered fold or a relational operator
computes; the transition functions here are the ones the streaming forms use.
Arrival order is ``(ts, id)``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import ordered_fold

#: Capacities equal to the reference's.
QUEUE_CAP = 4_096
HOLD_CAP = 1_024
RECORD_CAP = 1_024
RESERVED_PREFIXES = ("loomfed.", "infra.")


def limit_step(inflight: int, action: str, n: int) -> tuple[int, bool | None]:
    """The new number of permits in use, and whether an ``acquire`` was granted."""
    if action == "acquire":
        return (inflight + 1, True) if inflight < n else (inflight, False)
    return max(0, inflight - 1), None


def limit(events: DataFrame, n: int = 1, key: str = "name") -> DataFrame:
    """Each acquire with ``granted`` and ``inflight`` after it; a release frees a permit, down to 0."""
    def step(state: int, row: dict) -> tuple[int, dict | None]:
        state, granted = limit_step(state, row["action"], n)
        return state, {"granted": granted, "inflight": state}

    return ordered_fold(events, [key], ["ts", "id"], lambda: 0, step, "granted boolean, inflight int").filter("action = 'acquire'")


def first_arrival(df: DataFrame, group: Sequence[str], order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """The first row of each group; rows whose group is empty always pass.

    ``min`` of a struct combines on the map side, so a hot group costs one row a task.
    """
    empty = F.coalesce(F.concat_ws("", *[F.col(g).cast("string") for g in group]), F.lit("")) == ""
    keyed = df.filter(~empty)
    first = keyed.groupBy(*group).agg(F.min(F.struct(*order, *[c for c in df.columns if c not in order and c not in group])).alias("_f"))
    back = first.select(*group, "_f.*").select(*df.columns)
    return back.unionByName(df.filter(empty))


def gate(values: DataFrame, triggers: DataFrame, on: str = "exec_id") -> DataFrame:
    """Values whose trigger has come."""
    return values.join(triggers.select(on).distinct(), on, "left_semi")


def gate_dispatch(arrivals: DataFrame, inputs: int, on: str = "exec_id", input_col: str = "input", ts_col: str = "ts") -> DataFrame:
    """Executions for which all inputs have come: ``on, ready_ts``, when the last one did."""
    first = arrivals.groupBy(on, input_col).agg(F.min(ts_col).alias("_t"))
    return first.groupBy(on).agg(F.count(F.lit(1)).alias("_n"), F.max("_t").alias("ready_ts")).filter(F.col("_n") == inputs).drop("_n")


def queue_step(queue: deque, action: str, item: Any, cap: int) -> tuple[deque, Any, bool]:
    """The queue after an action, what a dequeue takes, and whether the oldest was dropped."""
    if action == "enqueue":
        queue.append(item)
        if len(queue) > cap:
            queue.popleft()
            return queue, None, True
        return queue, None, False
    return queue, (queue.popleft() if queue else None), False


def serialize(events: DataFrame, cap: int = QUEUE_CAP, key: str = "queue", payload: str = "payload") -> DataFrame:
    """First in, first out: each event with ``taken`` (dequeues), ``dropped`` (oldest, beyond ``cap``) and ``depth``."""
    kind = events.schema[payload].dataType.simpleString()

    def step(state: deque, row: dict) -> tuple[deque, dict]:
        state, taken, dropped = queue_step(state, row["action"], row[payload], cap)
        return state, {"taken": taken, "dropped": dropped, "depth": len(state)}

    return ordered_fold(events, [key], ["ts", "id"], deque, step, f"taken {kind}, dropped boolean, depth int")


def hold_step(slot: Any, action: str, item: Any) -> tuple[Any, Any]:
    """The slot after a stash or flush, and what a flush takes."""
    return (item, None) if action == "stash" else (None, slot)


def hold(events: DataFrame, key: str = "slot", payload: str = "payload") -> DataFrame:
    """Each flush with ``taken``: the last stash since the flush before, once; null if there is none."""
    flush = F.col("action") == "flush"
    w = Window.partitionBy(key).orderBy("ts", "id")
    parts = events.withColumn("_part", F.sum(flush.cast("int")).over(w) - flush.cast("int"))
    inside = Window.partitionBy(key, "_part").orderBy("ts", "id")
    stashed = F.last(F.when(~flush, F.struct(F.col(payload).alias("p"))), ignorenulls=True).over(inside)
    return parts.withColumn("taken", stashed["p"]).filter(flush).drop("_part")


def hold_table_step(slots: dict, action: str, slot: Any, item: Any, cap: int) -> tuple[dict, Any, bool]:
    """The slots after an action, what a flush takes, and whether a stash was dropped: a new slot beyond ``cap`` is."""
    if action == "flush":
        return slots, slots.pop(slot, None), False
    if slot not in slots and len(slots) >= cap:
        return slots, None, True
    slots[slot] = item
    return slots, None, False


def hold_table(events: DataFrame, cap: int = HOLD_CAP, key: str = "node", slot: str = "slot", payload: str = "payload") -> DataFrame:
    """The slots of a node, at most ``cap`` of them: each event with ``taken`` and ``dropped``."""
    kind = events.schema[payload].dataType.simpleString()

    def step(state: dict, row: dict) -> tuple[dict, dict]:
        state, taken, dropped = hold_table_step(state, row["action"], row[slot], row[payload], cap)
        return state, {"taken": taken, "dropped": dropped}

    return ordered_fold(events, [key], ["ts", "id"], dict, step, f"taken {kind}, dropped boolean")


def correlate_tag(df: DataFrame, *by: str) -> DataFrame:
    """A token for each row, made from the named columns, so a retry gets the same."""
    return df.withColumn("token", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in by])))


def deadline_reason(now: Column, deadline: Column) -> Column:
    """``Timeout`` from the deadline on, else null; a row without a deadline is before it."""
    return F.when(~F.coalesce(now < deadline, F.lit(True)), F.lit("Timeout"))


def deadline_check(df: DataFrame, now: Column, deadline: Column) -> tuple[DataFrame, DataFrame]:
    """Rows before their deadline, and the others with ``reason``; one table with both has :func:`deadline_reason`."""
    reason = deadline_reason(now, deadline)
    return df.filter(reason.isNull()), df.filter(reason.isNotNull()).withColumn("reason", reason)


def deadline_match(then: DataFrame, timeouts: DataFrame, on: str = "exec_id") -> DataFrame:
    """``on, winner, ts``: whichever came first; a tie goes to the result."""
    a = then.groupBy(on).agg(F.min("ts").alias("_then"))
    b = timeouts.groupBy(on).agg(F.min("ts").alias("_timeout"))
    both = a.join(b, on, "full_outer")
    won = F.col("_timeout").isNull() | (F.col("_then") <= F.col("_timeout"))
    return both.select(on, F.when(F.coalesce(won, F.lit(False)), "then").otherwise("timeout").alias("winner"), F.least("_then", "_timeout").alias("ts"))


def app_emit(df: DataFrame, name: str) -> DataFrame:
    """Rows as application events; names under a reserved prefix are refused."""
    if name.startswith(RESERVED_PREFIXES):
        raise ValueError(f"{name} is reserved")
    return df.select(F.lit(name).alias("name"), F.to_json(F.struct(*df.columns)).alias("payload"))


app_notify = app_emit


def record(df: DataFrame, cap: int = RECORD_CAP, key: str = "name", order: Sequence[str] = ("ts", "id"), names: int | None = None) -> DataFrame:
    """The last ``cap`` rows of each name; the rank is limited on the map side.

    With ``names`` only so many names have a ring, those that came first.
    """
    if names is not None:
        first = df.groupBy(key).agg(F.min(F.struct(*order)).alias("_first")).orderBy("_first", key).limit(names)
        df = df.join(first.select(key), key, "left_semi").select(*df.columns)
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")


def incr_metric(df: DataFrame, key: str = "name", delta: str | None = None) -> DataFrame:
    return df.groupBy(key).agg(F.sum(F.col(delta) if delta else F.lit(1)).cast("long").alias("total"))
