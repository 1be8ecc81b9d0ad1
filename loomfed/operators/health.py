"""Link health: gates, back-off, governor, round-trip times, failure detection, back-pressure."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import ordered_fold

#: Fixed values equal to the reference's.
DEDUP_WINDOW = 8_192
BACKOFF_BASE_NS = 10_000_000
BACKOFF_CAP_NS = 60_000_000_000
DOWN_AFTER = 5
PHI_GAPS = 1_000
PHI_SUSPECT, PHI_DOWN = 8.0, 16.0
PRESSURE_PERCENT = 75
PRESSURE_STRIKES = 3
WARM_SAMPLES = 3


def dedup_gate(df: DataFrame, keys: Sequence[str] = ("src_peer", "payload"), order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """The first row of each key; an aggregate with a map side, for any number of repeats."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(*keys, "_f.*").select(*df.columns)


def dedup_window_step(seen: OrderedDict, key: object, size: int) -> tuple[OrderedDict, bool]:
    """Whether a key is new among the last ``size`` distinct ones, first in, first out."""
    if key in seen:
        return seen, False
    seen[key] = None
    if len(seen) > size:
        seen.popitem(last=False)
    return seen, True


def dedup_count_window(df: DataFrame, by: str, key: str, size: int = DEDUP_WINDOW) -> DataFrame:
    """The exact count-window gate: rows that are new among the last ``size`` keys of their receiver."""
    def step(state: OrderedDict, row: dict) -> tuple[OrderedDict, dict | None]:
        state, new = dedup_window_step(state, row[key], size)
        return state, ({"passed": True} if new else None)

    return ordered_fold(df, [by], ["ts", "id"], OrderedDict, step, "passed boolean").drop("passed")


def _as_of(attempts: DataFrame, state: DataFrame) -> DataFrame:
    """``attempts`` with ``_next``: what the last row of ``state`` up to each attempt's time says.

    ``state``: ``peer, ts_ns, next_retry_ns``, null where a success clears it; at
    one time the state comes first.  One sorted pass a peer, in bounded memory.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in attempts.columns])
    asked = attempts.select("peer", F.col("ts_ns").alias("_ts"), F.lit(1).alias("_kind"), row.alias("_row"), F.lit(None).cast("struct<at:bigint>").alias("_state"))
    known = state.select("peer", F.col("ts_ns").alias("_ts"), F.lit(0).alias("_kind"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.struct(F.col("next_retry_ns").cast("long").alias("at")).alias("_state"))
    past = Window.partitionBy("peer").orderBy("_ts", "_kind", F.col("_state.at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = asked.unionByName(known).withColumn("_last", F.last("_state", ignorenulls=True).over(past))
    return met.filter("_kind = 1").select("_row.*", F.col("_last.at").alias("_next"))


def peer_health_gate(df: DataFrame, blocklist: DataFrame, allowlist: DataFrame | None = None, backoff_state: DataFrame | None = None) -> DataFrame:
    """Each row with ``reason``: null passes.  Order: blocked, not allowed, then (sending only) cooling.

    With ``backoff_state`` (``peer, ts_ns, next_retry_ns``) a row is compared
    with its peer's state at the row's ``ts_ns``, and ``retry_ns`` says when a
    cooling peer may be tried again.
    """
    out = df if backoff_state is None else _as_of(df, backoff_state)
    out = out.join(blocklist.select("peer", F.lit(True).alias("_blocked")).distinct(), "peer", "left")
    reason = F.when(F.col("_blocked"), F.lit("Blocked"))
    if allowlist is not None:
        out = out.join(allowlist.select("peer", F.lit(True).alias("_allowed")).distinct(), "peer", "left")
        reason = reason.when(F.col("_allowed").isNull(), F.lit("NotAllowed"))
    if backoff_state is not None:
        reason = reason.when(F.col("ts_ns") < F.col("_next"), F.lit("Cooldown"))
        out = out.withColumn("reason", reason).withColumn("retry_ns", F.when(F.col("reason") == "Cooldown", F.col("_next")))
    else:
        out = out.withColumn("reason", reason)
    return out.drop("_blocked", "_allowed", "_next")


def streaks(df: DataFrame, key: str = "peer", ok_col: str = "ok", order: Sequence[str] = ("ts_ns", "id")) -> DataFrame:
    """Adds ``streak``: failures in a row up to each event, 0 at a success."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.col(ok_col).cast("int")).over(w)
    grouped = df.withColumn("_island", island)
    inside = Window.partitionBy(key, "_island").orderBy(*order)
    return grouped.withColumn("streak", F.sum((~F.col(ok_col)).cast("int")).over(inside).cast("int")).drop("_island")


def backoff_delay(streak: Column, base_ns: int = BACKOFF_BASE_NS, cap_ns: int = BACKOFF_CAP_NS) -> Column:
    """``min(base * 2 ** (n - 1), cap)``, 0 without a failure; the exponent stops where the cap is reached."""
    top = math.ceil(math.log2(cap_ns / base_ns)) + 1
    power = F.pow(F.lit(2.0), F.least(streak - 1, F.lit(top)))
    return F.when(streak <= 0, F.lit(0)).otherwise(F.least(F.lit(float(base_ns)) * power, F.lit(float(cap_ns)))).cast("long")


def backoff(df: DataFrame, advisory: str | None = None) -> DataFrame:
    """Adds ``streak, delay_ns, next_retry_ns``; a remote advisory delay counts up to the cap."""
    out = streaks(df)
    delay = backoff_delay(F.col("streak"))
    if advisory:
        delay = F.greatest(delay, F.least(F.coalesce(F.col(advisory), F.lit(0)), F.lit(BACKOFF_CAP_NS)))
    return out.withColumn("delay_ns", delay).withColumn("next_retry_ns", F.col("ts_ns") + F.col("delay_ns"))


def backoff_gate(attempts: DataFrame, state: DataFrame) -> DataFrame:
    """Attempts whose peer may be tried at their time; ``state``: ``peer, ts_ns, next_retry_ns``, null for a success."""
    return _as_of(attempts, state).filter(F.col("_next").isNull() | (F.col("ts_ns") >= F.col("_next"))).drop("_next")


def governor(df: DataFrame, down_after: int = DOWN_AFTER) -> DataFrame:
    """Changes of a peer's health: ``peer, ts_ns, id, state``; a peer begins ``up``."""
    state = F.when(F.col("streak") >= down_after, "down").otherwise("up")
    w = Window.partitionBy("peer").orderBy("ts_ns", "id")
    marked = streaks(df).withColumn("state", state).withColumn("_was", F.lag("state", 1, "up").over(w))
    return marked.filter("state <> _was").select("peer", "ts_ns", "id", "state")


def rtt_step(state: tuple[int, int, int] | None, sample: int) -> tuple[int, int, int]:
    """Smoothed time, variation and number of samples, in integers with shifts of 1/8 and 1/4."""
    if state is None:
        return sample, sample // 2, 1
    srtt, var, n = state
    delta = abs(sample - srtt)
    return srtt - (srtt >> 3) + (sample >> 3), var - (var >> 2) + (delta >> 2), n + 1


def rtt_ema(df: DataFrame, key: str = "site", sample: str = "sample_ns", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Adds ``srtt, rttvar, budget_ns, warm`` after each sample; the budget is ``srtt + 4 rttvar``."""
    def step(state: tuple[int, int, int] | None, row: dict) -> tuple[tuple[int, int, int], dict]:
        state = rtt_step(state, row[sample])
        srtt, var, n = state
        return state, {"srtt": srtt, "rttvar": var, "budget_ns": srtt + 4 * var, "warm": n >= WARM_SAMPLES}

    return ordered_fold(df, [key], order, lambda: None, step, "srtt long, rttvar long, budget_ns long, warm boolean")


def estimate_budget(requests: DataFrame, levels: Sequence[tuple[str, DataFrame]], static_ns: int) -> DataFrame:
    """Adds ``budget_ns``: the first level with an estimate, most special first, else the static one.

    A level is a column of ``requests`` and a table ``key, budget_ns``.
    """
    out, found = requests, []
    for k, (column, table) in enumerate(levels):
        out = out.join(table.select(F.col("key").alias(f"_k{k}"), F.col("budget_ns").alias(f"_b{k}")), F.col(column) == F.col(f"_k{k}"), "left")
        found.append(F.col(f"_b{k}"))
    out = out.withColumn("budget_ns", F.coalesce(*found, F.lit(static_ns)))
    return out.drop(*[f"_{c}{k}" for k in range(len(levels)) for c in "kb"])


def phi_accrual(df: DataFrame, key: str = "peer", ts: str = "ts_ns", order: Sequence[str] = ("ts_ns", "id"), gaps: int = PHI_GAPS) -> DataFrame:
    """Adds ``gap`` and ``phi``: the gap over the mean of the gaps before it, times ``1 / ln 10``."""
    w = Window.partitionBy(key).orderBy(*order)
    gapped = df.withColumn("gap", F.col(ts) - F.lag(ts).over(w))
    mean = F.avg("gap").over(w.rowsBetween(-gaps, -1))
    return gapped.withColumn("phi", F.when(mean > 0, F.col("gap") / (mean * F.lit(math.log(10)))).otherwise(0.0))


def scan_phi(df: DataFrame, key: str = "peer", order: Sequence[str] = ("ts_ns", "id")) -> DataFrame:
    """Changes of state by the thresholds: ``up``, ``suspect``, ``down``."""
    phi = F.coalesce(F.col("phi"), F.lit(0.0))
    state = F.when(phi > PHI_DOWN, "down").when(phi > PHI_SUSPECT, "suspect").otherwise("up")
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("state", state).withColumn("_was", F.lag("state", 1, "up").over(w)).filter("state <> _was").drop("_was")


def backpressure_step(state: tuple[int | None, int], ts: int, overloaded: bool, recovered: bool, window_ns: int, strikes: int) -> tuple[tuple[int | None, int], str]:
    """The last notice and the notices sent, and what happens to the message.

    The notice that reaches ``strikes`` is still sent; after it everything is
    dropped until the peer recovers.
    """
    last, sent = (None, 0) if recovered else state
    if not overloaded:
        return (last, sent), "pass"
    if sent >= strikes:
        return (last, sent), "drop"
    if last is not None and ts < last + window_ns:
        return (last, sent), "suppress"
    return (ts, sent + 1), "notice"


def backpressure(df: DataFrame, cap: int, window_ns: int, strikes: int = PRESSURE_STRIKES, key: str = "peer", recovered: str | None = None) -> DataFrame:
    """Adds ``verdict``: ``pass`` below three quarters of ``cap``, else a notice, silence within its window, or a drop."""
    def step(state: tuple[int | None, int], row: dict) -> tuple[tuple[int | None, int], dict]:
        overloaded = row["depth"] * 100 >= cap * PRESSURE_PERCENT
        state, verdict = backpressure_step(state, row["ts_ns"], overloaded, bool(recovered and row[recovered]), window_ns, strikes)
        return state, {"verdict": verdict}

    return ordered_fold(df, [key], ["ts_ns", "id"], lambda: (None, 0), step, "verdict string")


def request_tracker(requests: DataFrame, responses: DataFrame, now_ns: int, ttl_ns: int) -> DataFrame:
    """Each request with ``rtt_ns`` and ``status``: ``done``, ``inflight`` or ``stale``; the first answer counts."""
    first = responses.groupBy("req_id").agg(F.min("ts_ns").alias("_answer"))
    out = requests.join(first, "req_id", "left")
    status = F.when(F.col("_answer").isNotNull(), "done").when(F.lit(now_ns) - F.col("ts_ns") >= ttl_ns, "stale").otherwise("inflight")
    return out.withColumn("rtt_ns", F.col("_answer") - F.col("ts_ns")).withColumn("status", status).drop("_answer")


def outbound_queue(events: DataFrame, cap: int | None, key: str = "peer", order: Sequence[str] = ("ts_ns", "id")) -> DataFrame:
    """Each push with ``status`` and ``drained_by``: a drain takes all that is queued, oldest first.

    ``events``: ``action`` is ``push`` or ``drain``, and rows have an ``id``.
    Beyond ``cap`` the oldest goes (``dropped``); what no drain has taken yet is
    ``queued``.  Between two drains the newest ``cap`` pushes stay.
    """
    w = Window.partitionBy(key).orderBy(*order)
    drain = F.col("action") == "drain"
    marked = events.withColumn("_part", F.sum(drain.cast("int")).over(w) - drain.cast("int"))
    last_first = Window.partitionBy(key, "_part").orderBy(drain.cast("int"), *[F.desc(c) for c in order])
    whole = Window.partitionBy(key, "_part")
    out = marked.withColumn("_r", F.row_number().over(last_first)).withColumn("drained_by", F.max(F.when(drain, F.col("id"))).over(whole))
    kept = F.lit(True) if cap is None else F.col("_r") <= cap
    status = F.when(~kept, "dropped").when(F.col("drained_by").isNull(), "queued").otherwise("shipped")
    out = out.filter(~drain).withColumn("status", status)
    return out.withColumn("drained_by", F.when(F.col("status") == "shipped", F.col("drained_by"))).drop("_part", "_r")
