"""Sums of large count vectors over all tasks, without one task or the driver seeing every part."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import mix

PIECE = 4_096
FAN_IN = 256
Counter = Callable[[Iterable[pa.RecordBatch]], np.ndarray]


def id_sieve(ids: DataFrame, id_col: str, count: int) -> np.ndarray:
    """Packed bits of the ids' hashes, a Bloom filter of one hash: 16 bits an id, up to 16 MB.

    It lets every id pass that is in it, and others by chance, so it only saves
    work before a join that decides.
    """
    size = 1 << min(max(16, (16 * max(count, 1)).bit_length()), 27)

    def mark(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        bits = np.zeros(size, dtype=bool)
        for batch in batches:
            bits[_places(batch.column(0).to_numpy(zero_copy_only=False), size)] = True
        return np.packbits(bits)

    return summed(ids.select(F.col(id_col).cast("long")), mark, size // 8, np.uint8, np.bitwise_or)


def _places(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def in_sieve(sieve: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the ids the sieve lets pass."""
    at = _places(ids, 8 * len(sieve))
    return (sieve[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def summed(df: DataFrame, count: Counter, length: int, kind: type = np.int64, add: np.ufunc = np.add) -> np.ndarray:
    """``count`` gives a vector of ``length`` (int64) for each task's rows; their sum (or what ``add`` makes of them).

    The vectors travel in pieces and are summed in two levels, so a task gets
    about ``FAN_IN`` parts of a piece, then one part for every ``FAN_IN``; the
    driver gets one vector.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count(batches)
        task = TaskContext.get().partitionId()
        parts = [(k // PIECE, total[k : k + PIECE].tobytes()) for k in range(0, length, PIECE) if total[k : k + PIECE].any()]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([task // FAN_IN] * len(parts), pa.int32()), pa.array([d for _, d in parts], pa.binary())], ["piece", "team", "data"])

    def merge(table: pa.Table) -> pa.Table:
        out = None
        for data in table["data"]:
            part = np.frombuffer(data.as_py(), dtype=kind)
            out = part.copy() if out is None else add(out, part)
        return pa.table({"piece": table["piece"].slice(0, 1), "team": table["team"].slice(0, 1), "data": pa.array([out.tobytes()], pa.binary())})

    schema = "piece int, team int, data binary"
    parts = df.mapInArrow(run, schema)
    teams = parts.groupBy("piece", "team").applyInArrow(merge, schema)
    whole = np.zeros(length, dtype=kind)
    for row in teams.groupBy("piece").applyInArrow(merge, schema).select("piece", F.col("data")).collect():
        part = np.frombuffer(bytes(row["data"]), dtype=kind)
        whole[row["piece"] * PIECE : row["piece"] * PIECE + len(part)] = part
    return whole
