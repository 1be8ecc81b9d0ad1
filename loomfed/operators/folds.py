"""Ordered folds: the batch form of operators whose state depends on arrival order.

Rows are dealt by key and sorted within partitions, and a worker walks them
with the state of one key at a time.  No group is gathered: memory is one
Arrow batch and one state, whatever a key's number of rows.  The same
transition functions drive the streaming forms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Step = Callable[[Any, dict], tuple[Any, dict | None]]


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], init: Callable[[], Any], step: Step, out: str) -> DataFrame:
    """Each row with the columns that ``step(state, row)`` gives it; rows it gives None for go.

    ``out`` names the new columns as DDL.  ``order`` should be a total order.
    """
    added = T._parse_datatype_string(out)
    schema = T.StructType([*df.schema.fields, *added.fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in added.fields]
    keys = list(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, init()
                state, new = step(state, row)
                if new is not None:
                    rows.append(row | {n: new.get(n) for n in names})
            if rows:
                yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
