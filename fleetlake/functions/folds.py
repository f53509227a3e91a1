"""Ordered folds per key that stream: a task sees its rows in order and holds one state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
Step = Callable[[Any, tuple], tuple[Any, tuple | None]]


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], step: Step, schema: str, last: Callable[[tuple, Any], tuple | None] | None = None) -> DataFrame:
    """What ``step(state, row)`` puts out for the rows of each key in ``order``, as rows of ``schema``.

    ``state`` is None at a key's first row. A step returns the next state and a row to put
    out, or None for none; ``last(key, state)``, if given, puts out a row after each key's
    end. Rows are dealt by key and sorted; no key is gathered, so a long history costs time
    but no memory.
    """
    at = [rows.columns.index(k) for k in keys]
    fields = rows.sparkSession.createDataFrame([], schema).schema.fields
    kinds = pa.schema([pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in fields])

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, kinds.field(k).type) for k, c in enumerate(zip(*out))], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own = tuple(row[k] for k in at)
                if own != key:
                    if key is not None and last is not None and (made := last(key, state)) is not None:
                        out.append(made)
                    key, state = own, None
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            if out:
                yield table(out)
                out = []
        if key is not None and last is not None and (made := last(key, state)) is not None:
            yield table([made])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

