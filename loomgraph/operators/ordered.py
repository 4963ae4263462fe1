"""Folds that go through each key's rows in order, for results that depend on the result before."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_in_order(rows: DataFrame, key: str, order: list[str], start: Callable[[dict[str, Any]], Any], step: Callable[[Any, dict[str, Any]], tuple[Any, Any]], field: str) -> DataFrame:
    """rows with one more column (`name type`): what step(state, row) -> (state, value) gives for each row of a key, in order.

    start(row) makes the state from a key's first row. Rows are numbered within their key by a window first: so a key's rows lie behind one
    another in one task, sorted (and spilled) by Spark, whatever rows is made of. A repartition alone would not do: it is left out where
    rows come from a join by the key, and Spark may then read that join's shuffle in other parts. Rows are read batch by batch: the state is
    all that is held of a key, however many rows it has.
    """
    name, kind = field.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seen = None, 0
        for b in batches:
            nth, b = b.column("__nth").to_pylist(), b.drop_columns(["__nth"])
            values = []
            for n, row in zip(nth, b.to_pylist(), strict=True):
                if n == 1:
                    state = start(row)
                elif n != seen + 1:
                    raise ValueError(f"row {n} of a key comes after its row {seen}")
                state, value = step(state, row)
                values.append(value)
                seen = n
            kinds = {"boolean": pa.bool_(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, kinds[kind])], [*b.schema.names, name])

    numbered = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{name}` {kind}")
