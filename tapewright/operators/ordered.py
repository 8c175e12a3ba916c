"""Stateful pass over each key's rows in order, for recursions that no window frame expresses.

Partitions are hashed by key and sorted, then streamed to Python as Arrow batches; the state of the current key
is carried over batch borders, so memory is one batch however long a key's history is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Step = Callable[..., tuple]
ROW = "__row_in_key"


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    outputs: Sequence[T.StructField],
    new_state: Callable[[], Step],
) -> DataFrame:
    """Append `outputs`; `new_state()` gives a fresh step function at the first row of every key.

    The row number makes Spark shuffle and sort by key (shared with neighbouring windows), marks where a key
    starts, and lets the pass refuse rows that arrive out of order.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn(ROW, F.row_number().over(window)).sortWithinPartitions(*keys, *order)
    schema = T.StructType([f for f in placed.schema.fields if f.name != ROW] + list(outputs))
    arrow_schema = to_arrow_schema(schema)
    names = [f.name for f in outputs]
    inputs = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step: Step | None = None
        last = 0
        for batch in batches:
            places = batch.column(ROW).to_pylist()
            columns = [batch.column(c).to_pylist() for c in inputs]
            results = []
            for place, *values in zip(places, *columns):
                if place == 1:
                    step = new_state()
                elif place != last + 1:
                    raise RuntimeError("rows of a key arrived out of order")
                last = place
                results.append(step(*values))
            if not results:
                continue
            made = list(zip(*results))
            arrays = [batch.column(f.name) for f in schema.fields if f.name not in names]
            arrays += [pa.array(v, type=arrow_schema.field(n).type) for n, v in zip(names, made)]
            yield pa.RecordBatch.from_arrays(
                [a.cast(arrow_schema.field(i).type) for i, a in enumerate(arrays)], schema=arrow_schema
            )

    return placed.mapInArrow(run, schema)
