"""Recursions of many series at once: every series of a block takes its next step in one numpy operation.

Sorted partitions arrive as Arrow batches and are cut into blocks of whole series. Series of a block are laid out by length, so
the ones still running are always the first; a block costs as many vector steps as its longest series has rows, whatever
their number. The arithmetic of a series is that of the plain recursion, in the same order: composed maps would save steps of a
single long series, but round differently in the last place. A series longer than a block goes on in the next one with its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PLACE = "__place"
BLOCK_ROWS = 1 << 17

#: step(n, state, inputs) -> (state, values): rows number n of some series, one input and state entry each; NaN is null.
Step = Callable[[int, list[np.ndarray], list[np.ndarray]], tuple[list[np.ndarray], list[np.ndarray]]]


def run_block(
    place: np.ndarray, inputs: list[np.ndarray], steps: Mapping[str, tuple[int, Step]], carried: dict[str, list],
) -> dict[str, np.ndarray]:
    """Values of every step for the rows of a block; `carried` holds the state of the block's last series, before and after."""
    out = {name: np.full(len(place), np.nan) for name in steps}
    starts = np.flatnonzero(place == 1)
    if not len(starts) or starts[0] > 0:
        starts = np.concatenate([[0], starts])
    lengths = np.diff(np.append(starts, len(place)))
    groups = [(place[0], starts[:1], lengths[:1])] if place[0] > 1 else []
    rest = slice(len(groups), None)
    order = np.argsort(-lengths[rest], kind="stable")
    groups.append((1, starts[rest][order], lengths[rest][order]))
    last = starts[-1]
    for first, at, size in groups:
        if not len(at):
            continue
        # How many series are longer than t: they are a prefix.
        running = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
        mine = np.flatnonzero(at == last)
        for name, (width, step) in steps.items():
            state = [np.array([v]) for v in carried[name]] if first > 1 else [np.zeros(len(at)) for _ in range(width)]
            for t in range(size[0]):
                n = int(running[t])
                rows = at[:n] + t
                moved, values = step(int(first) + t, [s[:n] for s in state], [x[rows] for x in inputs])
                for s, m in zip(state, moved, strict=True):
                    s[:n] = m
                if values is not None:
                    out[name][rows] = values
            if len(mine):
                carried[name] = [s[mine[0]] for s in state]
    return out


def lockstep_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], steps: Mapping[str, tuple[int, Step]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Append a double column for each step, (entries of its state, step), run over each key's rows in order."""
    window = Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn(PLACE, F.row_number().over(window)).sortWithinPartitions(*keys, *order)
    kept = [f for f in placed.schema.fields if f.name != PLACE]
    schema = T.StructType(kept + [T.StructField(name, T.DoubleType()) for name in steps])
    arrow_schema = to_arrow_schema(schema)
    inputs, steps = list(inputs), dict(steps)

    def block(table: pa.Table, carried: dict, last: int) -> Iterator[pa.RecordBatch]:
        place = table.column(PLACE).to_numpy().astype(np.int64)
        if not ((np.diff(place, prepend=last) == 1) | (place == 1)).all():
            raise RuntimeError("rows of a key arrived out of order")
        values = run_block(place, [table.column(c).to_numpy().astype(float) for c in inputs], steps, carried)
        arrays = [table.column(f.name) for f in kept] + [pa.chunked_array([pa.array(v, mask=np.isnan(v))]) for v in values.values()]
        yield from pa.table([a.cast(f.type) for a, f in zip(arrays, arrow_schema, strict=True)], schema=arrow_schema).to_batches(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, 0
        carried = {name: [0.0] * width for name, (width, _) in steps.items()}
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < block_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            place = table.column(PLACE).to_numpy()
            begins = np.flatnonzero(place == 1)
            cut = int(begins[-1]) if len(begins) and begins[-1] > 0 else rows
            yield from block(table.slice(0, cut), carried, last)
            last = int(place[cut - 1])
            held, rows = table.slice(cut).to_batches(), rows - cut
        if rows:
            yield from block(pa.Table.from_batches(held).combine_chunks(), carried, last)

    return placed.mapInArrow(run, schema)
