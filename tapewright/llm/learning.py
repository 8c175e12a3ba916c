"""Training in one task on a bounded sample: the driver gets the model, never the examples."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trained(examples: DataFrame, arrays: list[str], most: int, train: Callable):
    """The model that `train` makes of (arrays..., target) rows, in the order of ids.

    `examples` has doc_id, target and byte columns of int32 numbers for at most the sampled ids. Rows that repeat an id are one, the
    smallest, combined before the shuffle. In the order of the ids' hashes, documents are taken until `most` numbers are held.
    """
    one = (examples.groupBy("doc_id").agg(F.min(F.struct("target", *arrays)).alias("e")).select("doc_id", "e.*")
           .repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit(7)), "doc_id"))

    def run(batches):
        held, used = [], 0
        for batch in batches:
            ids, targets = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            columns = [batch.column(batch.schema.get_field_index(a)) for a in arrays]
            for i, (doc_id, target) in enumerate(zip(ids, targets, strict=True)):
                numbers = [np.frombuffer(c[i].as_buffer(), np.int32) for c in columns]
                used += sum(map(len, numbers))
                if used > most:
                    continue
                held.append((doc_id, *[n.copy() for n in numbers], target))
        held.sort(key=lambda e: e[0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([e[1:] for e in held]))], pa.binary())], names=["model"])

    made = one.mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else train([])
