"""Quality classifier by supervised subword embeddings.

Every word, every pair of neighbouring words and every character n-gram inside a word (its edges marked) is hashed to a
row of a learned table. A document is the average of its rows; a linear layer with softmax gives the class. Table and
layer are learned together by stochastic gradient descent in numpy, on a bounded sample of labelled rows. The layer is
linear, so for scoring each row of the table is multiplied by it once: a score is then the average of one number per
feature, the same value to rounding, and the model that travels to the tasks is one float per bucket.

The hash of a pair is taken from the difference of its words' hashes, so that all pairs of equal words share a row.

Defined results: a null or empty text, or one without words, has no feature and gets the class's bias alone. Repeated
rows are scored each. No labelled row: score 0.5 everywhere. Labels other than 0 and 1 are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import learning, rows, text


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    dimensions: int = 8
    ngrams: tuple[int, ...] = (3, 4)
    epochs: int = 6
    rate: float = 0.4
    #: Most labelled rows that are learned from.
    sample: int = 4000
    #: Most bucket numbers and counts that these may have together.
    sample_features: int = 24_000_000
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """One float per bucket (a row of the table times the layer), and the bias, both for class 1 against class 0."""

    values: np.ndarray
    bias: float
    settings: Settings


def features(data: np.ndarray, settings: Settings) -> Iterator[np.ndarray]:
    """Bucket numbers of a text, part by part."""
    shift = np.uint64(64 - settings.bits)
    previous = np.zeros(0, np.uint64)
    for a, b in text._parts(data, text.SPACE):
        part = data[a:b]
        _, _, words = text.words_of(part)
        if len(words):
            yield (words >> shift).astype(np.int32)
            chain = np.concatenate([previous, words])
            yield (text.mix(chain[1:] - chain[:-1] + np.uint64(1)) >> shift).astype(np.int32)
            previous = words[-1:]
        marked = np.concatenate([[32], part, [32]]).astype(np.uint8)
        space = text.SPACE[marked]
        values = text.BYTE[np.where(space, 32, marked)]
        for n in settings.ngrams:
            if len(marked) < n:
                continue
            h = values[:len(values) - n + 1].copy()
            for k in range(1, n):
                h *= np.uint64(text._BASE)
                h += values[k:len(values) - n + 1 + k]
            broken = space[1:len(space) - n + 2].copy()
            for k in range(2, n - 1):
                broken |= space[k:len(space) - n + 1 + k]
            yield ((h[~broken] * np.uint64(text._MULTIPLIER)) >> shift).astype(np.int32)


def counted(data: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    found = list(features(data, settings))
    ids, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
    return ids.astype(np.int32), counts.astype(np.int32)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """Stochastic gradient descent, one document a step, the rate falling to zero."""
    targets = [y for _, _, y in examples]
    share = np.clip((sum(targets) + 1) / (len(targets) + 2), 0.01, 0.99)
    random = np.random.default_rng(settings.seed)
    size = 1 << settings.bits
    table = ((random.random((size, settings.dimensions), dtype=np.float32) - 0.5) / settings.dimensions).astype(np.float32)
    layer = np.zeros((2, settings.dimensions), np.float32)
    bias = np.log(np.array([1 - share, share], np.float64))
    steps, done = settings.epochs * len(examples), 0
    for _ in range(settings.epochs):
        for i in random.permutation(len(examples)):
            ids, counts, y = examples[i]
            rate = settings.rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            weights = (counts / counts.sum()).astype(np.float32)
            rows_ = table[ids]
            mean = weights @ rows_
            logits = layer @ mean + bias
            logits -= logits.max()
            chance = np.exp(logits)
            chance /= chance.sum()
            chance[y] -= 1
            error = (-rate * chance).astype(np.float32)
            # Rows move by their share of the average, scaled up by the number of distinct rows to keep steps alike.
            push = (error @ layer) * np.float32(min(len(ids), 64))
            table[ids] = rows_ + weights[:, None] * push
            layer += np.outer(error, mean)
            bias += 0.1 * error
    values = table @ (layer[1] - layer[0]) if len(examples) else np.zeros(size, np.float32)
    return Model(values.astype(np.float32), float(bias[1] - bias[0]) if len(examples) else 0.0, settings)


def score_bytes(model: Model, data: np.ndarray) -> float:
    total, count = 0.0, 0
    for ids in features(data, model.settings):
        total += float(model.values[ids].sum(dtype=np.float64))
        count += len(ids)
    return float(1 / (1 + np.exp(-np.clip(model.bias + (total / count if count else 0.0), -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, target_col: str, settings: Settings | None = None) -> Model:
    """Learn from a bounded sample of `labels` (doc_id and the target), at most `settings.sample` ids and `settings.sample_features`
    numbers, in one task; only the model reaches the driver."""
    settings = settings or Settings()
    chosen = rows.bounded_sample(labels, "doc_id", target_col, settings.sample)
    found = rows.texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "target", "text")

    def count(batches):
        for batch in batches:
            out = [counted(t, settings) for t in text.texts_of(batch)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([i.tobytes() for i, _ in out], pa.binary()),
                pa.array([c.tobytes() for _, c in out], pa.binary())], names=["doc_id", "target", "ids", "counts"])

    examples = found.mapInArrow(count, "doc_id long, target int, ids binary, counts binary")
    return learning.trained(examples, ["ids", "counts"], settings.sample_features, lambda held: train(held, settings))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, whole texts, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([score_bytes(shared.value, t) for t in text.texts_of(batch)], pa.float64())],
                names=["doc_id", "score"])

    return rows.texts(docs).mapInArrow(run, "doc_id long, score double")


def score_column(docs: DataFrame, model: Model) -> Column:
    """The score as a column of `docs`, for filters that keep all columns as they are."""
    rows.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array([score_bytes(shared.value, t) for t in text.texts_of(batch)], pa.float64())

    return scored(F.col("text").cast("binary"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: learn where crc32(doc_id) mod 3 is not 1, score every document."""
    docs, labels = rows.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(rows.remainder("doc_id", 3) != 1), "quality")
    return score(docs, model).select(
        "doc_id", (rows.remainder("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
