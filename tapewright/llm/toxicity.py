"""Toxicity by logistic regression trained with FTRL-proximal over hashed word n-grams and skip-grams.

Features of a document are the distinct single words, pairs of neighbours and pairs one word apart, of its words in lower
case (runs of ASCII letters, digits and bytes beyond ASCII, so marks around a word hide nothing). Each weight has its own
learning rate, and the L1 term keeps most of them at exactly zero: the model that travels is the list of the others.

Defined results: a null or empty text, or one without words, has no feature and gets the bias alone. Repeated rows are
scored each. No labelled row: score 0.5 everywhere. Labels other than 0 and 1 are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import learning, rows, text

#: Everything but ASCII letters, digits and bytes beyond ASCII parts words.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    #: Large, so that words of many documents outrun those that would learn single documents by heart.
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.5
    epochs: int = 5
    #: Distances of the words in a pair: 1 for neighbours, 2 for pairs with one word between.
    distances: tuple[int, ...] = (1, 2)
    #: Most labelled rows that are learned from.
    sample: int = 12000
    #: Most bucket numbers that these may have together.
    sample_features: int = 24_000_000
    seed: int = 13


@dataclass(frozen=True)
class Model:
    """Buckets with a weight, the weights and the bias."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float
    settings: Settings

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << self.settings.bits, np.float32)
        dense[self.ids] = self.weights
        return dense


def features(data: np.ndarray, settings: Settings):
    """Bucket numbers, part by part, repeats included."""
    shift = np.uint64(64 - settings.bits)
    reach = max(settings.distances, default=0)
    tail = np.zeros(0, np.uint64)
    for a, b in text._parts(data, APART):
        _, _, words = text.words_of(data[a:b], APART, text.BYTE_FOLDED)
        if not len(words):
            continue
        yield (words >> shift).astype(np.int32)
        chain = np.concatenate([tail, words])
        for k in settings.distances:
            pairs = chain[:-k] * np.uint64(2 * k + 1) + chain[k:]
            fresh = min(len(pairs), len(words))
            yield (text.mix(pairs[len(pairs) - fresh:]) >> shift).astype(np.int32)
        tail = chain[len(chain) - min(len(chain), reach):]


def distinct(data: np.ndarray, settings: Settings) -> np.ndarray:
    found = list(features(data, settings))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def train(examples: list[tuple[np.ndarray, int]], settings: Settings) -> Model:
    size = 1 << settings.bits
    z, n = np.zeros(size), np.zeros(size)
    random = np.random.default_rng(settings.seed)
    bias = bias_n = 0.0
    s = settings
    for _ in range(s.epochs):
        for i in random.permutation(len(examples)):
            ids, y = examples[i]
            zi, ni = z[ids], n[ids]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + root) / s.alpha + s.l2))
            chance = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = chance - y
            after = ni + g * g
            z[ids] = zi + g - (np.sqrt(after) - root) / s.alpha * w
            n[ids] = after
            bias_n += g * g
            bias -= s.alpha * g / (s.beta + np.sqrt(bias_n))
    ids = np.flatnonzero(np.abs(z) > s.l1)
    w = -(z[ids] - np.sign(z[ids]) * s.l1) / ((s.beta + np.sqrt(n[ids])) / s.alpha + s.l2)
    return Model(ids.astype(np.int32), w.astype(np.float32), float(bias), settings)


def score_bytes(model: Model, table: np.ndarray, data: np.ndarray) -> float:
    hit = [ids[table[ids] != 0] for ids in features(data, model.settings)]
    ids = np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.int32)
    total = model.bias + float(table[ids].sum(dtype=np.float64))
    return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame, target_col: str, settings: Settings | None = None) -> Model:
    """Learn from a bounded sample of `labels` (doc_id and the target), at most `settings.sample` ids and `settings.sample_features`
    bucket numbers, in one task; only the model reaches the driver."""
    settings = settings or Settings()
    chosen = rows.bounded_sample(labels, "doc_id", target_col, settings.sample)
    found = rows.texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "target", "text")

    def hashed(batches):
        for batch in batches:
            out = [distinct(t, settings).tobytes() for t in text.texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "target", "ids"])

    examples = found.mapInArrow(hashed, "doc_id long, target int, ids binary")
    return learning.trained(examples, ["ids"], settings.sample_features, lambda held: train(held, settings))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, whole texts, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        table = shared.value.table()
        for batch in batches:
            out = [score_bytes(shared.value, table, t) for t in text.texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return rows.texts(docs).mapInArrow(run, "doc_id long, score double")


def score_column(docs: DataFrame, model: Model) -> Column:
    """The score as a column of `docs`, for filters that keep all columns as they are."""
    rows.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tables: list[np.ndarray] = []

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        if not tables:
            tables.append(shared.value.table())
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array([score_bytes(shared.value, tables[0], t) for t in text.texts_of(batch)], pa.float64())

    return scored(F.col("text").cast("binary"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: learn where crc32(doc_id) mod 4 is not 2, score every document."""
    docs, labels = rows.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(rows.remainder("doc_id", 4) != 2), "toxic")
    return score(docs, model).select(
        "doc_id", (rows.remainder("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))
