"""Exact substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

The text of earlier documents is the reference. It is cut into blocks, one for each anchor of `anchors`: the segments of
earlier documents around that anchor, in order of id, with an index from every run of 50 words to where it starts first. A
document is parsed against every block whose anchor it holds: from the left, the run at hand is looked up and the factor
extended word by word as far as the reference goes on alike; a factor of 50 words or more is a duplicate span. Runs across
the end of a factor, which the next factor could not show, are looked up one by one before the parse goes on. Any run of 50
words that an earlier document has holds an anchor of that document, so some block finds it.

A block is bounded: an anchor with more segments than a task should hold is settled by counted runs. Within one class of
equal segments only the first is parsed: those of later ids are duplicates in full, and its spans are laid onto the others
of its own document.

Defined results: a null text has no words. Under 50 words nothing is removed. Rows that repeat an id are one document and no
reference for each other. A null id comes after every other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm import anchors, rows, text
from tapewright.llm.anchors import Shape

WORDS = Shape(length=50, k=8)


def word_values(data: np.ndarray) -> np.ndarray:
    return text.words_of(data)[2]


def _cut(data: np.ndarray, places: np.ndarray):
    whole = word_values(data)
    left = np.minimum(places, WORDS.reach)
    return left, [whole[p - a:p + WORDS.length].tobytes() for p, a in zip(places.tolist(), left.tolist(), strict=True)]


def parse(words: np.ndarray, runs: list[int], index: dict[int, tuple[int, int]], reference: list[np.ndarray], length: int) -> list[tuple[int, int]]:
    """Factors of at least `length` words as (start, stop), greedy from the left, every run across a factor's end tried too."""
    spans, at, n = [], 0, len(runs)
    while at < n:
        hit = index.get(runs[at])
        if hit is None:
            at += 1
            continue
        member, place = hit
        other = reference[member]
        most = min(len(words) - at, len(other) - place)
        unlike = np.flatnonzero(words[at:at + most] != other[place:place + most])
        stop = at + (int(unlike[0]) if len(unlike) else most)
        spans.append((at, stop))
        # Runs that lie inside the factor are covered; those that cross its end are looked up from here on.
        at = max(at + 1, stop - length + 1)
    return spans


def _factor(batches):
    """Sorted batches (anchor, id first) of whole anchors to spans."""
    length = WORDS.length
    for batch in anchors.batched_groups(batches, 4096):
        key, ids, at, left = (batch.column(i).to_numpy() for i in (0, 1, 3, 5))
        ends, data = text.binary_column(batch, "data")
        found, starts, stops = [], [], []
        anchor, index, reference, waiting = None, {}, [], []
        for i in range(len(batch)):
            words = data[ends[i]:ends[i + 1]].view(np.uint64)
            runs = text.runs_hash(words, length).tolist()
            if key[i] != anchor:
                anchor, index, reference, waiting = key[i], {}, [], []
            if waiting and waiting[-1][0] != ids[i]:
                # The reference grows by whole documents, so nothing is measured against its own.
                for _, other, theirs in waiting:
                    for place, run in enumerate(theirs):
                        index.setdefault(run, (len(reference), place))
                    reference.append(other)
                waiting = []
            for a, b in parse(words, runs, index, reference, length) if reference else ():
                found.append(i)
                starts.append(int(at[i]) - int(left[i]) + a)
                stops.append(int(at[i]) - int(left[i]) + b)
            waiting.append((ids[i], words, runs))
        take = np.array(found, np.int64)
        spans = anchors.spans_out(batch, take, np.array(starts, np.int64), np.array(stops, np.int64))
        yield pa.RecordBatch.from_arrays([*spans.columns, pa.array(key[take]), pa.array(at[take])], names=[*spans.schema.names, "anchor", "at"])


def _run_hashes(data: bytes) -> np.ndarray:
    return text.runs_hash(np.frombuffer(data, np.uint64), WORDS.length)


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(id, th, start, stop) in words: what earlier documents have in runs of 50; `docs` is keyed."""
    whole = Window.partitionBy("anchor", "segment").orderBy("id", "th", "at")
    found = anchors.classified(anchors.occurrences(docs, WORDS, word_values)).withColumns({
        "first_th": F.first("th").over(whole), "first_at": F.first("at").over(whole)})
    later = found.where("id > first_id").select(
        "id", "th", F.greatest(F.col("at") - WORDS.reach, F.lit(0)).alias("start"), (F.col("at") + WORDS.length).alias("stop"))
    own = found.where("id = first_id and n_classes > 1")
    one = own.where("first = 1").select("id", "th", "anchor", "at", "n_classes", F.lit(1).cast("long").alias("extra"))
    limit = F.lit(WORDS.group_limit)
    small = anchors.segments(one.where(F.col("n_classes") <= limit), docs, WORDS, _cut)
    large = anchors.segments(one.where(F.col("n_classes") > limit), docs, WORDS, _cut)
    parsed = small.repartition("anchor").sortWithinPartitions("anchor", "id", "th", "at").mapInArrow(_factor, anchors.SPAN + ", anchor long, at long")
    spans = parsed.unionByName(anchors.counted_runs(large, WORDS, _run_hashes, smaller_id=True, placed=True))
    # The key is a struct, never null: so no filter goes below the windows and all branches share one exchange.
    key = F.struct("anchor", "id", F.col("first_th").alias("th"), F.col("first_at").alias("at")).alias("key")
    again = own.where("first = 0").select(key, "id", "th", (F.col("at") - F.col("first_at")).alias("shift"))
    laid = again.join(spans.select(F.struct("anchor", "id", "th", "at").alias("key"), "start", "stop"), "key").select(
        "id", "th", (F.col("start") + F.col("shift")).alias("start"), (F.col("stop") + F.col("shift")).alias("stop"))
    return later.unionByName(spans.select("id", "th", "start", "stop")).unionByName(laid)


def with_spans(docs: DataFrame) -> DataFrame:
    keyed = anchors.keyed(docs)
    return anchors.per_document(keyed, duplicate_spans(keyed))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: what is left of every document, as digests."""

    def run(batches):
        for batch in batches:
            out = []
            for i, data in enumerate(text.texts_of(batch)):
                words = data.tobytes().split()
                a, b = anchors.spans_of(batch, i)
                b = np.minimum(b, len(words))
                kept, at = [], 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    kept += words[at:x]
                    at = y
                kept += words[at:]
                out.append((len(words), int((b - a).sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, removed, sha = zip(*out, strict=True) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                names=["id", "n_words", "n_removed", "kept_sha256"])

    found = with_spans(rows.documents(spark, sf_dir)).mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string")
    return found.select(F.when(F.col("id") != anchors.LAST, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")
