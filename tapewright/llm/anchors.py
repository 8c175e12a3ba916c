"""Anchored segments: what the two operators on repeated substrings share.

A sequence of symbols (bytes or words) is sampled by content: a position is an anchor if the hash of its k symbols is the
smallest in some window of positions, the leftmost of equals. Whatever the place, a run of `length` equal symbols holds the
same anchor at the same offset, so two occurrences of a run meet under that anchor's hash, and only the segment around it
matters: what a run of `length` symbols through the anchor can reach. About 2 in (length - k) positions are anchors.

Occurrences with the same segment form a class (equal hashes of anchor and segment, 128 bits). A class that repeats is
settled at once; classes that differ and share an anchor go, one segment each, to the operator's own method. An anchor with
more than `group_limit` classes is settled by counting the hashes of its runs instead, so no task holds an unbounded group.

Documents are keyed by id and a hash of the text, so rows that repeat an id or a whole row keep apart and all come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm import text
from tapewright.llm.rows import bounded_batches

#: Symbols whose anchors are searched at once; also the range of positions that ties are broken in.
PART = 1 << 20
#: Stands for a null id: after every other.
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Shape:
    #: Symbols of a run that counts, and of an anchor.
    length: int
    k: int
    group_limit: int = 20_000

    @property
    def reach(self) -> int:
        return self.length - self.k


def keyed(docs: DataFrame) -> DataFrame:
    """id (null last), a hash of the text, and the text as bytes; nothing else of the input."""
    bounded_batches(docs.sparkSession)
    content = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(content).alias("th"), content.alias("text"))


def anchors_of(values: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, anchor hashes and segment hashes (with the room on the left) of a sequence of scrambled values."""
    n, width, low = len(values), shape.reach + 1, np.uint64(PART - 1)
    found: dict[str, list] = {"at": [], "anchor": [], "segment": []}
    last = -1
    for start in range(0, n - shape.length + 1, PART - shape.length):
        a, b = max(0, start - shape.reach), min(n, start + PART + shape.reach)
        part = values[a:b]
        power, inverse = text.powers(len(part))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part * power, out=sums[1:])
        s0, s1 = start - a, min(n, start + PART) - a
        count = s1 - s0 - shape.k + 1
        hashes = text.mix((sums[s0 + shape.k:s1 + 1] - sums[s0:s0 + count]) * inverse[s0:s0 + count])
        least = text.sliding((hashes & ~low) | np.arange(count, dtype=np.uint64), width, np.minimum)
        if not len(least):
            continue
        chosen = (least[np.concatenate([[True], least[1:] != least[:-1]])] & low).astype(np.int64)
        chosen = chosen[chosen + start > last]
        if not len(chosen):
            continue
        last = int(chosen[-1]) + start
        left = np.maximum(chosen + s0 - shape.reach, 0)
        right = np.minimum(chosen + s0 + shape.length, len(part))
        whole = (sums[right] - sums[left]) * inverse[left] + (chosen + s0 - left).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        found["at"].append(chosen + start)
        found["anchor"].append(hashes[chosen])
        found["segment"].append(text.mix(whole + (right - left).astype(np.uint64)))
    empty = np.zeros(0, np.uint64)
    at, anchor, segment = (np.concatenate(found[x]) if found[x] else empty for x in ("at", "anchor", "segment"))
    return at.astype(np.int64), anchor, segment


def occurrences(docs: DataFrame, shape: Shape, symbols: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, th, at, anchor, segment) for every anchor of every document."""

    def run(batches):
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = [anchors_of(symbols(t), shape) for t in text.texts_of(batch)]
            sizes = [len(p[0]) for p in parts]
            if sum(sizes):
                at, anchor, segment = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(ths, sizes)), pa.array(at),
                    pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64))], names=["id", "th", "at", "anchor", "segment"])

    return docs.mapInArrow(run, "id long, th long, at long, anchor long, segment long")


def classified(found: DataFrame) -> DataFrame:
    """Anchors that occur more than once: with n_class (occurrences of the class), first_id (its smallest id), first (one
    row of each class) and n_classes (of the anchor). One shuffle, one sort; windows spill, so a hot anchor fits anywhere."""
    anchor = Window.partitionBy("anchor")
    whole = Window.partitionBy("anchor", "segment")
    order = whole.orderBy("id", "th", "at")
    return (
        found.repartition("anchor")
        .withColumn("first", (F.row_number().over(order) == 1).cast("int"))
        .withColumn("n_class", F.count("*").over(whole)).withColumn("first_id", F.min("id").over(whole))
        .withColumn("n_anchor", F.count("*").over(anchor)).withColumn("n_classes", F.sum("first").over(anchor))
        .where("n_anchor > 1"))


def segments(wanted: DataFrame, docs: DataFrame, shape: Shape, cut: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, list[bytes]]]) -> DataFrame:
    """The segment of each wanted occurrence: (anchor, id, th, at, extra, left, data); `left` symbols lie before the anchor.

    Occurrences are gathered per document (their number is bounded by its length) and meet the text once.
    """
    per_document = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "at", "extra")).alias("items"))

    def run(batches):
        def out():
            for batch in batches:
                ids, ths, items = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
                for i, data in enumerate(text.texts_of(batch)):
                    mine = items[i].values
                    anchor, at, extra = (mine.field(x) for x in ("anchor", "at", "extra"))
                    places = at.to_numpy()
                    left, kept = cut(data, places)
                    yield from zip(anchor.to_pylist(), [ids[i]] * len(kept), [ths[i]] * len(kept), at.to_pylist(), extra.to_pylist(), left.tolist(), kept, strict=True)

        schema = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("at", pa.int64()), ("extra", pa.int64()), ("left", pa.int64()), ("data", pa.binary())])
        yield from text.record_batches(out(), schema)

    return docs.join(per_document, ["id", "th"]).select("id", "th", "items", "text").mapInArrow(
        run, "anchor long, id long, th long, at long, extra long, left long, data binary")


def batched_groups(batches, limit: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches dealt anew so that each holds whole anchors, about `limit` rows together."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(0).to_numpy()
        if kept and size >= limit:
            cuts = np.flatnonzero(keys != kept[-1].column(0)[-1].as_py())
            if len(cuts):
                if cuts[0]:
                    kept.append(batch.slice(0, int(cuts[0])))
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, size, batch = [], 0, batch.slice(int(cuts[0]))
        kept.append(batch)
        size += len(batch)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


SPAN = "id long, th long, start long, stop long"


def spans_out(batch: pa.RecordBatch, rows_: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
    take = pa.array(rows_)
    return pa.RecordBatch.from_arrays(
        [batch.column(batch.schema.get_field_index("id")).take(take), batch.column(batch.schema.get_field_index("th")).take(take),
         pa.array(starts.astype(np.int64)), pa.array(stops.astype(np.int64))], names=["id", "th", "start", "stop"])


def flagged_spans(flags: np.ndarray, base: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged run starts in each row as (row, start, stop), counted from each row's base."""
    edged = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    edged[:, 1:-1] = flags
    change = np.diff(edged, axis=1)
    row, a = np.nonzero(change == 1)
    _, b = np.nonzero(change == -1)
    return row, base[row] + a, base[row] + b - 1 + length


def counted_runs(found: DataFrame, shape: Shape, runs: Callable[[bytes], np.ndarray], smaller_id: bool, placed: bool = False) -> DataFrame:
    """Spans for anchors with very many classes: runs of `length` symbols are counted by hash, combined before the shuffle.

    With `placed`, the anchor and its place `at` come with each span.
    """

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                row = one.to_pylist()[0]
                hashes = runs(row["data"])
                n = len(hashes)
                if n:
                    starts = row["at"] - row["left"] + np.arange(n)
                    same = lambda x, n=n: pa.array(np.full(n, x, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [same(row["anchor"]), pa.array(starts - row["at"]), pa.array(hashes.view(np.int64)), same(row["id"]), same(row["th"]), pa.array(starts), same(row["extra"])],
                        names=["anchor", "offset", "run", "id", "th", "start", "extra"])

    each = found.mapInArrow(run, "anchor long, offset long, run long, id long, th long, start long, extra long")
    counts = each.groupBy("anchor", "offset", "run").agg(F.sum("extra").alias("n"), F.min("id").alias("first_id"))
    hit = each.join(counts, ["anchor", "offset", "run"]).where("id > first_id" if smaller_id else "n > 1")
    place = ["anchor", (F.col("start") - F.col("offset")).alias("at")] if placed else []
    return hit.select("id", "th", "start", (F.col("start") + shape.length).alias("stop"), *place)


def per_document(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, th, text, spans): every row of the input with its spans, null where it has none."""
    gathered = spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return docs.join(gathered, ["id", "th"], "left").select("id", "th", "text", "spans")


def spans_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    value = batch.column(batch.schema.get_field_index("spans"))[i]
    if not value.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return text.merge_spans(value.values.field("start").to_numpy(), value.values.field("stop").to_numpy())
