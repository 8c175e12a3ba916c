"""Exact substring dedup by a suffix array built column by column over many documents.

The collection is inserted one symbol per member and round, from the last column to the first. A round updates the order of
the suffixes that start in its column (their last symbols in that order are the column of the collection's Burrows-Wheeler
transform) and the length of the common prefix of neighbours: suffixes are dealt stably by the inserted symbol, and the new
common prefix of two neighbours is one more than the smallest old one between them. Two arrays are read and written in
sequence each round and nothing else is kept, so memory is a few numbers per member.

Whole documents as members would need as many rounds as the longest has bytes, each over the whole corpus. Members are
therefore the anchored segments of `anchors`: a run of 200 bytes that repeats stands in the same column of both segments, so
368 rounds find every one. A suffix whose neighbour shares 200 bytes or more starts a repeated run. Batches of whole anchors
are built together; an anchor with more segments than a task should hold is settled by counted runs.

Defined results: a null text is empty. Texts under 200 bytes, and texts without repeats, stay whole. Rows that repeat a whole
row are two occurrences, so a repeated row of 200 bytes or more is removed in full in both. Null ids are kept apart by text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import anchors, rows, text
from tapewright.llm.anchors import Shape

BYTES = Shape(length=200, k=32)


def byte_values(data: np.ndarray) -> np.ndarray:
    return text.BYTE[data]


def column_order(symbols: np.ndarray, group: np.ndarray, length: int, last: int) -> np.ndarray:
    """flags[member, column] for columns below `last`: the suffix there shares `length` symbols with another of its group.

    `symbols` holds one member a row; values of 256 and more end a member and equal nothing. Members of a group are
    neighbours.
    """
    count, width = symbols.shape
    order = np.arange(count)
    common = np.zeros(count + 1, np.int32)  # common[i]: between places i - 1 and i
    flags = np.zeros((count, last), bool)
    columns = np.ascontiguousarray(symbols.T)
    base = group.astype(np.int64) * 512
    for column in range(width - 1, -1, -1):
        symbol = columns[column][order]
        key = base[order] + symbol
        dealt = np.argsort(key, kind="stable")
        sorted_key = key[dealt]
        same = (sorted_key[1:] == sorted_key[:-1]) & (symbol[dealt[1:]] < 256)
        pairs = np.empty(2 * int(same.sum()) + 1, np.int64)
        pairs[0:-1:2] = dealt[:-1][same] + 1
        pairs[1:-1:2] = dealt[1:][same] + 1
        pairs[-1] = count
        fresh = np.zeros(count + 1, np.int32)
        if len(pairs) > 1:
            fresh[1:-1][same] = np.minimum.reduceat(common, pairs)[0:-1:2] + 1
        order, common = order[dealt], fresh
        if column < last:
            long = common >= length
            flags[order[long[:-1] | long[1:]], column] = True
    return flags


def _cut(data: np.ndarray, places: np.ndarray):
    whole = data.tobytes()
    left = np.minimum(places, BYTES.reach)
    return left, [whole[p - a:p + BYTES.length] for p, a in zip(places.tolist(), left.tolist(), strict=True)]


def _build(batches):
    """Batches of whole anchors to spans; a class that repeats (extra > 1) is there for the others."""
    for batch in anchors.batched_groups(batches, 4096):
        at, left, extra = (batch.column(i).to_numpy() for i in (3, 5, 4))
        ends, data = text.binary_column(batch, "data")
        width = BYTES.reach + BYTES.length
        symbols = np.full((len(batch), width), 256, np.int16)
        size = ends[1:] - ends[:-1]
        row = np.repeat(np.arange(len(batch)), size)
        column = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0] - (BYTES.reach - left), size)
        symbols[row, column] = data[ends[0]:ends[-1]]
        anchor = batch.column(0).to_numpy()
        group = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
        flags = column_order(symbols, group, BYTES.length, BYTES.reach + 1)
        flags &= (extra == 1)[:, None]
        found, starts, stops = anchors.flagged_spans(flags, at - BYTES.reach, BYTES.length)
        yield anchors.spans_out(batch, found, starts, stops)


def _run_hashes(data: bytes) -> np.ndarray:
    return text.runs_hash(text.BYTE[np.frombuffer(data, np.uint8)], BYTES.length)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, th, start, stop): spans of bytes covered by runs of 200 that occur again; `docs` is keyed."""
    found = anchors.classified(anchors.occurrences(docs, BYTES, byte_values))
    again = found.where("n_class > 1").select(
        "id", "th", F.greatest(F.col("at") - BYTES.reach, F.lit(0)).alias("start"), F.col("at").alias("anchor_at"))
    #: The segment of an anchor ends with the text at the latest: cut where the text is at hand.
    again = again.select("id", "th", "start", (F.col("anchor_at") + BYTES.length).alias("stop"))
    alone = found.where("first = 1 and n_classes > 1").select("id", "th", "anchor", "at", "n_classes", F.col("n_class").alias("extra"))
    limit = F.lit(BYTES.group_limit)
    small = anchors.segments(alone.where(F.col("n_classes") <= limit), docs, BYTES, _cut)
    large = anchors.segments(alone.where(F.col("n_classes") > limit), docs, BYTES, _cut)
    built = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_build, anchors.SPAN)
    return again.unionByName(built).unionByName(anchors.counted_runs(large, BYTES, _run_hashes, smaller_id=False))


def with_spans(docs: DataFrame) -> DataFrame:
    keyed = anchors.keyed(docs)
    return anchors.per_document(keyed, repeated_spans(keyed))


def _cleaned(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> bytes:
    """Bytes outside the spans."""
    whole, at, kept = data.tobytes(), 0, []
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        kept.append(whole[at:a])
        at = b
    kept.append(whole[at:])
    return b"".join(kept)


def _inside(spans: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    return spans[0], np.minimum(spans[1], n)


def character_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans drawn in to whole UTF-8 characters."""
    bounds = np.flatnonzero(np.concatenate([(data & 0xC0) != 0x80, [True]]))
    a = bounds[np.searchsorted(bounds, starts)]
    b = bounds[np.searchsorted(bounds, stops, side="right") - 1]
    ok = a < b
    return a[ok], b[ok]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated runs taken out of `text`, on whole characters; `n_chars`, if there, follows the text.

    Other columns are joined back by id and text, so they are as they were.
    """
    def run(batches):
        for batch in batches:
            out = []
            for i, data in enumerate(text.texts_of(batch)):
                a, b = _inside(anchors.spans_of(batch, i), len(data))
                out.append(_cleaned(data, *character_spans(data, a, b)))
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(2)), pa.array(out, pa.binary())], names=["id", "th", "clean"])

    keyed = anchors.keyed(docs)
    spans = repeated_spans(keyed)
    touched = keyed.join(spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), ["id", "th"])
    clean = touched.select("id", "th", "text", "spans").mapInArrow(run, "id long, th long, clean binary").dropDuplicates(["id", "th"])
    marked = docs.withColumns({
        "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(anchors.LAST)),
        "__th": F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))})
    joined = marked.join(clean.withColumnsRenamed({"id": "__id", "th": "__th", "clean": "__clean"}), ["__id", "__th"], "left")
    new_text: Column = F.when(F.col("__clean").isNull(), F.col("text")).otherwise(F.col("__clean").cast("string"))
    out = joined.withColumn("text", new_text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__clean").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: what is left of every document, as digests."""

    def run(batches):
        for batch in batches:
            out = []
            for i, data in enumerate(text.texts_of(batch)):
                a, b = _inside(anchors.spans_of(batch, i), len(data))
                out.append((len(data), int((b - a).sum()), len(a), hashlib.sha256(_cleaned(data, a, b)).hexdigest()))
            n, removed, spans, sha = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_spans(rows.documents(spark, sf_dir)).mapInArrow(
        run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return found.select(F.when(F.col("id") != anchors.LAST, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
