"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, by two small codebooks learned from a bounded sample; a pair of codes names a
cell. For a query the halves' distances to all codes are sorted, and the cells are visited in the order of the summed
distance with a heap, until they hold `wanted` vectors or none is left. The vectors of those cells are ranked by their exact
distance, in double precision, on the original vectors.

Equal vectors are one entry with its smallest ids, as many as can be among the nearest, found before the shuffle by a limit
per partition; equal query vectors are one search. A cell is dealt into blocks of `block` entries and its searches into
blocks too, so a cell that holds a third of all rows is many small tasks. What is sent to tasks: the codebooks and the number
of entries of each cell, both bounded by `codes`.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part. Vectors are compared
with those of their own length only. Rows that repeat an id are entries of their own. A null id can be found by none.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    nearest: int = 10
    #: Most codes of a half; for small tables a quarter of the entries.
    codes: int = 256
    #: Entries a search gathers at least, as a share of all and as a number. Vectors without much structure, as the given
    #: ones, need as much as this for nine in ten true neighbours; clustered ones far less.
    share: float = 0.3
    wanted: int = 1000
    #: Most vectors that the codebooks are learned from.
    sample: int = 20_000
    rounds: int = 8
    block: int = 2048
    seed: int = 5


@dataclass(frozen=True)
class Codebooks:
    """For each length of vectors, the codes of the first and of the second half."""

    halves: dict[int, tuple[np.ndarray, np.ndarray]]

    def split(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the codes of both halves; one zero code for a length that the sample lacks."""
        half = vectors.shape[1] // 2
        books = self.halves.get(vectors.shape[1]) or (np.zeros((1, half)), np.zeros((1, vectors.shape[1] - half)))
        return tuple(_distances(part, book) for part, book in zip((vectors[:, :half], vectors[:, half:]), books, strict=True))


def _distances(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances, good enough to choose codes by."""
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ codes.T + (codes**2).sum(1)[None], 0)


def _means(points: np.ndarray, count: int, settings: Settings) -> np.ndarray:
    random = np.random.default_rng(settings.seed)
    codes = points[random.choice(len(points), min(count, len(points)), replace=False)].copy()
    for _ in range(settings.rounds):
        nearest = np.concatenate([_distances(points[a:a + 4096], codes).argmin(axis=1) for a in range(0, len(points), 4096)])
        sums = np.zeros_like(codes)
        np.add.at(sums, nearest, points)
        size = np.bincount(nearest, minlength=len(codes))
        codes[size > 0] = sums[size > 0] / size[size > 0, None]
    return codes


def usable(vector: Column) -> Column:
    """No null, NaN or infinite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _by_length(vectors: list[np.ndarray]):
    sizes = np.array([len(v) for v in vectors], np.int64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, np.stack([vectors[i] for i in at]).astype(float)


def learn(entries: DataFrame, settings: Settings) -> Codebooks:
    """Codebooks from at most `sample` vectors, those with the smallest hashes."""
    count = entries.count()
    codes = max(1, min(settings.codes, count // 4))
    got = entries.orderBy(F.xxhash64("vector"), "vector").limit(settings.sample).select("vector").toArrow()["vector"].to_pylist()
    halves = {}
    for size, _, points in _by_length([np.array(v) for v in got]):
        half = size // 2
        halves[size] = (_means(points[:, :half], codes, settings), _means(points[:, half:], codes, settings))
    return Codebooks(halves)


def coded(entries: DataFrame, books: Codebooks) -> DataFrame:
    """Entries with their cell (length, code of the first half, code of the second)."""
    shared = entries.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            vectors = _vectors(batch.column(0))
            code = np.zeros((3, len(batch)), np.int32)
            for size, at, points in _by_length(vectors):
                a, b = shared.value.split(points)
                code[:, at] = np.full(len(at), size), a.argmin(axis=1), b.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, code)], names=["vector", "ids", "size", "c1", "c2"])

    return entries.select("vector", "ids").mapInArrow(run, "vector array<float>, ids array<bigint>, size int, c1 int, c2 int")


def visit(first: np.ndarray, second: np.ndarray, sizes: dict[tuple[int, int], int], wanted: int) -> list[tuple[int, int]]:
    """Cells in the order of the summed distance until they hold `wanted` entries: the multi-sequence walk with a heap."""
    one, two = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    f, s = np.sort(first).tolist(), np.sort(second).tolist()
    # A cell is followed by the next of its row, the first of a row also by the first of the next: each has one way in.
    heap, cells, held = [(f[0] + s[0], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heap[0]
        cell = (one[i], two[j])
        size = sizes.get(cell)
        if size:
            cells.append(cell)
            held += size
        if j + 1 < len(s):
            heapq.heapreplace(heap, (f[i] + s[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(f):
            heapq.heappush(heap, (f[i + 1] + s[0], i + 1, 0))
    return cells


def nearest(table: DataFrame, is_query: Column, settings: Settings | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): each query's nearest among the entries its walk gathers."""
    settings = settings or Settings()
    k = settings.nearest
    clean = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(
        usable(F.col("vector")) & F.col("id").isNotNull())
    #: A query's own row may be among the smallest ids of its entry: one more than asked for is enough.
    few = Window.partitionBy("vector").orderBy("id")
    entries = cut_lineage(
        clean.select("vector", "id").withColumn("place", F.row_number().over(few)).where(F.col("place") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    books = learn(entries, settings)
    index = cut_lineage(coded(entries, books))
    # At most codes * codes rows a length.
    sizes = {(r.size, r.c1, r.c2): r["count"] for r in index.groupBy("size", "c1", "c2").count().collect()}
    total: dict[int, int] = {}
    for (size, _, _), n in sizes.items():
        total[size] = total.get(size, 0) + n
    shared = table.sparkSession.sparkContext.broadcast((books, sizes, total))

    def walk(batches):
        books_, sizes_, total_ = shared.value
        for batch in batches:
            ask, size_, one, two, vectors = [], [], [], [], _vectors(batch.column(0))  # two: the second codes of each first
            names = batch.column(1).to_pylist()
            for size, at, points in _by_length(vectors):
                mine = {(a, b): n for (s, a, b), n in sizes_.items() if s == size}
                wanted = max(settings.wanted, int(settings.share * total_.get(size, 0)))
                first, second = books_.split(points)
                for row, i in enumerate(at.tolist()):
                    by_first: dict[int, list[int]] = {}
                    for a, b in visit(first[row], second[row], mine, wanted):
                        by_first.setdefault(a, []).append(b)
                    ask += [names[i]] * len(by_first)
                    size_ += [size] * len(by_first)
                    one += by_first
                    two += by_first.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ask, pa.int64()), pa.array(size_, pa.int32()), pa.array(one, pa.int32()), pa.array(two, pa.list_(pa.int32()))],
                names=["ask", "size", "c1", "seconds"])

    asking = cut_lineage(clean.where("asks").select("id", "vector"))
    searches = cut_lineage(asking.groupBy("vector").agg(F.min("id").alias("ask")))
    # A walk is work for a core, however few rows the searches are: they are dealt to as many tasks as a shuffle has.
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probes = cut_lineage(searches.select("vector", "ask").repartition(tasks, "ask").mapInArrow(walk, "ask long, size int, c1 int, seconds array<int>"))
    # Searches meet entries under the first code and keep to their cells there. Both sides of a code are dealt into blocks,
    # and every block of entries meets every block of searches. The counts have a row a code.
    cell = ["size", "c1"]
    n_entries = index.groupBy(*cell).agg(F.ceil(F.count("*") / settings.block).alias("entry_blocks"))
    n_probes = probes.groupBy(*cell).agg(F.ceil(F.count("*") / settings.block).alias("probe_blocks"))
    blocks = n_entries.join(n_probes, cell)

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = (index.join(blocks, cell).withColumn("b1", F.pmod(F.xxhash64("vector"), F.col("entry_blocks"))).withColumn("b2", every("probe_blocks"))
            .select(*cell, "b1", "b2", "vector", "ids", "c2"))
    right = (probes.join(blocks, cell).withColumn("b2", F.pmod(F.xxhash64("ask"), F.col("probe_blocks"))).withColumn("b1", every("entry_blocks"))
             .join(searches, "ask").select(*cell, "b1", "b2", "ask", "vector", "seconds"))

    def rank(_, entries_: pa.Table, probes_: pa.Table) -> pa.Table:
        out = {"ask": [], "entry": [], "score": []}
        if len(entries_) and len(probes_):
            mine = np.stack(_vectors(entries_["vector"].combine_chunks())).astype(float)
            ids = np.array([i[0] for i in entries_["ids"].to_pylist()])
            second = entries_["c2"].to_numpy()
            there = np.zeros(int(second.max()) + 1, bool)
            asks, seconds = probes_["ask"].to_pylist(), _vectors(probes_["seconds"].combine_chunks())
            for ask, vector, codes in zip(asks, _vectors(probes_["vector"].combine_chunks()), seconds, strict=True):
                there[:] = False
                there[codes[codes < len(there)]] = True
                inside = np.flatnonzero(there[second])
                distance = np.sqrt(((mine[inside] - vector.astype(float)) ** 2).sum(axis=1))
                best = np.lexsort((ids[inside], distance))[:k + 1]
                distance, best = distance[best], inside[best]
                out["ask"] += [ask] * len(best)
                out["entry"] += best.tolist()
                out["score"] += distance.tolist()
        return pa.table({
            "ask": pa.array(out["ask"], pa.int64()), "score": pa.array(out["score"], pa.float64()),
            "ids": entries_["ids"].combine_chunks().take(pa.array(out["entry"], pa.int64())) if out["entry"] else pa.array([], pa.list_(pa.int64()))})

    found = left.groupBy(*cell, "b1", "b2").cogroup(right.groupBy(*cell, "b1", "b2")).applyInArrow(rank, "ask long, score double, ids array<bigint>")
    ranked = Window.partitionBy("ask").orderBy("score", "vec_id")
    best = (found.select("ask", "score", F.explode("ids").alias("vec_id"))
            .withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k + 1))
    own = Window.partitionBy("query_id", "copy").orderBy("score", "vec_id")
    answers = (asking.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("vector"))).withColumnRenamed("id", "query_id")
               .join(searches, "vector").join(best.select("ask", "score", "vec_id"), "ask").where("vec_id <> query_id"))
    return (answers.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: ids divisible by 100 against every row."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(table, F.col("vec_id") % 100 == 0)
