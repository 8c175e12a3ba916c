"""Ranked lexical search by pipelined term partitioning.

The terms of all items are dealt to owners by how common they are: the first owner has the rarest, the last the most common ones. Documents are numbered in
blocks. For each block and each chunk of items there is a bundle: the items' terms and, for each item, a sparse accumulator
of documents and integer scores. The bundles pass through the owners' stages one after another. At a stage a cogroup brings a
bundle together with the owner's postings of that block; their contributions are added and the bundle goes on. After the
last stage each block names its best documents by score and id, and the best of all blocks are the answer.

Between stages an item's documents are let go only where they can't be among the best any more: where the score so far
and the largest possible contributions of all later owners stay below a score that `best` documents of one block have
already. Contributions are never negative, so the result is that of the full sum.

Scale: each text is read once, by Arrow batches, and leaves as its count of terms and those terms that may be an item's: a
bitmap of fixed size (`bits`) is broadcast and lets all item terms through, whatever their number; the join on the term
itself is exact. Document frequencies combine before the shuffle. A block holds at most `block_rows` documents and a chunk about
`chunk_items` items, which bounds a cogroup; a posting goes to the chunks that hold its term.

Defined results: null and empty texts have no terms, count nowhere and are never found; items without terms get no rows.
Rows that repeat a doc_id are documents of their own; ties go to the smaller doc_id, null last. Rows that repeat an item_id
are one item with the terms of all of them. Texts of any length are counted in parts. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm import rows
from tapewright.session import cut_lineage

#: Bytes of terms: digits, letters and all of UTF-8 beyond ASCII. Capitals A-Z are folded, other bytes part terms.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

#: Fixed values of the score.
IMPACT, TF_SCALE, LENGTH_SCALE, LENGTH_SHARE, WEIGHT = 1_000_000_000, 1000, 20, 50, 1000


@dataclass(frozen=True)
class Settings:
    best: int = 50
    owners: int = 4
    block_rows: int = 8192
    chunk_items: int = 256
    #: Length of the bitmap of item terms.
    bits: int = 1 << 22
    #: Bytes of a text that are cut into terms at once.
    part: int = 1 << 20


def count_terms(text: memoryview | bytes, part: int = 1 << 20) -> Counter:
    """How often each term occurs; long texts are cut at separators."""
    text = bytes(text)
    if len(text) <= part:
        return Counter(text.translate(_FOLDED).split())
    counts, start = Counter(), 0
    while start < len(text):
        end = start + part
        while end < len(text) and _FOLDED[text[end]] != 32:
            end += 1
        counts.update(text[start:end].translate(_FOLDED).split())
        start = end
    return counts


def _values(column: pa.Array) -> list[bytes]:
    """Byte strings, null as empty, one at a time."""
    return (b"" if not x.is_valid else x.as_buffer() for x in column)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): each item's terms once."""
    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), _values(batch.column(1)), strict=True):
                terms = list(count_terms(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(terms), pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])

    return rows.texts(items, id_col, text_col).select(F.col("doc_id").alias("item_id"), "text").mapInArrow(run, "item_id long, term binary").distinct()


def counted_documents(docs: DataFrame, bitmap: bytes, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n, terms, tfs): a numbered row for each document with a term; only terms that the bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    bits, part = settings.bits, settings.part

    def run(batches):
        allowed = shared.value
        for batch in batches:
            ids, n, terms, tfs, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column(0).to_pylist(), _values(batch.column(1)), strict=True):
                counts = count_terms(text, part)
                if counts:
                    ids.append(doc_id)
                    n.append(counts.total())
                    for term, tf in counts.items():
                        at = crc32(term) % bits
                        if allowed[at >> 3] >> (at & 7) & 1:
                            terms.append(term)
                            tfs.append(tf)
                    ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.binary())),
                pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    counted = rows.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, terms array<binary>, tfs array<long>")
    return counted.withColumn("row", F.monotonically_increasing_id())


def _bitmap(terms: DataFrame, bits: int) -> bytes:
    """One bit for each remainder of a term's CRC; at most `bits` numbers reach the driver, as the bytes of the bitmap."""
    filled = bytearray(bits >> 3)
    places = terms.select((F.crc32("term") % bits).alias("at")).groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(
        F.expr("bit_or(shiftleft(1, CAST(at % 8 AS INT)))").alias("mask"))
    for r in places.toLocalIterator():
        filled[r.byte] = r.mask
    return bytes(filled)


def weighed_terms(terms: DataFrame, docs: DataFrame, n_docs: int, settings: Settings) -> DataFrame:
    """(term, number, w, bound, owner, chunks): weight, largest contribution, owner's stage and the chunks that hold the term."""
    seen = docs.select(F.explode(F.arrays_zip("terms", "tfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(
        F.count("*").alias("df"), F.max("t.tfs").alias("tf"))
    held = terms.groupBy("term").agg(F.sort_array(F.collect_set("chunk")).alias("chunks"))
    w = F.floor(F.lit(float(WEIGHT)) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    bound = F.col("w") * F.expr(f"({IMPACT} * tf) div ({TF_SCALE} * tf + {LENGTH_SCALE * (100 - LENGTH_SHARE)})")
    # A step of four in the share of documents is one owner; the last has terms in over a quarter of them.
    rarity = F.floor(F.log(F.lit(float(n_docs)) / F.col("df")) / F.log(F.lit(4.0)))
    return (held.join(seen, "term").withColumn("w", w).withColumn("bound", bound)
            .withColumn("owner", F.greatest(F.lit(0), settings.owners - 1 - rarity).cast("int"))
            .withColumn("number", F.monotonically_increasing_id()))


def postings(docs: DataFrame, weighed: DataFrame, n_docs: int, n_terms: int, settings: Settings) -> DataFrame:
    """(owner, chunk, block, doc, number, c): what a term adds to a document's score, for every chunk that holds the term."""
    m = F.expr(f"{100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {n_docs}L) div {n_terms}L")
    c = F.col("w") * F.expr(f"({IMPACT} * tf) div ({TF_SCALE} * tf + {LENGTH_SCALE} * m)")
    each = docs.select("row", m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(
        "row", "m", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    return (each.join(weighed, "term").withColumn("c", c).where("c > 0")
            .select("owner", F.explode("chunks").alias("chunk"), *_place(settings), "number", "c"))


def _place(settings: Settings):
    """Block of a numbered row, and its place there."""
    return F.floor(F.col("row") / settings.block_rows).alias("block"), (F.col("row") % settings.block_rows).cast("int").alias("doc")


BUNDLE = "chunk int, block long, item_id long, numbers array<long>, owners array<int>, bounds array<long>, docs array<int>, scores array<long>"
_KEPT = {"chunk": pa.int32(), "block": pa.int64(), "item_id": pa.int64(), "numbers": pa.list_(pa.int64()), "owners": pa.list_(pa.int32()), "bounds": pa.list_(pa.int64())}
_GROWN = {"docs": pa.list_(pa.int32()), "scores": pa.list_(pa.int64())}


def _array(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    flat = column.combine_chunks()
    return flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False).astype(kind)


def stage(owner: int, settings: Settings):
    """One owner adds its contributions to the bundles of a block."""
    def run(bundles: pa.Table, posted: pa.Table) -> pa.Table:
        if not len(bundles):
            return pa.schema([*_KEPT.items(), *_GROWN.items()]).empty_table()
        number = posted["number"].to_numpy()
        order = np.argsort(number, kind="stable")
        number, doc, c = number[order], posted["doc"].to_numpy()[order], posted["c"].to_numpy()[order]
        at, numbers = _array(bundles["numbers"], np.int64)
        _, owners = _array(bundles["owners"], np.int32)
        _, bounds = _array(bundles["bounds"], np.int64)
        had, docs = _array(bundles["docs"], np.int32)
        _, scores = _array(bundles["scores"], np.int64)
        enough = bundles["enough"].fill_null(0).to_numpy()
        out_docs, out_scores, ends = [], [], [0]
        for i in range(len(bundles)):
            total = np.zeros(settings.block_rows, np.int64)
            total[docs[had[i]:had[i + 1]]] = scores[had[i]:had[i + 1]]
            mine = slice(at[i], at[i + 1])
            for t in numbers[mine][owners[mine] == owner].tolist():
                a, b = np.searchsorted(number, [t, t + 1])
                total[doc[a:b]] += c[a:b]
            kept = np.flatnonzero(total)
            held = total[kept]
            to_come = int(bounds[mine][owners[mine] > owner].sum())
            reach = int(enough[i])
            if len(held) >= settings.best:
                reach = max(reach, int(np.partition(held, len(held) - settings.best)[len(held) - settings.best]))
            good = held + to_come >= reach
            out_docs.append(kept[good].astype(np.int32))
            out_scores.append(held[good])
            ends.append(ends[-1] + int(good.sum()))
        ends = pa.array(ends, pa.int32())
        return pa.table({
            **{name: bundles[name].cast(kind) for name, kind in _KEPT.items()},
            "docs": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out_docs))),
            "scores": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out_scores)))})
    return run


def selected(settings: Settings):
    """The best documents of a block for each item of a bundle, with their ids."""
    def run(bundles: pa.Table, documents: pa.Table) -> pa.Table:
        items, found, scores = [], [], []
        if len(bundles):
            ids = np.full(settings.block_rows, np.iinfo(np.int64).max)
            known = np.zeros(settings.block_rows, bool)
            place = documents["doc"].to_numpy()
            ids[place] = documents["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            known[place] = documents["doc_id"].is_valid().to_numpy()
            had, docs = _array(bundles["docs"], np.int32)
            _, total = _array(bundles["scores"], np.int64)
            for i, item in enumerate(bundles["item_id"].to_pylist()):
                mine, score = docs[had[i]:had[i + 1]], total[had[i]:had[i + 1]]
                top = np.lexsort((ids[mine], -score))[:settings.best]
                items += [item] * len(top)
                found += [v if k else None for v, k in zip(ids[mine][top].tolist(), known[mine][top].tolist(), strict=True)]
                scores += score[top].tolist()
        return pa.table({"item_id": pa.array(items, pa.int64()), "doc_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.int64())})
    return run


def enough(bundles: DataFrame, settings: Settings) -> DataFrame:
    """(item_id, enough): the largest score that `best` documents of one block have."""
    last = F.when(F.size("scores") >= settings.best, F.sort_array("scores", asc=False)[settings.best - 1])
    return bundles.groupBy("item_id").agg(F.max(last).alias("enough"))


def search(
    docs: DataFrame, items: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's best documents."""
    settings = settings or Settings()
    terms = cut_lineage(item_terms(items, item_col, item_text_col))
    chunks = max(1, -(-terms.select("item_id").distinct().count() // settings.chunk_items))
    terms = terms.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.lit(chunks)).cast("int"))
    counted = cut_lineage(counted_documents(docs, _bitmap(terms, settings.bits), settings, id_col, text_col))
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weighed = cut_lineage(weighed_terms(terms, counted, max(1, n_docs), settings))
    posted = cut_lineage(postings(counted, weighed.drop("df", "tf"), n_docs, max(1, n_terms), settings))
    asked = terms.join(weighed, "term").groupBy("item_id", "chunk").agg(F.collect_list(F.struct("number", "owner", "bound")).alias("t"))
    places = counted.select(_place(settings)[0]).distinct().withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    bundles = places.join(asked, "chunk").select(
        "chunk", "block", "item_id", F.col("t.number").alias("numbers"), F.col("t.owner").alias("owners"), F.col("t.bound").alias("bounds"),
        F.array().cast("array<int>").alias("docs"), F.array().cast("array<long>").alias("scores"))
    reached = None
    for owner in range(settings.owners):
        if reached is None:
            told = bundles.withColumn("enough", F.lit(None).cast("long"))
        else:
            told = bundles.join(reached.withColumnRenamed("item_id", "_i"), F.col("item_id").eqNullSafe(F.col("_i"))).drop("_i")
        mine = posted.where(F.col("owner") == owner).select("chunk", "block", "doc", "number", "c")
        bundles = cut_lineage(told.groupBy("chunk", "block").cogroup(mine.groupBy("chunk", "block")).applyInArrow(stage(owner, settings), BUNDLE))
        reached = enough(bundles, settings)
    named = counted.select(*_place(settings), "doc_id").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    found = bundles.select("chunk", "block", "item_id", "docs", "scores").groupBy("chunk", "block").cogroup(named.groupBy("chunk", "block")).applyInArrow(
        selected(settings), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.best).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the fifty best documents for each benchmark item."""
    return search(rows.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle_sql(best: int = 50) -> str:
    terms = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
    return f"""
WITH cut AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {terms} AS terms FROM documents),
sizes AS MATERIALIZED (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM cut WHERE len(terms) > 0),
held AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM cut) GROUP BY ALL),
asked AS MATERIALIZED (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
weights AS MATERIALIZED (SELECT term, CAST(floor({WEIGHT} * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, sizes WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
lengths AS (SELECT id, doc_id, {100 - LENGTH_SHARE} + ({LENGTH_SHARE} * len(terms) * n_docs) // n_terms AS m FROM cut, sizes),
scored AS (SELECT item_id, id, doc_id, CAST(sum(w * (({IMPACT} * tf) // ({TF_SCALE} * tf + {LENGTH_SCALE} * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN lengths USING (id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {best}
"""
