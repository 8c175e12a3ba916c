"""A mix of sources by target weights, as output shards of fixed-length blocks; DataFrame functions only.

A source's documents stand one after another in the order of a hash and are packed into blocks of `block` words; what is left
over at the end is the source's short block. The mix is a row of slots, `shard_slots` of them a shard. Every slot of a shard
draws a source with the chance of that source's quota, so the counts of a shard are a multinomial draw. Over all shards a
source may be drawn a little more or less often than its quota: the last of its surplus draws are given to sources that lack some, so
the sums are the quotas. A source's k-th slot takes block p(k), where p is a pseudorandom permutation of the source's full
blocks, another in each pass over the source; a pass ends with the short block. The last pass stops after the quota's last
word. So each source gives its target, rounded down, and a document is taken at most one time more than whole passes.
Slots and pieces of documents are joined by (source, block).

The permutation is a swap-or-not network: in each round x pairs with key - x, and one bit, hashed from the larger of the two,
says whether they change places. It is a bijection on any number of blocks and needs no table.

Targets: sources by code point, null last, take the weights in turn and share `share` percent of all words; a target over
`most` times the source's words stops there, and the excess is shared again by weight until none is above.

Scale: texts are read once, and only thin rows are shuffled. Running sums are built in two levels, over buckets of a source's hash
range. Equal rows are counted first and laid one after another, so a repeated key stays one row in every window. Draws are
ranked inside one shard and one source.

Defined results: null and empty texts have no words and are taken nowhere; null sources are one source; rows that repeat an id
are documents of their own; an empty table, or one without words, gives no slot. Columns other than the three named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.llm.rows import documents
from tapewright.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"

#: A prime under 2**31: products of two remainders fit 64 bits.
PRIME = 2_147_483_647
#: Hashes are the first 15 hexadecimal digits of an MD5.
HASHES = 1 << 60
#: Numbers that deal intervals into cells; a table of intervals grows by this many rows at most.
CELLS = 4096


@dataclass(frozen=True)
class Settings:
    weights: Sequence[int] = (3, 1, 2)
    #: Percent of all words that the mix has, and passes over a source at most, in whole numbers.
    share: int = 150
    most: int = 2
    block: int = 256
    shard_slots: int = 8192
    rounds: int = 24
    #: Rows of a bucket of running sums.
    bucket_rows: int = 20_000
    seed: int = 11


@dataclass(frozen=True)
class Mix:
    """The parts of a mix. rows: one a document and copy; sources; slots: shard, slot and what they take; spans: the pieces in them."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    spans: DataFrame


def hashed(*parts: Column) -> Column:
    """A number under 2**60 from the MD5 of the parts, null as a word of its own."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """source, doc_id, size, h and m, the number of equal rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"),
                        word_count(text).alias("size"), hashed(F.col(id_col), F.md5(text.cast("binary"))).alias("h"))
            .groupBy("source", "doc_id", "size", "h").agg(F.count("*").alias("m")))


def _before(parts: DataFrame, keys: Sequence[str], part: str, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Sums over all earlier rows of the key, first over whole parts and then inside one."""
    totals = parts.groupBy(*keys, part).agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, part, *[F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in sums])
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (parts.join(starts, [*keys, part])
            .withColumns({name: F.col(f"_b_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()})
            .drop(*[f"_b_{name}" for name in sums]))


def source_targets(counted: DataFrame, settings: Settings) -> DataFrame:
    """source, part, source_no (from 0), source_size, weight, target and what follows from it."""
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    ranged = cut_lineage(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    turns = F.array(*[F.lit(w).cast("long") for w in settings.weights])
    numbered = cut_lineage(
        _before(ranged, [], "part", [F.col("source").asc_nulls_last()], {"source_no": F.lit(1).cast("long")})
        .withColumn("weight", turns[(F.col("source_no") % len(settings.weights)).cast("int")])
        .withColumn("cap", settings.most * F.col("source_size")))
    total = numbered.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, held = 0.0, None
    while True:
        full = F.col("weight") * F.lit(level) > F.col("cap")
        at_cap, free = numbered.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if held == (at_cap, free) or not free:
            break
        held, level = (at_cap, free), (settings.share * total / 100 - at_cap) / free
    quota, size = F.floor("target"), F.col("source_size")
    passes, rest = F.when(size > 0, F.expr("quota div source_size")).otherwise(0), F.col("quota") - F.col("passes") * size
    return (numbered.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double")))
            .withColumn("quota", quota).withColumn("passes", passes).withColumn("rest", rest)
            .withColumn("full", F.expr(f"source_size div {settings.block}")).withColumn("tail", size % settings.block)
            .withColumn("blocks", F.col("full") + F.signum("tail").cast("long"))
            .withColumn("n_slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / settings.block)))


def _cell(value: Column, width: int) -> Column:
    return F.floor(value / F.lit(width))


def within(points: DataFrame, point: str, intervals: DataFrame, start: str, length: str, upto: int) -> DataFrame:
    """Points with the interval [start, start + length) that holds them, an equality join on cells of the number line up to `upto`."""
    width = max(1, -(-upto // CELLS))
    cells = intervals.where(F.col(length) > 0).withColumn(
        "_cell", F.explode(F.sequence(_cell(F.col(start), width), _cell(F.col(start) + F.col(length) - 1, width))))
    return points.withColumn("_cell", _cell(F.col(point), width)).join(cells, "_cell").where(
        (F.col(point) >= F.col(start)) & (F.col(point) < F.col(start) + F.col(length))).drop("_cell")


def permuted(x: Column, n: Column, key: Column, settings: Settings) -> Column:
    """x of 0..n-1 under the permutation that `key` names; every row needs n > 0."""
    def lane(r, a, b):
        return (key % PRIME * (a + 2 * settings.seed) + r * b + settings.seed) % PRIME

    def swap(x, r):
        pair = (((lane(r, 48_271, 16_807) * PRIME + lane(r, 69_621, 40_692)) % n) - x + n) % n
        top = F.greatest(x, pair)
        bit = F.floor(((top % PRIME * (lane(r, 39_373, 62_089) + 1)) % PRIME + F.floor(top / F.lit(PRIME)) + r) / F.lit(1024)) % 2
        return F.when(bit == 1, pair).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(settings.rounds).cast("long")), x.cast("long"), swap)


def drawn_slots(sources: DataFrame, settings: Settings) -> DataFrame:
    """shard, slot, source_no and k: the slot is the source's k-th. Each source has its quota of slots, numbered without a gap."""
    spark = sources.sparkSession
    placed = cut_lineage(_before(sources, [], "part", [F.col("source").asc_nulls_last()], {"first_slot": F.col("n_slots")}))
    n = placed.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    shard = F.floor(F.col("slot") / F.lit(settings.shard_slots))
    at = hashed(F.lit(settings.seed), F.col("slot")) % max(1, n)
    draws = cut_lineage(within(
        spark.range(n).select(F.col("id").alias("slot"), at.alias("at")), "at",
        placed.select("source_no", "first_slot", "n_slots"), "first_slot", "n_slots", n).select(shard.alias("shard"), "slot", "source_no", "n_slots"))
    counts = draws.groupBy("source_no", "shard").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("k0", F.coalesce(F.sum("c").over(earlier), F.lit(0))).drop("c")
    inside = Window.partitionBy("source_no", "shard").orderBy("slot")
    ranked = cut_lineage(draws.join(starts, ["source_no", "shard"]).withColumn("k", F.col("k0") + F.row_number().over(inside) - 1).drop("k0"))
    surplus = F.greatest(F.lit(0), F.coalesce("drawn", F.lit(0)) - F.col("n_slots"))
    lack = F.greatest(F.lit(0), F.col("n_slots") - F.coalesce("drawn", F.lit(0)))
    balance = cut_lineage(_before(
        placed.select("source", "part", "source_no", "n_slots").join(counts.groupBy("source_no").agg(F.sum("c").alias("drawn")), "source_no", "left")
        .withColumns({"surplus": surplus, "lack": lack, "drawn": F.coalesce("drawn", F.lit(0))}),
        [], "part", [F.col("source").asc_nulls_last()], {"given": F.col("surplus"), "wanted": F.col("lack")}))
    moved = balance.agg(F.coalesce(F.sum("lack"), F.lit(0))).first()[0]
    extra = (ranked.where(F.col("k") >= F.col("n_slots")).join(balance.select("source_no", "given"), "source_no")
             .select("shard", "slot", (F.col("given") + F.col("k") - F.col("n_slots")).alias("g")))
    refilled = within(extra, "g", balance.select("source_no", "drawn", "wanted", "lack"), "wanted", "lack", moved).select(
        "shard", "slot", "source_no", (F.col("drawn") + F.col("g") - F.col("wanted")).alias("k"))
    return ranked.where(F.col("k") < F.col("n_slots")).select("shard", "slot", "source_no", "k").unionByName(refilled)


def filled_slots(draws: DataFrame, sources: DataFrame, settings: Settings) -> DataFrame:
    """shard, slot, source_no, block and words: how many words from the front of the block the slot takes."""
    turn, step = F.expr("k div blocks"), F.col("k") % F.col("blocks")
    block = F.when(F.col("i") < F.col("full"), permuted(F.col("i"), F.greatest("full", F.lit(1)), F.col("source_no") * 1009 + F.col("pass"), settings)).otherwise(F.col("full"))
    whole = F.when(F.col("i") < F.col("full"), F.lit(settings.block)).otherwise(F.col("tail"))
    cut = F.when(F.col("pass") < F.col("passes"), whole).otherwise(F.least(whole, F.col("rest") - F.col("i") * settings.block))
    return (draws.join(sources.select("source_no", "passes", "rest", "full", "tail", "blocks"), "source_no")
            .withColumns({"pass": turn, "i": step})
            .select("shard", "slot", "source_no", block.cast("long").alias("block"), cut.cast("long").alias("words")))


def mix(docs: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """The mix of all documents as thin tables; `mixed_texts` adds the words.

    A row of `rows` is a document: source, source_no, doc_id, h, copy, size and first, its first word's place in the source.
    A row of `spans` is a piece of a document in a slot: shard, slot, at (words of the slot before it), source_no, first,
    doc_id, h, copy, start (words of the document before it) and length.
    """
    settings = settings or Settings()
    counted = cut_lineage(sized(docs, id_col, text_col, source_col))
    sources = cut_lineage(source_targets(counted, settings))
    buckets = max(1, -(-counted.count() // settings.bucket_rows))
    numbered = counted.join(sources.select(F.col("source").alias("_s"), "source_no"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    runs = _before(
        numbered.withColumn("bucket", F.floor(F.col("h") / F.lit(-(-HASHES // buckets)))), ["source_no"], "bucket",
        ["h", F.col("doc_id").asc_nulls_last(), "size"], {"run": F.col("size") * F.col("m")})
    rows = cut_lineage(
        runs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
        .select("source", "source_no", "doc_id", "h", "copy", "size", (F.col("run") + F.col("copy") * F.col("size")).alias("first")))
    slots = cut_lineage(filled_slots(drawn_slots(sources, settings), sources, settings))
    last = F.col("first") + F.col("size")
    pieces = (rows.where("size > 0").select(
        "source_no", "doc_id", "h", "copy", "size", "first",
        F.explode(F.sequence(F.expr(f"first div {settings.block}"), F.expr(f"(first + size - 1) div {settings.block}"))).alias("block"))
        .withColumn("lo", F.greatest(F.col("first"), F.col("block") * settings.block))
        .withColumn("hi", F.least(last, (F.col("block") + 1) * settings.block)))
    at = F.col("lo") - F.col("block") * settings.block
    length = F.least(F.col("hi") - F.col("lo"), F.col("words") - at)
    spans = (pieces.join(slots, ["source_no", "block"]).where(length > 0)
             .select("shard", "slot", at.alias("at"), "source_no", "first", "doc_id", "h", "copy", (F.col("lo") - F.col("first")).alias("start"), length.alias("length")))
    return Mix(rows, sources, slots, spans)


def mixed_texts(mixed: Mix, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The spans of a mix with their words, joined by single spaces: shard, slot, at, doc_id, source, start, length, words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = (docs.select(F.col(source_col).cast("string").alias("_s"), F.col(id_col).cast("long").alias("_d"), text.alias("_t"))
            .withColumn("_h", hashed(F.col("_d"), F.md5(F.col("_t").cast("binary")))).dropDuplicates(["_s", "_d", "_h"]))
    named = mixed.spans.join(mixed.sources.select("source_no", "source"), "source_no")
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))
    words = F.slice(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), F.col("start").cast("int") + 1, F.col("length").cast("int"))
    return named.join(read, same).select("shard", "slot", "at", "doc_id", "source", "start", "length", F.array_join(words, " ").alias("words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: how many words of each document the mix takes."""
    mixed = mix(documents(spark, sf_dir))
    taken = mixed.spans.groupBy("source_no", "first").agg(F.sum("length").alias("taken"))
    words = mixed.rows.where("size > 0").join(taken, ["source_no", "first"], "left")
    every = words.unionByName(mixed.rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return every.join(mixed.sources.select("source_no", "source_size", "target"), "source_no").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def oracle_sql(settings: Settings | None = None) -> str:
    """The same mix in DuckDB SQL, each step over whole sources."""
    s = settings or Settings()
    digits = lambda text: f"CAST('0x' || md5({text})[1:15] AS BIGINT)"
    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(s.weights))
    lane = lambda a, b: f"((y.key % {PRIME} * ({a} + {2 * s.seed}) + r * {b} + {s.seed}) % {PRIME})"
    pair = f"((({lane(48_271, 16_807)} * {PRIME} + {lane(69_621, 40_692)}) % y.n) - y.x + y.n) % y.n"
    return f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    {digits("coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))")} AS h FROM documents),
sizes AS MATERIALIZED (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM sizes),
weighed AS MATERIALIZED (SELECT *, CASE source_no % {len(s.weights)} {weight} END AS weight, {s.most} * source_size AS cap FROM numbered),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY cap / weight, source_no) AS place FROM weighed),
levels AS MATERIALIZED (SELECT *, ({s.share} * sum(source_size) OVER () / 100 - coalesce(sum(cap) OVER earlier, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM ordered WINDOW earlier AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS MATERIALIZED (SELECT level FROM levels WHERE weight * level <= cap ORDER BY place LIMIT 1),
targets AS MATERIALIZED (SELECT w.*, least(weight * CAST(level AS DOUBLE), CAST(cap AS DOUBLE)) AS target FROM weighed w, found),
quotas AS MATERIALIZED (SELECT *, CAST(floor(target) AS BIGINT) AS quota, source_size // {s.block} AS nfull, source_size % {s.block} AS tail FROM targets),
passes AS MATERIALIZED (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes, nfull + CASE WHEN tail > 0 THEN 1 ELSE 0 END AS blocks FROM quotas),
rests AS MATERIALIZED (SELECT *, quota - passes * source_size AS rest FROM passes),
counted AS MATERIALIZED (SELECT *, passes * blocks + (rest + {s.block - 1}) // {s.block} AS n_slots FROM rests),
placed AS MATERIALIZED (SELECT *, coalesce(sum(n_slots) OVER (ORDER BY source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_slot FROM counted),
slots AS MATERIALIZED (SELECT unnest(range((SELECT sum(n_slots)::BIGINT FROM placed))) AS slot),
tossed AS MATERIALIZED (SELECT slot, {digits(f"'{s.seed}:' || slot")} % (SELECT sum(n_slots)::BIGINT FROM placed) AS place FROM slots),
draws AS MATERIALIZED (SELECT slot, source_no, n_slots, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS k
  FROM tossed JOIN placed ON place >= first_slot AND place < first_slot + n_slots),
drawn AS MATERIALIZED (SELECT p.source_no, p.n_slots, count(d.slot) AS drawn FROM placed p LEFT JOIN draws d USING (source_no) GROUP BY ALL),
balance AS MATERIALIZED (SELECT *, greatest(0, n_slots - drawn) AS lack,
  coalesce(sum(greatest(0, drawn - n_slots)) OVER earlier, 0) AS given, coalesce(sum(greatest(0, n_slots - drawn)) OVER earlier, 0) AS wanted
  FROM drawn WINDOW earlier AS (ORDER BY source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
extra AS MATERIALIZED (SELECT slot, given + k - d.n_slots AS g FROM draws d JOIN balance USING (source_no) WHERE k >= d.n_slots),
dealt AS MATERIALIZED (SELECT slot, source_no, k FROM draws WHERE k < n_slots
  UNION ALL SELECT slot, source_no, drawn + g - wanted FROM extra JOIN balance ON g >= wanted AND g < wanted + lack),
turned AS MATERIALIZED (SELECT d.slot, d.source_no, nfull, tail, passes, rest, CAST(d.k // blocks AS BIGINT) AS pass, CAST(d.k % blocks AS BIGINT) AS i
  FROM dealt d JOIN placed USING (source_no)),
swapped AS (
  SELECT slot, 0 AS r, i AS x, nfull AS n, source_no * 1009 + pass AS key FROM turned WHERE i < nfull
  UNION ALL SELECT slot, r, CASE WHEN ((greatest(x, pair) % {PRIME} * (lane + 1) % {PRIME} + greatest(x, pair) // {PRIME} + r) // 1024) % 2 = 1 THEN pair ELSE x END, n, key
  FROM (SELECT slot, r, x, n, key, {pair} AS pair, {lane(39_373, 62_089)} AS lane FROM (SELECT slot, r + 1 AS r, x, n, key FROM swapped WHERE r < {s.rounds}) y)),
filled AS MATERIALIZED (SELECT t.slot, t.source_no, CASE WHEN i < nfull THEN x ELSE nfull END AS block, CASE WHEN pass < passes THEN whole ELSE least(whole, rest - i * {s.block}) END AS words
  FROM (SELECT *, CASE WHEN i < nfull THEN {s.block} ELSE tail END AS whole FROM turned) t LEFT JOIN swapped w ON w.slot = t.slot AND w.r = {s.rounds}),
runs AS MATERIALIZED (SELECT d.*, source_no, source_size, target,
  CAST(coalesce(sum(size) OVER (PARTITION BY source_no ORDER BY h, d.doc_id NULLS LAST, size, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first
  FROM docs d JOIN placed p ON d.source IS NOT DISTINCT FROM p.source),
pieces AS MATERIALIZED (SELECT id, source_no, block, greatest(first, block * {s.block}) - block * {s.block} AS lo, least(first + size, (block + 1) * {s.block}) - block * {s.block} AS hi
  FROM (SELECT *, unnest(range(first // {s.block}, (first + size - 1) // {s.block} + 1)) AS block FROM runs WHERE size > 0)),
used AS MATERIALIZED (SELECT id, sum(least(hi - lo, words - lo)) AS taken FROM pieces JOIN filled USING (source_no, block) WHERE words > lo GROUP BY id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM runs LEFT JOIN used USING (id)
"""
