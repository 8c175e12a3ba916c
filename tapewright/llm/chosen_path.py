"""Near duplicates by a chosen-path set similarity join over word shingles.

1. A document's set of shingle hashes gives 128 minwise tokens; documents with equal sets fall into one class, whose
   smallest id stands for it. Copies are never paired.
2. Trees. At every node a class picks two of its tokens by a hash of the node, and goes on into the two nodes named by
   them. A pair at similarity 0.8 shares a node of depth three with probability 0.94, so four independent trees miss one
   pair in 80 000. Nodes of more than `node_limit` classes branch further, up to `deepest`.
3. In a node classes are compared by short sketches of their tokens: each joins the first leader it resembles. Only these
   stars leave the node, so a group of m near copies gives about m pairs, not m squared. A node that stays large is dealt
   into blocks of `node_limit`, and the blocks' leaders are compared in the node.
4. Stars are confirmed on the full sets, read from the texts, and their links give components.
5. Classes of a node that resemble each other but are not yet connected meet: all classes of a component and all that
   resemble it are compared, full signatures first, then full sets, until they are one component or no pair is left. So no
   candidate link is lost to step 3, and pairs never leave a task unless they are links.

Defined results: no words or null text: empty set, linked with nothing. Fewer words than a shingle has: the whole sequence
is the one shingle. Rows that repeat an id are one document and get the same answer each. A null id takes part in its
class of equal sets only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import rows, text
from tapewright.llm.components import components
from tapewright.session import cut_lineage

TOKENS = 128
SKETCH = 32
BUCKETS = 1 << 18


@dataclass(frozen=True)
class Settings:
    words: int = 5
    #: A pair is linked if 100 * shared >= percent * united.
    percent: int = 80
    trees: int = 4
    depth: int = 3
    deepest: int = 9
    node_limit: int = 2048
    seed: int = 17

    @property
    def sketch_match(self) -> int:
        """Sketch positions that must agree: 4.5 deviations below what a linked pair has on average."""
        s = self.percent / 100
        return int(SKETCH * s - 4.5 * (SKETCH * s * (1 - s)) ** 0.5)

    @property
    def token_match(self) -> int:
        s = self.percent / 100
        return int(TOKENS * s - 4.5 * (TOKENS * s * (1 - s)) ** 0.5)


_XOR = text.mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).astype(np.uint32)[:, None]
_ODD = (text.mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)).astype(np.uint32) | np.uint32(1))[:, None]


def shingles(data: np.ndarray, words: int) -> np.ndarray:
    """Distinct shingle hashes of a text, in order."""
    hashes = text.words_of(data, text.SPACE, text.BYTE_FOLDED)[2]
    if not len(hashes):
        return hashes
    return np.unique(text.runs_hash(hashes, min(words, len(hashes))))


def signature(found: np.ndarray) -> np.ndarray:
    """The minwise tokens of a non-empty set."""
    least = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    low = (found >> np.uint64(17)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        least = np.minimum(least, ((low[None, at:at + 2048] ^ _XOR) * _ODD).min(axis=1))
    return least


def _nodes(matrix: np.ndarray, path: np.ndarray, levels: int) -> np.ndarray:
    """Children after so many levels: a row of node names for each row of tokens and start."""
    names = path[:, None]
    for _ in range(levels):
        h = text.mix(names + np.uint64(1))
        first = (h & np.uint64(TOKENS - 1)).astype(np.int64)
        second = (first + 1 + ((h >> np.uint64(7)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
        names = np.concatenate([
            text.mix(h ^ (np.take_along_axis(matrix, c, axis=1).astype(np.uint64) + (c.astype(np.uint64) << np.uint64(40))))
            for c in (first, second)], axis=1)
    return names


def sketches(matrix: np.ndarray) -> np.ndarray:
    """Four bits of each of the first tokens, one byte each."""
    return (matrix[:, :SKETCH] >> np.uint32(11)).astype(np.uint8) & np.uint8(15)


def sets_of(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set and its tokens (null for an empty set)."""

    def run(batches):
        for batch in batches:
            sizes, names, tokens = [], [], []
            for data in text.texts_of(batch):
                found = shingles(data, settings.words)
                sizes.append(len(found))
                if len(found):
                    a = np.bitwise_xor.reduce(text.mix(found + np.uint64(3)))
                    b = np.add.reduce(text.mix(found ^ np.uint64(0x5851F42D4C957F2D)))
                    names.append(a.tobytes() + b.tobytes())
                    tokens.append(signature(found).tobytes())
                else:
                    names.append(None)
                    tokens.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(tokens, pa.binary())],
                names=["doc_id", "n_shingles", "name", "tokens"])

    return rows.texts(docs).mapInArrow(run, "doc_id long, n_shingles long, name binary, tokens binary")


NODE = "path long, rep long, sketch binary"


def _matrix(batch: pa.RecordBatch, column: str, dtype) -> np.ndarray:
    at, data = text.binary_column(batch, column)
    return data[at[0]:at[-1]].view(dtype).reshape(len(batch), -1) if len(batch) else np.zeros((0, 1), dtype)


def _node_batch(names: np.ndarray, reps: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    short = sketches(matrix)
    packed = (short[:, ::2] | (short[:, 1::2] << np.uint8(4))).astype(np.uint8)
    each = names.shape[1]
    return pa.RecordBatch.from_arrays([
        pa.array(names.ravel().view(np.int64)), pa.array(np.repeat(reps, each)),
        pa.array([p for p in map(bytes, packed) for _ in range(each)], pa.binary())], names=["path", "rep", "sketch"])


def first_nodes(classes: DataFrame, settings: Settings) -> DataFrame:
    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                matrix = _matrix(batch, "tokens", np.uint32)
                names = [
                    _nodes(matrix, np.full(len(batch), settings.seed * 1009 + tree, np.uint64), settings.depth)
                    for tree in range(settings.trees)]
                yield _node_batch(np.concatenate(names, axis=1), batch.column(0).to_numpy(), matrix)

    return classes.select("rep", "tokens").mapInArrow(run, NODE)


def deeper_nodes(nodes: DataFrame, classes: DataFrame, levels: int) -> DataFrame:
    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                matrix = _matrix(batch, "tokens", np.uint32)
                path = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
                yield _node_batch(_nodes(matrix, path, levels), batch.column(1).to_numpy(), matrix)

    return nodes.select("path", "rep").join(classes.select("rep", "tokens"), "rep").select("path", "rep", "tokens").mapInArrow(run, NODE)


def tree_nodes(classes: DataFrame, settings: Settings) -> DataFrame:
    """(path, n_blocks, rep, sketch): nodes of two classes or more, large ones branched as far as allowed."""
    done, depth = [], settings.depth
    nodes = first_nodes(classes, settings)
    while True:
        sized = nodes.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
        joined = cut_lineage(nodes.join(sized, "path"))
        if depth >= settings.deepest or joined.where(F.col("n") > settings.node_limit).isEmpty():
            done.append(joined)
            break
        done.append(joined.where(F.col("n") <= settings.node_limit))
        nodes = deeper_nodes(joined.where(F.col("n") > settings.node_limit), classes, 2).distinct()
        depth += 2
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.withColumn("n_blocks", F.ceil(F.col("n") / settings.node_limit)).drop("n")


def _agree(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Positions at which packed sketches agree."""
    different = one ^ many
    return ((different & 15) == 0).sum(axis=1) + ((different >> 4) == 0).sum(axis=1)


def _groups(batches, key_columns: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys from sorted batches; the callers' groups are bounded."""
    key, kept = None, []
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(key_columns)], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(batch)]]).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(keys[a].tolist())
            if now != key and kept:
                yield key, pa.Table.from_batches(kept)
                kept = []
            key = now
            kept.append(batch.slice(a, b - a))
    if kept:
        yield key, pa.Table.from_batches(kept)


def _one(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


def stars(nodes: DataFrame, settings: Settings) -> DataFrame:
    """(u, v) candidates of the first round: within blocks, then among each node's leaders."""

    def run(batches):
        pairs, paths, leaders, shorts = [], [], [], []

        def batch_out():
            u, v = zip(*pairs, strict=True) if pairs else ((), ())
            n = len(pairs)
            return pa.RecordBatch.from_arrays([
                pa.array([None] * n + paths, pa.int64()), pa.array(list(u) + leaders, pa.int64()),
                pa.array(list(v) + [None] * len(paths), pa.int64()), pa.array([None] * n + shorts, pa.binary())],
                names=["path", "u", "v", "sketch"])

        for (path, _, n_blocks), table in _groups(batches, 3):
            if len(table) < 2 and n_blocks < 2:
                continue
            batch = _one(table)
            reps, short = batch.column(3).to_numpy(), _matrix(batch, "sketch", np.uint8)
            left = np.argsort(reps, kind="stable")
            while len(left):
                leader, left = left[0], left[1:]
                like = _agree(short[leader], short[left]) >= settings.sketch_match if len(left) else np.zeros(0, bool)
                pairs.extend((int(reps[leader]), int(x)) for x in reps[left[like]] if x != reps[leader])
                left = left[~like]
                if n_blocks > 1:
                    paths.append(path)
                    leaders.append(int(reps[leader]))
                    shorts.append(short[leader].tobytes())
            if len(pairs) + len(paths) > 50_000:
                yield batch_out()
                pairs, paths, leaders, shorts = [], [], [], []
        if pairs or paths:
            yield batch_out()

    def dealt(frame):
        return (
            frame.select("path", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).alias("block"), "n_blocks", "rep", "sketch")
            .repartition("path", "block").sortWithinPartitions("path", "block")
            .mapInArrow(run, "path long, u long, v long, sketch binary"))

    found = cut_lineage(dealt(nodes))
    pairs = found.where("v is not null").select("u", "v")
    while True:
        # Leaders of large nodes go up level by level; their blocks shrink until each node is one block.
        up = found.where("path is not null").select("path", F.col("u").alias("rep"), "sketch")
        if up.isEmpty():
            break
        sized = up.groupBy("path").agg(F.count("*").alias("n"))
        blocks = F.ceil(F.col("n") / settings.node_limit)
        before = found
        found = cut_lineage(dealt(up.join(sized, "path").withColumn("n_blocks", blocks)))
        pairs = pairs.unionByName(found.where("v is not null").select("u", "v"))
        if found.where("path is not null").count() >= before.where("path is not null").count():
            break  # blocks no longer shrink: the rounds across labels compare what is left
    return pairs.distinct()


def meeting_tasks(nodes: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(path, a, b, inner, rep, label, outside, own, sketch): nodes of several components, dealt into tasks.

    Both sides of a node are dealt into blocks of `node_limit`. Every block of outside classes meets every block of the
    commonest component (a = b), and every other block of outside classes (a < b, pairs across only), so blocks hide no
    pair and a task holds two blocks at most.
    """
    marked = nodes.join(labels.withColumnsRenamed({"node": "rep"}), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    sizes = marked.groupBy("path", "label").agg(F.count("*").alias("n"))
    common = sizes.groupBy("path").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n_all"), F.count("*").alias("n_labels")).where("n_labels > 1")
    blocks = lambda n: F.ceil(n / settings.node_limit)
    mixed = marked.drop("n_blocks").join(common.select(
        "path", F.col("top.label").alias("common"), blocks(F.col("top.n")).alias("n_inner"), blocks(F.col("n_all") - F.col("top.n")).alias("n_outer")), "path")
    outside = F.col("label") != F.col("common")
    own = F.pmod(F.xxhash64("rep"), F.when(outside, F.col("n_outer")).otherwise(F.col("n_inner")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    task = lambda a, b, inner: F.struct(a.alias("a"), b.alias("b"), inner.alias("inner"))
    none = F.lit(-1).cast("long")
    met_inner = F.transform(upto("n_inner"), lambda i: task(F.col("own"), F.col("own"), i))
    others = F.filter(upto("n_outer"), lambda b: b != F.col("own"))
    met_outer = F.transform(others, lambda b: task(F.least("own", b), F.greatest("own", b), none))
    inner = F.transform(upto("n_outer"), lambda a: task(a, a, F.col("own")))
    spread = mixed.withColumn("own", own).withColumn("task", F.explode(F.when(outside, F.concat(met_inner, met_outer)).otherwise(inner)))
    return spread.select("path", "task.a", "task.b", "task.inner", "rep", "label", outside.cast("long").alias("outside"), "own", "sketch")


def meetings(nodes: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """(x, target): classes that resemble another component's class in a node, each with the component to be compared with.

    In a node every class outside the commonest component names that component if it resembles one of its classes; of the
    others, the first becomes a centre for those it resembles, and so on. Two that are alike and share no centre get one. So
    a crowd costs a few rows a class, not a row a pair.
    """

    def run(batches):
        for (_, a, b, _), table in _groups(batches, 4):
            batch = _one(table)
            reps, label, out, side = (batch.column(i).to_numpy() for i in (4, 5, 6, 7))
            short = _matrix(batch, "sketch", np.uint8)
            strange = np.flatnonzero(out)
            strange = strange[np.argsort(reps[strange], kind="stable")]
            inner = np.flatnonzero(out == 0)
            top = label[inner[0]] if len(inner) else None
            # Centres: the commonest component, and strangers that resemble no earlier centre. Each goes to all it resembles.
            goes = np.zeros((len(strange), 1), bool)
            if len(inner):
                goes[:, 0] = [bool((_agree(short[i], short[inner]) >= settings.sketch_match).any()) for i in strange]
            targets, alike = [top], np.zeros((len(strange), len(strange)), bool)
            for k, i in enumerate(strange):
                alike[k] = (_agree(short[i], short[strange]) >= settings.sketch_match) & (label[strange] != label[i])
                if a != b:
                    alike[k] &= side[strange] != side[i]
                if not goes[k].any() and alike[k].any():
                    goes = np.concatenate([goes, alike[k][:, None]], axis=1)
                    goes[k, -1] = True
                    targets.append(label[i])
            for k in np.flatnonzero((goes.sum(axis=1) > 0)):
                # Two that are alike and share no centre: one goes to the other's first as well.
                apart = np.flatnonzero(alike[k, :k] & ~(goes[:k] & goes[k]).any(axis=1))
                goes[k, np.unique(goes[apart].argmax(axis=1))] = True
            pairs = {(int(reps[strange[k]]), int(targets[c])) for k, c in zip(*np.nonzero(goes), strict=True) if targets[c] != label[strange[k]]}
            if pairs:
                x, target = zip(*sorted(pairs), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(target, pa.int64())], names=["x", "target"])

    keys = ("path", "a", "b", "inner")
    return meeting_tasks(nodes, labels, settings).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "x long, target long").distinct()


def needed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and text of the wanted ids (column doc_id), and few others, before any shuffle.

    At most `BUCKETS` hash buckets of wanted ids are broadcast; where nearly all are wanted this leaves all in.
    """
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket")
    return (rows.texts(docs).withColumn("bucket", bucket)
            .join(F.broadcast(wanted.select(bucket).distinct()), "bucket", "left_semi").drop("bucket"))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int((large[at] == small).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def met(met_: DataFrame, labels: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """(u, v): a link, if there is any, for every two components of a meeting, decided on full sets.

    A meeting holds the target's classes and all that came to it. Both are dealt into blocks, and every block of the whole
    meets every block of the comers; within a task pairs are tried from the most alike on, until their components are one.
    """
    own = labels.select(F.col("node").alias("rep"), F.col("component").alias("label"))
    comers = met_.join(own.withColumnsRenamed({"rep": "x"}), "x", "left").select(
        "target", F.col("x").alias("rep"), F.coalesce("label", "x").alias("label"), F.lit(1).alias("comes"))
    targets = met_.select("target").distinct()
    alone = targets.join(own.select(F.col("label").alias("target")).distinct(), "target", "left_anti").select("target", F.col("target").alias("rep"))
    members = targets.join(own.withColumn("target", F.col("label")), "target").select("target", "rep").unionByName(alone)
    whole = cut_lineage(members.select("target", "rep", F.col("target").alias("label"), F.lit(0).alias("comes")).unionByName(comers))
    counts = whole.groupBy("target").agg(
        F.ceil(F.count("*") / settings.node_limit).alias("n_all"), F.ceil(F.sum("comes") / settings.node_limit).alias("n_comers"))
    sized = whole.join(counts, "target")

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def block(n):
        return F.pmod(F.xxhash64("rep", F.lit(5)), F.col(n))

    columns = ("target", "i", "j", "asks", "rep", "label")
    held = sized.withColumn("i", block("n_all")).withColumn("j", every("n_comers")).withColumn("asks", F.lit(0)).select(*columns)
    asking = sized.where("comes = 1").withColumn("j", block("n_comers")).withColumn("i", every("n_all")).withColumn("asks", F.lit(1)).select(*columns)
    wanted = held.unionByName(asking).withColumnRenamed("rep", "doc_id")

    def run(batches):
        key, held_, roots = None, [], {}

        def root(x):
            while roots.get(x, x) != x:
                x = roots[x]
            return x

        matrix = None
        for batch in batches:
            us, vs = [], []
            columns_ = [batch.column(c).to_pylist() for c in range(6)]
            for target, i, j, asks, rep, label, data in zip(*columns_, text.texts_of(batch), strict=True):
                if key != (target, i, j):
                    key, held_, roots, matrix = (target, i, j), [], {}, None
                found = shingles(data, settings.words)
                if not asks:
                    held_.append((rep, label, found, signature(found)))
                    continue
                if matrix is None:
                    matrix = np.stack([h[3] for h in held_]) if held_ else np.zeros((0, TOKENS), np.uint32)
                alike = (matrix == signature(found)).sum(axis=1)
                for k in np.argsort(-alike, kind="stable"):
                    if alike[k] < settings.token_match:
                        break
                    other, their, theirs, _ = held_[k]
                    if other != rep and root(their) != root(label) and _linked(found, theirs, settings.percent):
                        roots[root(their)] = root(label)
                        us.append(min(rep, other))
                        vs.append(max(rep, other))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return cut_lineage(
        wanted.join(needed_texts(docs, met_.select(F.col("x").alias("doc_id")).unionByName(whole.select(F.col("rep").alias("doc_id")))), "doc_id")
        .select("target", "i", "j", "asks", "doc_id", "label", "text")
        .repartition("target", "i", "j").sortWithinPartitions("target", "i", "j", "asks").mapInArrow(run, "u long, v long"))


def confirmed(pairs: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """Pairs that are linked, decided on full sets. A star meets its leader's text in one group; large ones in several."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(64)))
    wanted = cut_lineage(dealt.select(F.col("v").alias("doc_id"), "u", "part", F.lit(1).alias("role")).unionByName(
        dealt.select(F.col("u").alias("doc_id"), "u", "part", F.lit(0).alias("role")).distinct()))

    def check(batches):
        leader, group = None, None
        for batch in batches:
            us, vs = [], []
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for (u, part, role, v), data in zip(keys, text.texts_of(batch), strict=True):
                found = shingles(data, settings.words)
                if role == 0:
                    leader, group = found, (u, part)
                elif group == (u, part) and _linked(leader, found, settings.percent):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return cut_lineage(
        wanted.join(needed_texts(docs, wanted), "doc_id").select("u", "part", "role", F.col("doc_id"), "text")
        .repartition("u", "part").sortWithinPartitions("u", "part", "role").mapInArrow(check, "u long, v long"))


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id is its component's)."""
    settings = settings or Settings()
    sets = cut_lineage(sets_of(docs, settings))
    classes = cut_lineage(
        sets.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens")))
    nodes = cut_lineage(tree_nodes(classes.where("rep is not null"), settings))
    links = confirmed(stars(nodes, settings), docs, settings)
    labels = cut_lineage(components(links))
    found = cut_lineage(meetings(nodes, labels, settings))
    if not found.isEmpty():
        labels = components(links.unionByName(met(found, labels, docs, settings)))
    joined = sets.join(classes.select("name", "rep"), "name", "left").join(labels.withColumnsRenamed({"node": "rep"}), "rep", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of `docs`, all columns as they are, of which one of each group is left: that of the smallest id.

    Of rows that share the id one stays. Rows without words or without an id all stay.
    """
    chosen = near_duplicates(docs, settings).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept")).distinct()
    here = F.col("doc_id").cast("long")
    return (docs.where(here.isNotNull()).join(chosen, here == F.col("__kept"), "left_semi").dropDuplicates(["doc_id"])
            .unionByName(docs.where(here.isNull())))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: two-word shingles of lower-cased whole texts, links at 0.8."""
    return near_duplicates(rows.documents(spark, sf_dir), Settings(words=2))
