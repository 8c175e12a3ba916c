"""Embedding whitening by spectrum slicing.

Entries become integers, floor(256 * entry). The covariance is taken over the distinct integer vectors, centred first, divided by
their number. Its leading eigenvalues are isolated one by one: an LDL' factorisation of the shifted covariance (symmetric pivots of
one or two rows) has as many positive pivots as there are eigenvalues above the shift, so halving an interval by such counts
ends with exactly one eigenvalue inside. Rayleigh quotient iteration from the interval's middle converges cubically; a quotient
that leaves the interval is refused and the middle taken again. Two more counts, just below and above the value found,
certify that it is the k-th. Equal eigenvalues, which no shift can part, share an interval and get orthogonal vectors.

Scale: a task sends one row of sums a dimension, whatever its rows; those are added in two levels. Only the model is gathered
and broadcast: for each length of vectors the sums, and a few vectors of that length. The rows are read twice.

Defined results: null vectors and vectors with null or non-finite entries take no part. Zero vectors do. Vectors are compared
with those of their own length only; an empty vector has no component. A vector shorter than the wanted components has as many as entries. A
component whose eigenvalue is zero up to rounding has no whitened value (null) and explains 0, null where nothing varies;
`identity_error` is over the others, null without any. Integers beyond 64 bits are cut to the largest. `deviation` is a decimal
here, exact to 38 digits, null beyond. Rows that repeat an id, or have none, are returned each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tapewright.session import cut_lineage

EPS = float(np.finfo(float).eps)
#: Entries of vectors that are held as doubles at once.
PART = 1 << 20
#: Partial sums that one task adds.
FAN_IN = 64


@dataclass(frozen=True)
class Eigen:
    """A leading eigenvalue: `above` eigenvalues lie over value + margin, `at_least` over value - margin, by counts."""

    value: float
    vector: np.ndarray
    margin: float
    above: int
    at_least: int


@dataclass(frozen=True)
class Space:
    """The model of one length of vectors."""

    n: int
    sums: tuple[int, ...]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def live(self) -> np.ndarray:
        """Which components have an eigenvalue above rounding."""
        return self.values > len(self.mean) * EPS * max(self.trace, 0.0)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        scale = np.where(self.live, np.sqrt(np.where(self.live, self.values, 1.0)), np.nan)
        return centred @ self.vectors / scale


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues above the shift: positive pivots of an LDL' factorisation with pivots of one or two rows."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, positive = len(a), 0, 0
    alpha = (1 + 17**0.5) / 8

    def swap(i, j):
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        wide = False
        if k + 1 < n:
            column = np.abs(a[k + 1:, k])
            r = k + 1 + int(column.argmax())
            largest = column[r - k - 1]
            if largest and abs(a[k, k]) < alpha * largest:
                row = np.abs(a[k:, r])
                row[r - k] = 0
                other = row.max()
                if abs(a[k, k]) * other < alpha * largest**2:
                    wide = abs(a[r, r]) < alpha * other
                    swap(k + wide, r)
        if wide:
            block, below = a[k:k + 2, k:k + 2].copy(), a[k + 2:, k:k + 2].copy()
            positive += 1  # such a block has a negative determinant: one eigenvalue of each sign
            a[k + 2:, k + 2:] -= below @ np.linalg.solve(block, below.T)
            k += 2
        else:
            pivot, below = a[k, k], a[k + 1:, k].copy()
            positive += bool(pivot > 0)
            if pivot:
                a[k + 1:, k + 1:] -= np.outer(below, below / pivot)
            k += 1
    return positive


def _refine(matrix: np.ndarray, low: float, high: float, halved, found: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """The eigenvalue inside (low, high) and its vector, orthogonal to the ones found.

    An eigenvalue lies within the residual of a quotient: where that range is inside the interval, the quotient is the next shift.
    """
    d = len(matrix)
    v = np.random.default_rng(len(found.T)).standard_normal(d)
    shift, best = (low + high) / 2, (np.inf, 0.0, v)
    for _ in range(200):
        try:
            w = np.linalg.solve(matrix - shift * np.eye(d), v)
        except np.linalg.LinAlgError:
            w = np.linalg.solve(matrix - (shift + 4 * EPS * scale) * np.eye(d), v)
        for _ in range(2):
            w = w - found @ (found.T @ w)
        length = np.linalg.norm(w)
        if not np.isfinite(length) or not length:
            shift = shift + 4 * EPS * scale
            continue
        v = w / length
        value = float(v @ matrix @ v)
        left = float(np.linalg.norm(matrix @ v - value * v))
        if low <= value - left and value + left <= high:
            if left >= best[0] / 2 and best[0] <= 64 * d * EPS * scale:
                break  # no longer improving
            if left < best[0]:
                best = (left, value, v)
            shift = value
        else:
            low, high = halved(low, high)
            shift = (low + high) / 2
    return best[1], best[2]


def leading(matrix: np.ndarray, wanted: int) -> list[Eigen]:
    """The largest eigenvalues of a symmetric positive semidefinite matrix, numbered by counts."""
    d = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0  # no eigenvalue is larger
    if not scale:
        return [Eigen(0.0, np.eye(d)[k], 0.0, 0, d) for k in range(min(wanted, d))]
    least = 16 * d * EPS * scale
    seen = {-least - scale * 1e-3: d, scale * 1.001: 0}  # counts above the shifts tried

    def count(shift):
        if shift not in seen:
            seen[shift] = count_above(matrix, shift)
        return seen[shift]

    def halved(low, high, k):
        """The half with the k-th eigenvalue, with a margin; an interval near rounding stays."""
        middle = (low + high) / 2
        if high - low <= 4 * least:
            return low, high
        return (middle - least, high) if count(middle) >= k else (low, middle + least)

    out, found = [], np.zeros((d, 0))
    for k in range(1, min(wanted, d) + 1):
        low = max(s for s, c in seen.items() if c >= k)
        high = min(s for s, c in seen.items() if c < k)
        while (count(low) != k or count(high) != k - 1) and high - low > least:
            middle = (low + high) / 2
            if count(middle) >= k:
                low = middle
            else:
                high = middle
        value, vector = _refine(matrix, low - least, high + least, lambda a, b, k=k: halved(a, b, k), found, scale)
        vector = vector * (1 if vector[np.abs(vector).argmax()] > 0 else -1)
        found = np.column_stack([found, vector])
        above, at_least = count_above(matrix, value + least), count_above(matrix, value - least)
        if not above < k <= at_least:
            raise ArithmeticError(f"eigenvalue {k} is not certified: {above} above it, {at_least} at least")
        out.append(Eigen(value, vector, least, above, at_least))
    return sorted(out, key=lambda e: -e.value)  # equal ones may have come in either order


def integers(vector: Column) -> Column:
    """floor(256 * entry) as long; null for vectors that take no part."""
    v = vector.cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(v.isNotNull() & sound, F.transform(v, lambda c: F.floor(c * 256.0)))


def _matrices(batch: pa.RecordBatch):
    """Row numbers and vectors of a batch, by length and in parts."""
    column = batch.column(batch.schema.get_field_index("x"))
    ends = column.offsets.to_numpy()
    flat, first = column.values.to_numpy(zero_copy_only=False), ends[:-1]
    size = np.diff(ends)
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        step = max(1, PART // max(1, d))
        for i in range(0, len(at), step):
            some = at[i:i + step]
            yield d, some, flat[first[some][:, None] + np.arange(d)[None]]


def _exact_sums(x: np.ndarray) -> list[int]:
    top = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    return (x if top * len(x) < 1 << 62 else x.astype(object)).sum(axis=0).tolist()


def _deviations(x: np.ndarray, space: Space) -> pa.Array:
    """Sum over dimensions of (n * x - S)^2, in Python integers where 64 bits may not do."""
    reach = space.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, space.sums))
    wide = reach * reach * x.shape[1] >= 1 << 63
    off = space.n * (x.astype(object) if wide else x) - np.array(space.sums, object if wide else np.int64)
    total = (off * off).sum(axis=1)
    if not wide:
        return pa.array(total).cast(pa.decimal128(38, 0))
    return pa.array([t if t < 10**38 else None for t in total.tolist()], pa.decimal128(38, 0))


SUMS = "size int, i int, n long, s decimal(38,0)"
ROWS = "size int, i int, task int, row array<double>"
MOMENTS = "size int, task int, n long, mean array<double>, square array<double>"


def partial_sums(batches):
    held: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        for d, at, x in _matrices(batch):
            n, s = held.get(d, (0, [0] * d))
            held[d] = (n + len(at), [a + b for a, b in zip(s, _exact_sums(x), strict=True)])
    for d, (n, s) in held.items():
        yield pa.RecordBatch.from_arrays([
            pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(s, pa.decimal128(38, 0))],
            names=["size", "i", "n", "s"])


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def partial_products(means):
    """Sums of centred products of a task, a row a dimension."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _matrices(batch):
                if d:
                    y = x.astype(float) - means.value[d]
                    held[d] = held.get(d, 0.0) + y.T @ y
        task = TaskContext.get().partitionId()
        for d, g in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([task] * d, pa.int32()), _lists(g)],
                names=["size", "i", "task", "row"])
    return run


def added(table: pa.Table) -> pa.Table:
    """One row from the partial rows of a dimension, added in the order of tasks."""
    table = table.sort_by("task")
    total = np.stack(table["row"].combine_chunks().values.to_numpy().reshape(len(table), -1)).sum(axis=0)
    return pa.table({"size": table["size"][:1], "i": table["i"][:1], "task": pa.array([table["task"][0].as_py() // FAN_IN], pa.int32()), "row": _lists(total[None])})


def solved(wanted: int):
    """The covariance of one length gives its leading components."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        d, n = len(table), table["n"][0].as_py()
        v = table["row"].combine_chunks().values.to_numpy().reshape(d, d) / n
        v = (v + v.T) / 2
        got = leading(v, wanted)
        return pa.table({
            "size": pa.array([d] * len(got), pa.int32()), "component": pa.array(range(1, len(got) + 1), pa.int32()),
            "value": pa.array([e.value for e in got]), "vector": _lists(np.stack([e.vector for e in got])),
            "trace": pa.array([float(np.trace(v))] * len(got)), "above": pa.array([e.above for e in got], pa.int32()),
            "at_least": pa.array([e.at_least for e in got], pa.int32())})
    return run


def _joined(a, b):
    """Number, mean and centred products of two sets together."""
    if not a[0]:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def partial_moments(spaces):
    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for d, at, x in _matrices(batch):
                if d:
                    space = spaces.value[d]
                    w = space.whiten(x.astype(float) - space.mean)[:, space.live]
                    mean = w.mean(axis=0)
                    held[d] = _joined(held.get(d, (0,)), (len(at), mean, (w - mean).T @ (w - mean)))
        task = TaskContext.get().partitionId()
        for d, (n, mean, square) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d], pa.int32()), pa.array([task], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())),
                 pa.array([square.ravel().tolist()], pa.list_(pa.float64()))], names=["size", "task", "n", "mean", "square"])
    return run


def joined_moments(table: pa.Table) -> pa.Table:
    table, held = table.sort_by("task"), (0,)
    for r in table.to_pylist():
        k = len(r["mean"])
        held = _joined(held, (r["n"], np.array(r["mean"], float), np.array(r["square"], float).reshape(k, k)))
    return pa.table({
        "size": table["size"][:1], "task": pa.array([table["task"][0].as_py() // FAN_IN], pa.int32()), "n": pa.array([held[0]], pa.int64()),
        "mean": pa.array([held[1].tolist()], pa.list_(pa.float64())), "square": pa.array([held[2].ravel().tolist()], pa.list_(pa.float64()))})


def fit(clean: DataFrame, components: int) -> dict[int, Space]:
    """A model for each length of vectors in column x."""
    context = clean.sparkSession.sparkContext
    distinct = cut_lineage(clean.select("x").distinct())
    sums = distinct.mapInArrow(partial_sums, SUMS).groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    counted = {r.size: (r.n, tuple(int(x.s) for x in r.sums)) for r in sums.groupBy("size").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "s"))).alias("sums")).collect()}
    means = {d: np.array([s / n for s in total]) for d, (n, total) in counted.items()}
    products = distinct.mapInArrow(partial_products(context.broadcast(means)), ROWS)
    some = products.withColumn("part", F.floor(F.col("task") / FAN_IN)).groupBy("size", "i", "part").applyInArrow(added, ROWS)
    rows = some.groupBy("size", "i").applyInArrow(added, ROWS).join(sums.select("size", "i", "n"), ["size", "i"]).select("size", "i", "n", "row")
    model = rows.groupBy("size").applyInArrow(
        solved(components), "size int, component int, value double, vector array<double>, trace double, above int, at_least int").collect()
    spaces = {}
    for d in {r.size for r in model}:
        mine = sorted((r for r in model if r.size == d), key=lambda r: r.component)
        spaces[d] = Space(*counted[d], means[d], np.array([r.value for r in mine]), np.array([r.vector for r in mine]).T, mine[0].trace)
    moments = distinct.mapInArrow(partial_moments(context.broadcast(spaces)), MOMENTS)
    some = moments.withColumn("part", F.floor(F.col("task") / FAN_IN)).groupBy("size", "part").applyInArrow(joined_moments, MOMENTS)
    for r in some.groupBy("size").applyInArrow(joined_moments, MOMENTS).collect():
        space, k = spaces[r.size], len(r.mean)
        error = float(np.abs(np.array(r.square).reshape(k, k) / r.n - np.eye(k)).max()) if k else None
        spaces[r.size] = Space(space.n, space.sums, space.mean, space.values, space.vectors, space.trace, error)
    return spaces


def whitened(table: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each vector and component."""
    clean = table.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col)).alias("x")).where(F.col("x").isNotNull())
    shared = table.sparkSession.sparkContext.broadcast(fit(clean, components))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for d, at, x in _matrices(batch):
                if not d:
                    continue
                space = shared.value[d]
                k, rows = len(space.values), len(at)
                values = space.whiten(x.astype(float) - space.mean).ravel()
                share = [max(e, 0.0) / space.trace if space.trace else None for e in np.where(space.live, space.values, 0.0).tolist()]
                every = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at)).take(every), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array([space.n] * (rows * k), pa.int64()), _deviations(x, space).take(every),
                    pa.array(values, mask=np.isnan(values)), pa.array(share * rows, pa.float64()),
                    pa.array([space.identity_error] * (rows * k), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return clean.mapInArrow(
        run, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: four components of every usable row; deviations beyond 64 bits are null."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
