"""Bytes of texts inside Arrow batches: views without copies, word hashes and n-gram hashes in numpy.

Words are maximal runs of bytes outside the given separators. Everything works piece by piece inside a text, so a text
of any length needs memory of a few times its own size at most, and only for the part in hand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of a text that are hashed at once; a longer run without a separator is taken whole.
PART = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(_BASE)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(_MULTIPLIER)
    return h ^ (h >> np.uint64(32))


#: One fixed 64-bit value for each byte, and the same with capitals folded.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
BYTE_FOLDED = BYTE[LOWER]

#: Places of a word whose values are looked up; those further on are computed.
NEAR = 64


def placed(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A scrambled value for a byte's value at a place of its word: no sum of such values follows from that of other places."""
    return mix(values + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))


_tables: dict[bytes, np.ndarray] = {}


def _near_table(values: np.ndarray) -> np.ndarray:
    key = values.tobytes()
    if key not in _tables:
        _tables[key] = placed(np.tile(values, NEAR), np.repeat(np.arange(NEAR), 256))
    return _tables[key]


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 12)
        with np.errstate(over="ignore"):
            _powers[:] = []
            for base in (_BASE, _INVERSE):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers.append(np.multiply.accumulate(steps))
    return _powers[0][:n], _powers[1][:n]


def binary_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary or string column; a null is an empty value."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[np.ndarray]:
    at, data = binary_column(batch, name)
    for start, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield data[start:end]


def _parts(data: np.ndarray, separator: np.ndarray) -> Iterator[tuple[int, int]]:
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + PART)
        if end < n:
            cut = np.flatnonzero(separator[data[start:end]])
            if len(cut):
                end = start + int(cut[-1]) + 1
            else:
                later = np.flatnonzero(separator[data[end:]])
                end = end + int(later[0]) + 1 if len(later) else n
        yield start, end
        start = end


def words_of(data: np.ndarray, separator: np.ndarray = SPACE, values: np.ndarray = BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of a text's words."""
    starts, ends, hashes = [], [], []
    table = _near_table(values)
    for a, b in _parts(data, separator):
        part = data[a:b]
        inside = np.empty(len(part) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(separator[part], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edges[::2], edges[1::2]
        if not len(s):
            continue
        # Bytes of words alone, each with its place; a word's hash is the sum over its bytes.
        length = e - s
        first = np.cumsum(length) - length
        letters = part[inside[1:-1]]
        places = np.arange(len(letters)) - np.repeat(first, length)
        terms = table[np.minimum(places, NEAR - 1) * 256 + letters]
        if length.max() > NEAR:
            far = np.flatnonzero(places >= NEAR)
            terms[far] = placed(values[letters[far]], places[far])
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mix(np.add.reduceat(terms, first) + length.astype(np.uint64)))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def runs_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n neighbouring 64-bit values (already scrambled)."""
    count = len(values) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(values))
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * power, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * inverse[:count])


def sliding(values: np.ndarray, width: int, reduce: np.ufunc) -> np.ndarray:
    """Minimum or maximum over every window of the given width, in time proportional to the length."""
    n = len(values)
    if n < width:
        return values[:0]
    if width == 1:
        return values
    padded = -(-n // width) * width
    filler = values[-1:] if n else values
    block = np.concatenate([values, np.repeat(filler, padded - n)]).reshape(-1, width)
    left = reduce.accumulate(block, axis=1).ravel()
    right = reduce.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return reduce(right[:n - width + 1], left[width - 1:n])


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans as maximal spans in order; spans that touch become one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    first = np.concatenate([[True], starts[1:] > reach[:-1]])
    last = np.concatenate([first[1:], [True]])
    return starts[first], reach[last]


def record_batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size from tuples; byte strings count with their length."""
    kept: list[tuple] = []
    size = 0
    for row in rows:
        kept.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str))) + 8 * len(row)
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
