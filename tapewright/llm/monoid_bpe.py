"""Byte-level BPE by reduction over a tree: halves are encoded on their own and joined at the seam.

Two joins are used, and both stop on a proof, not on a guess.

* Cutting a text into the pieces of the pattern. A long text is halved anywhere. The pattern never looks back. A piece is told
  by the character after it and by the three from its start on, which may be a contraction ('re). So all pieces of the left
  half hold but its last and those that start within two characters of the cut; from there matching goes on until it meets
  the start of a piece of the right half, after which all of those hold.
* Merging the bytes of a piece. A long piece is halved. Tokens a, b that stand side by side are stable if encoding their
  bytes gives a, b again; a sequence is the encoding of its bytes exactly if all neighbours are stable. So the tokens in a
  window around the seam are encoded anew, and the window grows on the side where its edge is not stable with its neighbour.

Short pieces, nearly all there are, are leaves. All new leaves of a batch are merged together in numpy, one merge a round in
each, and kept in a bounded memory of recent pieces. Decoding concatenates the bytes of blocks of tokens.

Defined results: a null or empty text has no tokens. Rows that repeat are encoded each.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import rows, text

#: Characters of a text that are cut, and bytes of a piece that are merged, without halving.
TEXT_LEAF = 1 << 16
PIECE_LEAF = 32
#: Characters of the pattern's longest contraction.
CONTRACTION = 3
#: Pieces remembered by a task; beyond it the memory starts anew.
REMEMBERED = 150_000
NONE = np.int32(1 << 30)


class Merges:
    """Ranks of a vocabulary file, with every pair of tokens that make a token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.stable: dict[tuple[int, int], bool] = {}

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def merge(self, data: bytes) -> list[int]:
        """A leaf: merge the pair of the lowest rank, the leftmost of equals, until none is left."""
        out = self.single[np.frombuffer(data, np.uint8)].tolist()
        ranks = [self.pairs.get((a << 32) | b, NONE) for a, b in zip(out[:-1], out[1:], strict=True)]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            out[i:i + 2] = [int(low)]
            del ranks[i]
            if i > 0:
                ranks[i - 1] = self.pairs.get((out[i - 1] << 32) | out[i], NONE)
            if i < len(ranks):
                ranks[i] = self.pairs.get((out[i] << 32) | out[i + 1], NONE)
        return out

    def are_stable(self, a: int, b: int) -> bool:
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) > REMEMBERED:
                self.stable.clear()
            known = self.stable[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' bytes together."""
        if not a or not b:
            return a + b
        left = right = 1
        while True:
            window = self.merge(b"".join(self.tokens[t] for t in a[-left:] + b[:right]))
            left_holds = left >= len(a) or self.are_stable(a[-left - 1], window[0])
            right_holds = right >= len(b) or self.are_stable(window[-1], b[right])
            if left_holds and right_holds:
                return a[:len(a) - left] + window + b[right:]
            left = left if left_holds else min(len(a), 2 * left)
            right = right if right_holds else min(len(b), 2 * right)

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= PIECE_LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    def leaves(self, pieces: list[bytes]) -> list[bytes]:
        """Encodings of many short pieces, as 32-bit little-endian ids: those of equal length are merged side by side."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            tokens = self.single[np.frombuffer(b"".join([pieces[i] for i in at.tolist()]), np.uint8)].reshape(-1, size)
            ranks = self.lookup(tokens[:, :-1], tokens[:, 1:])
            while len(at):
                width = tokens.shape[1]
                best = ranks.argmin(axis=1) if width > 1 else np.zeros(len(at), np.int64)
                low = ranks[np.arange(len(at)), best] if width > 1 else np.full(len(at), NONE)
                done = low == NONE
                if done.any():
                    packed = tokens[done].astype("<u4").tobytes()
                    step = 4 * width
                    for j, i in enumerate(at[done].tolist()):
                        out[i] = packed[j * step:(j + 1) * step]
                    go = ~done
                    at, tokens, ranks, best, low = at[go], tokens[go], ranks[go], best[go], low[go]
                    if not len(at):
                        break
                row = np.arange(len(at))
                tokens[row, best] = low
                columns = np.arange(width - 1)
                tokens = np.take_along_axis(tokens, columns + (columns > best[:, None]), axis=1)
                if width > 2:
                    columns = np.arange(width - 2)
                    ranks = np.take_along_axis(ranks, columns + (columns >= best[:, None]), axis=1)
                    has = best > 0
                    ranks[row[has], best[has] - 1] = self.lookup(tokens[row[has], best[has] - 1], low[has])
                    has = best < width - 2
                    ranks[row[has], best[has]] = self.lookup(low[has], tokens[row[has], best[has] + 1])
        return out


def piece_starts(whole: str, pattern, start: int = 0, stop: int | None = None) -> list[int]:
    """Starts of the pattern's pieces in whole[start:stop], as if nothing followed."""
    stop = len(whole) if stop is None else stop
    if stop - start <= TEXT_LEAF:
        return [m.start() for m in pattern.finditer(whole, start, stop)]
    half = (start + stop) // 2
    left, right = piece_starts(whole, pattern, start, half), piece_starts(whole, pattern, half, stop)
    at = left.pop()
    while left and left[-1] > half - CONTRACTION:
        at = left.pop()
    while at < stop:
        i = bisect_left(right, at)
        if i < len(right) and right[i] == at:
            return left + right[i:]
        left.append(at)
        at = pattern.match(whole, at, stop).end()
    return left


def pieces_of(whole: str, pattern) -> list[str]:
    if len(whole) <= TEXT_LEAF:
        return pattern.findall(whole)
    starts = piece_starts(whole, pattern)
    return [whole[a:b] for a, b in zip(starts, [*starts[1:], len(whole)], strict=True)]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(maxsize=2)
def compiled(pattern: str):
    return regex.compile(pattern)


class Encoder:
    """Texts to ids, with a bounded memory of pieces."""

    def __init__(self, path: str, pattern: str):
        self.merges, self.pattern, self.known = merges(path), compiled(pattern), {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [pieces_of(t, self.pattern) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = [p for p in set().union(*cut) if p not in self.known]
        raw = [p.encode() for p in fresh]
        short = [i for i, p in enumerate(raw) if len(p) <= PIECE_LEAF]
        self.known.update(zip([fresh[i] for i in short], self.merges.leaves([raw[i] for i in short]), strict=True))
        long = {fresh[i]: np.array(self.merges.piece(raw[i]), "<u4").tobytes() for i in range(len(raw)) if len(raw[i]) > PIECE_LEAF}
        if not long:
            return [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        return [b"".join([self.known.get(p) or long[p] for p in pieces]) for pieces in cut]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every whole text, by the vocabulary at `path` and the pattern."""

    def run(batches):
        encoder = Encoder(path, pattern)
        for batch in batches:
            ids = batch.column(0)
            at, kept, size = 0, [], 0
            for i, data in enumerate(text.texts_of(batch), 1):
                kept.append(data.tobytes().decode())
                size += len(data)
                if size > 1 << 20 or i == len(batch):
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(kept)), pa.array(encoder.encode(kept), pa.binary())], names=["doc_id", "ids"])
                    at, kept, size = i, [], 0

    return rows.texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the bytes they stand for."""

    def run(batches):
        tokens = merges(path).tokens
        for batch in batches:
            out = []
            for data in text.texts_of(batch, "ids"):
                ids = np.frombuffer(data.tobytes(), "<u4")
                out.append(b"".join(b"".join([tokens[t] for t in ids[i:i + TEXT_LEAF].tolist()]) for i in range(0, len(ids), TEXT_LEAF)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: digests of ids and of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = decode(encode(rows.documents(spark, sf_dir), path, public_tokenizers.PATTERN), path)
    return found.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
