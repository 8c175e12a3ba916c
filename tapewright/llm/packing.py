"""Vector bin packing of token sequences for training.

A sequence has three limits: tokens, segments and loss-bearing tokens. A segment's demand is the vector (length, 1, tokens
that bear loss). A sequence is filled by the dot-product rule: of the segments that fit whole, the one whose demand, as
shares of the limits, has the largest dot product with what is left; so what a sequence has most of left is used first. When
none fits whole, the best is cut to fill the sequence, and its rest goes back. What a document has beyond whole sequences
waits in a pool of bounded size.

Each partition packs its own documents, so nothing is shuffled and a lost task is packed again on its own; sequence ids hold
the partition's number. A sequence that can't be filled is cut back to a power of two, a length that needs no padding; so
is what remains at the end of a partition.

Defined results: a null or empty text is the end token alone. Repeated rows are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import rows, text


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss_tokens: int = 4096
    #: Segments that wait at most before sequences are filled from them.
    pool: int = 1024


REMEMBERED = 300_000
#: Bytes of texts whose words are looked up together.
GROUP = 1 << 20
#: Strings that the library takes at a time.
TOGETHER = 8
#: Signs that are one piece behind letters: ASCII without the apostrophe, which may be a contraction's, and the mark.
SIGNS = b'!"#$%&()*+,-./:;<=>?@[\\]^_{|}~'
#: Stands between words that are encoded in one call.
MARK = "`"

#: Bytes as kinds: white space, small letters, digits, signs, others.
WHITE, LETTER, DIGIT, SIGN, OTHER = range(5)
KINDS = bytes(
    WHITE if c in b" \t\n\r\v\f" else LETTER if c in b"abcdefghijklmnopqrstuvwxyz" else DIGIT if c in b"0123456789" else SIGN if c in SIGNS else OTHER
    for c in range(256))
_PAIRS = [(former, latter) for former in range(8) for latter in range(8)]
#: By the kinds of a byte and the one before (8 * before + kind): whether a word starts, and whether a piece of a word surely does.
WORD_STARTS = bytes(before == WHITE != kind for before, kind in _PAIRS).ljust(256, b"\0")
PIECE_STARTS = bytes(
    before == WHITE != kind or {before, kind} <= {LETTER, DIGIT, SIGN} and (before != kind or kind == DIGIT) for before, kind in _PAIRS).ljust(256, b"\0")
#: The steps of a tokenizer for which PIECE_STARTS holds and capitals count as small letters.
FOLDING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Lead bytes of U+0300 to U+037F, the marks that may join with an ASCII letter or sign before them.
MARKS = (b"\xcc", b"\xcd")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _last_of_words(path: str) -> np.ndarray | None:
    """Which ids end a word, where the vocabulary marks them with a suffix; None where it does not."""
    tokenizer = _tokenizer(path)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return ends


@lru_cache(maxsize=2)
def _cuts_and_folds(path: str) -> bool:
    """Whether the tokenizer folds capitals and cuts words by the pattern that PIECE_STARTS was made for."""
    steps = json.loads(_tokenizer(path).to_str())
    normalizers = (steps["normalizer"] or {}).get("normalizers")
    first = ((steps["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    return normalizers == FOLDING and first == {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}


class Words:
    """Ids of texts by a tokenizer that drops white space, word by word with a bounded memory of words.

    The tokenizer never looks across white space, so a text's ids are those of its words in turn. Where the tokenizer also folds
    capitals and cuts between ASCII letters, digits and signs, the words are cut there too, so that "The" and "the," share one entry; a
    text with a special token, or with marks that may join with what stands before them, is left as it is. Each different word of about
    1 MB of text is looked up once. Words are remembered in two generations: what was used since the last change stays. Bytes that are no
    UTF-8 count as U+FFFD. A special token that stands in a text is one id, as in the library's own call.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.before = _tokenizer(path), {}, {}
        self.last = _last_of_words(path)
        self.cuts = _cuts_and_folds(path)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def library_ids(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text. The library takes a few at a time, for its encodings are many times larger than their texts."""
        for few in batched(texts, TOGETHER):
            for encoding in self.tokenizer.encode_batch_fast(list(few), add_special_tokens=False):
                yield np.array(encoding.ids, "<u4")

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Words of letters, with signs behind them or not, are strung together by spaces: the letters end with the one id of their own
        that ends words, and so do the signs.

        A run in which there are more such ids (normalising may bring forth signs; never fewer) is encoded with marks instead.
        """
        out: list[bytes] = [b""] * len(words)
        plain, parts, marked = [], [], []
        for i, w in enumerate(words):
            letters = w if w.isalpha() else w.rstrip(SIGNS)
            if self.last is not None and (letters.isalpha() or letters.decode(errors="replace").isalpha()):
                plain.append(i)
                parts.append(1 + (len(letters) < len(w)))
            else:
                marked.append(i)
        runs = [slice(at, at + 512) for at in range(0, len(plain), 512)]
        strung = (b" ".join([words[i] for i in plain[run]]).decode() for run in runs)
        for run, ids in zip(runs, self.library_ids(strung), strict=True):
            ends, last = np.flatnonzero(self.last[ids]) + 1, np.cumsum(parts[run])
            if len(ends) != last[-1]:
                marked += plain[run]
                continue
            packed_ids, at = ids.tobytes(), 0
            for i, end in zip(plain[run], (4 * ends[last - 1]).tolist(), strict=True):
                out[i] = packed_ids[at:end]
                at = end
        for i, ids in zip(marked, self.encode_marked([words[i] for i in marked]), strict=True):
            out[i] = ids
        return out

    def encode_marked(self, words: list[bytes]) -> list[bytes]:
        """Many words in few calls: they are strung together with a mark between them, whose one id parts their ids.

        A word that yields the mark's id itself (normalising turns other signs into it) shows as a mark too many; the words
        of such a run are encoded one by one.
        """
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        strung = [i for i, w in enumerate(words) if MARK.encode() not in w] if len(mark) == 1 else []
        apart = sorted(set(range(len(words))) - set(strung))
        out: list[bytes] = [b""] * len(words)
        runs = [strung[at:at + 512] for at in range(0, len(strung), 512)]
        between = f" {MARK} ".encode()
        found = self.library_ids(between.join([words[i] for i in run]).decode(errors="replace") for run in runs)
        for run, ids in zip(runs, found, strict=True):
            ends = [*np.flatnonzero(ids == mark[0]).tolist(), len(ids)]
            if len(ends) != len(run):
                apart += run
                continue
            packed_ids, at = ids.tobytes(), 0
            for i, end in zip(run, ends, strict=True):
                out[i] = packed_ids[4 * at:4 * end]
                at = end + 1
        for i, ids in zip(apart, self.library_ids([words[i].decode(errors="replace") for i in apart]), strict=True):
            out[i] = ids.tobytes()
        return out

    def cut(self, parts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """All words of the parts in turn, and for each part the number of words before it, the total last."""
        low = [p.lower() for p in parts]
        whole = [i for i, p in enumerate(low) if not self.cuts or any(x in p for x in (*MARKS, *self.special))]
        for i in whole:
            low[i] = parts[i]
        data = b" ".join([b"", *low])
        begins = np.cumsum([1, *(len(p) + 1 for p in low)])
        kinds = np.frombuffer(data.translate(KINDS), np.uint8)
        pairs = kinds[:-1] << 3 | kinds[1:]
        starts = np.zeros(len(data), bool)
        starts[1:] = np.frombuffer(pairs.tobytes().translate(PIECE_STARTS), bool)
        for i in whole:
            own = slice(begins[i], begins[i + 1] - 1)
            starts[own] = np.frombuffer(pairs[own.start - 1:own.stop - 1].tobytes().translate(WORD_STARTS), bool)
        inside = kinds != WHITE
        letters = np.frombuffer(data, np.uint8)[inside]
        offsets = np.append(np.flatnonzero(starts[inside]), len(letters)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        return words, np.searchsorted(np.flatnonzero(starts), begins)

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words, remembered or encoded."""
        if len(self.known) > REMEMBERED // 2:
            self.known, self.before = {}, self.known
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        fresh = []
        for i in missing:
            w = words[i]
            if (ids := self.before.get(w)) is None:
                fresh.append(i)
            else:
                found[i] = self.known[w] = ids
        encoded = self.encode_words([words[i] for i in fresh])
        for i, ids in zip(fresh, encoded, strict=True):
            found[i] = self.known[words[i]] = ids
        return found

    def encode_parts(self, parts: list[bytes]) -> list[bytes]:
        words, begins = self.cut(parts)
        if not len(words):
            return [b""] * len(parts)
        coded = words.dictionary_encode()
        found = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at, codes = np.cumsum(size) - size, coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[codes])])
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(at[codes] - ends[:-1], size[codes]) + np.arange(ends[-1])].tobytes()
        bounds = (4 * ends[begins]).tolist()
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes]] = []
        size = 0

        def finish():
            for (i, _), ids in zip(waiting, self.encode_parts([p for _, p in waiting]), strict=True):
                out[i].append(ids)

        for i, data in enumerate(texts):
            for a, b in text._parts(np.frombuffer(data, np.uint8), text.SPACE):
                waiting.append((i, data[a:b]))
                size += b - a
                if size >= GROUP:
                    finish()
                    waiting, size = [], 0
        if waiting:
            finish()
        return [b"".join(ids) for ids in out]


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    """One memory for all tasks that a worker process runs after each other."""
    return Words(path)


def _encoding(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of texts to batches of doc_id and ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words = _words(path)
        for batch in batches:
            at, kept, size = 0, [], 0
            for i, data in enumerate(text.texts_of(batch), 1):
                kept.append(data.tobytes())
                size += len(data)
                if size >= GROUP or i == len(batch):
                    out = [ids + end for ids in words.encode(kept)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(kept)), pa.array(out, pa.binary())], names=["doc_id", "ids"])
                    at, kept, size = i, [], 0

    return run


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every whole text, the end token last."""
    return rows.texts(docs).mapInArrow(_encoding(path, end_id), "doc_id long, ids binary")


class Packer:
    """Sequences from documents in the order they come. A segment is (document, its ids, start, length)."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.scale = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.segments: list[tuple | None] = []
        self.demand = np.zeros((0, 3))

    @staticmethod
    def loss(segment: tuple) -> int:
        (_, _, _, loss_from), start, length = segment
        return max(0, start + length - max(start, loss_from))

    def add(self, segments: list[tuple]) -> None:
        if segments:
            self.segments += segments
            more = np.array([[s[2], 1, self.loss(s)] for s in segments], float)
            self.demand = np.concatenate([self.demand, more])

    def _take(self, i: int) -> tuple:
        segment = self.segments[i]
        self.segments[i], self.segments[-1] = self.segments[-1], self.segments[i]
        self.demand[[i, -1]] = self.demand[[-1, i]]
        self.segments.pop()
        self.demand = self.demand[:-1]
        return segment

    def _cut(self, segment: tuple, left: np.ndarray) -> tuple[tuple, tuple | None]:
        """The longest head that fits and the rest."""
        document, start, length = segment
        loss_from = document[3]
        most = int(min(length, left[0], max(0, loss_from - start) + left[2]))
        return (document, start, most), (document, start + most, length - most) if most < length else None

    def fill(self) -> list[tuple]:
        left, taken = self.scale.copy(), []
        while left[0] >= 1 and left[1] >= 1 and self.segments:
            want = self.demand / self.scale @ (left / self.scale)
            fits = (self.demand[:, 0] <= left[0]) & (self.demand[:, 2] <= left[2])
            if left[1] == 1 and not (fits & (self.demand[:, 0] == left[0])).any():
                fits[:] = False  # the last segment is cut to fill the sequence, if any is long enough
            if fits.any():
                i = int(np.where(fits, want, -1.0).argmax())
            else:
                i = int(want.argmax())
            head, rest = self._cut(self._take(i), left)
            if rest:
                self.add([rest])
            if head[2] == 0:
                break
            taken.append(head)
            left -= [head[2], 1, self.loss(head)]
        return self.trim(taken)

    def trim(self, taken: list[tuple]) -> list[tuple]:
        """A sequence that is not full goes back to the largest power of two."""
        total = sum(s[2] for s in taken)
        over = total - (1 << (total.bit_length() - 1)) if total < self.limits.tokens else 0
        while over:
            document, start, length = taken.pop()
            back = min(over, length)
            if back < length:
                taken.append((document, start, length - back))
            self.add([(document, start + length - back, back)])
            over -= back
        return taken

    def pack(self, documents: Iterator[tuple]) -> Iterator[list[tuple]]:
        """`documents` are (doc_id, ids, tokens, first token that bears loss)."""
        whole = min(self.limits.tokens, self.limits.loss_tokens)
        waiting: list[tuple] = []
        for document in documents:
            n, start = document[2], 0
            while n - start >= whole and whole == self.limits.tokens:
                yield [(document, start, whole)]
                start += whole
            if start < n:
                waiting.append((document, start, n - start))
            if len(waiting) >= self.limits.pool // 2:
                self.add(waiting)
                waiting = []
                while len(self.segments) > self.limits.pool // 2 and self.demand[:, 0].sum() >= self.limits.tokens:
                    yield self.fill()
        self.add(waiting)
        while self.segments:
            yield self.fill()


PIECES_OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, segment long, offset long"


def _pieces(limits: Limits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of doc_id, ids and, if there, loss_from to batches of pieces."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
        ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("segment", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        base = TaskContext.get().partitionId() << 36

        def documents():
            for batch in batches:
                ids, froms = batch.column(0).to_pylist(), batch.column(2).to_pylist() if batch.num_columns > 2 else [0] * len(batch)
                for doc_id, loss_from, data in zip(ids, froms, text.texts_of(batch, "ids"), strict=True):
                    if len(data):
                        yield doc_id, data.tobytes(), len(data) // 4, loss_from

        def pieces():
            for number, sequence in enumerate(Packer(limits).pack(documents())):
                offset = 0
                for segment, (document, start, length) in enumerate(sequence):
                    yield (document[0], start, length, document[1][4 * start:4 * (start + length)], document[2],
                           Packer.loss((document, start, length)), base + number, segment, offset)
                    offset += length

        yield from text.record_batches(pieces(), schema)

    return run


def packed(encoded: DataFrame, limits: Limits | None = None) -> DataFrame:
    """doc_id, start, length, ids (of the piece), doc_tokens, loss_tokens, sequence_id, segment, offset.

    `encoded` has doc_id and ids; a column loss_from, if there, is the first token of each document that bears loss.
    """
    first = F.coalesce(F.col("loss_from").cast("long"), F.lit(0)) if "loss_from" in encoded.columns else F.lit(0).cast("long")
    return encoded.select(F.col("doc_id").cast("long"), "ids", first.alias("loss_from")).mapInArrow(_pieces(limits or Limits()), PIECES_OUT)


def tokenized_and_packed(docs: DataFrame, path: str, end_id: int, limits: Limits | None = None) -> DataFrame:
    """The rows of packed(tokenized(...)), in one pass: a task holds one Python process, not one for each step.

    Spark keeps such processes for later tasks and gives them out in turn, so that with two a task each comes to hold a
    tokenizer and its words.
    """
    encode, pack = _encoding(path, end_id), _pieces(limits or Limits())
    return rows.texts(docs).mapInArrow(lambda batches: pack(encode(batches)), PIECES_OUT)


def packed_documents(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of all documents with a digest in place of the ids."""
    return tokenized_and_packed(docs, path, end_id=2).withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document packed into sequences of 4096 tokens."""
    import public_tokenizers

    return packed_documents(rows.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
