import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapewright.llm import divergence_rules, monoid_bpe, multi_index, packing
from tests.llm import brute, data

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a" * 3000, "ab" * 1500, " " * 2000, "é" * 900, "x" + " \n" * 300 + "y", "it's we'll '  's", "漢字 12345 ñ\t\n  z", "thethe" * 500]


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=monoid_bpe.merges(RANKS).ranks, special_tokens={})


@pytest.mark.parametrize("text_leaf,piece_leaf", [(1 << 16, 32), (16, 4), (7, 1)])
def test_any_halving_gives_the_library_ids(monkeypatch, text_leaf, piece_leaf):
    monkeypatch.setattr(monoid_bpe, "TEXT_LEAF", text_leaf)
    monkeypatch.setattr(monoid_bpe, "PIECE_LEAF", piece_leaf)
    texts = ODD + [t or "" for _, t in data.texts()]
    got = monoid_bpe.Encoder(RANKS, public_tokenizers.PATTERN).encode(texts)
    assert got == [np.array(reference().encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_contractions_hold_at_every_cut(monkeypatch):
    pattern = monoid_bpe.compiled(public_tokenizers.PATTERN)
    for tail in ("you're here", "we've it", "they'll go", "it's 'tis", "''re'''ll've", "x'r e'l l 're", "a \n 've  'll"):
        for before in range(len(tail) + 1):
            whole = "b" * before + tail + "c" * (len(tail) - before)
            starts = [m.start() for m in pattern.finditer(whole)]
            for leaf in (1, 2, 3, 5, len(whole) - 1):
                monkeypatch.setattr(monoid_bpe, "TEXT_LEAF", leaf)
                assert monoid_bpe.piece_starts(whole, pattern) == starts, (whole, leaf)


def test_encoding_and_decoding_of_a_table(spark, tmp_path):
    frame = data.documents(spark)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, monoid_bpe.query(spark, str(tmp_path)).collect()))
    expected = Counter()
    for r in frame.collect():
        ids = reference().encode_ordinary(r.text or "")
        expected[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert got == expected
    assert monoid_bpe.encode(data.empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_words_are_encoded_as_whole_texts():
    whole = Tokenizer.from_file(WORDS)
    texts = ODD[2:] + [t or "" for _, t in data.texts()] + ["It's <|endoftext|> ` `x İSTANBUL é ́y \x1c ﬁ ΑΣ"]
    got = packing.Words(WORDS).encode([t.encode() for t in texts])
    assert got == [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_special_tokens_and_odd_bytes_and_few_remembered(monkeypatch):
    words = packing.Words(WORDS)
    assert np.frombuffer(words.encode([b"a <|endoftext|> b"])[0], "<u4").tolist() == [320, 49407, 321]
    assert words.encode([b"a\xff b"]) == words.encode(["a\ufffd b".encode()])
    monkeypatch.setattr(packing, "REMEMBERED", 6)
    texts = [f"w{i % 9} w{i % 4} same w{i}".encode() for i in range(60)]
    few = packing.Words(WORDS)
    assert [few.encode([t])[0] for t in texts] == [words.encode([t])[0] for t in texts]
    assert len(few.known) + len(few.before) <= 6 + 2 * 4


def test_words_of_letters_are_encoded_as_alone():
    whole = Tokenizer.from_file(WORDS)
    words = sorted({w for t in [data.prose(i, 400) for i in range(8)] for w in t.split()} | set(
        "İSTANBUL ΑΣ ΣΑΣ ﬁne ǅ ẞ ß naïve naïve 日本語 ภาษา हिन्दी ʼn Ω K Å ª º".split()) | {"a" * 300, "é" * 90})
    words += [w + sign for i, w in enumerate(words) for sign in (".", ",", "***", "'s", "'", "`", "=\u0338", "...'", "<|endoftext|>", "|>", "!?")[i % 11:i % 11 + 3]]
    got = packing.Words(WORDS).encode_words([w.encode() for w in words])
    assert got == [np.array(whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert packing.Words(WORDS).last is not None and sum(w.isalpha() for w in words) > 600


def test_words_that_normalise_to_the_mark():
    whole = Tokenizer.from_file(WORDS)
    texts = ["a \u1fef b", "\u1fef", "x\u1fefy \u1fef\u1fef ` z", " ".join(f"w{i}" for i in range(1500)) + " \u1fef"]
    got = packing.Words(WORDS).encode([t.encode() for t in texts])
    assert got == [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_capitals_signs_and_digits_share_words():
    words = packing.Words(WORDS)
    encoded = []
    inner = words.encode_words
    words.encode_words = lambda fresh: encoded.extend(fresh) or inner(fresh)
    texts = ["The the, THE. (the) the_The 'the' the1 23 321", "1the 2, THE;"]
    got = words.encode([t.encode() for t in texts])
    assert got == [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert sorted(encoded) == sorted(x.encode() for x in ["the", ",", ".", "(", ")", "_", "'the'", "1", "2", "3", ";"])


@pytest.mark.parametrize("part,group", [(1 << 20, 1 << 20), (64, 100), (7, 1)])
def test_words_cut_at_signs_give_the_library_ids(monkeypatch, part, group):
    monkeypatch.setattr(packing.text, "PART", part)
    monkeypatch.setattr(packing, "GROUP", group)
    whole = Tokenizer.from_file(WORDS)
    draw = random.Random(5)
    some = [*"aZtTshHwWyYjJKiI09'' ,.-_`<|>=~^\n\t\0\x1c\x7f\x85\xa0\xb2\xbd\xdf\xe9", "'s", "'LL", "<|endoftext|>", "<|EndOfText|>"]
    some += map(chr, [0x301, 0x308, 0x30c, 0x331, 0x338, 0x344, 0x130, 0x17f, 0x212a, 0x1fef, 0x1ffd, 0x37e, 0x2019, 0x201c, 0x2014, 0x2028])
    some += map(chr, [0x3a3, 0xfb01, 0x1100, 0x1161, 0xac01, 0x6f22, 0x1f600])
    plain = [x for x in some if not any(mark in x.encode() for mark in packing.MARKS) and "|" not in x]
    texts = ["".join(draw.choices(some if i % 2 else plain, k=draw.choice([1, 3, 9, 40]))) for i in range(3000)] + ["", ",", "'", "H" + chr(0x331), "T " + chr(0x308)]
    texts += [x + y for x in "aA9,'<=`" for y in map(chr, range(1, 0x3100))][::7 if part < 1 << 20 else 1]
    got = packing.Words(WORDS).encode([t.encode() for t in texts])
    expected = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, expected, strict=True) if a != b] == []


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 64, 16), packing.Limits(128, 8, 40, 8)])
def test_packing_keeps_every_id_once_and_all_limits(spark, limits):
    frame = data.documents(spark, repeated=False).where("doc_id is not null")
    encoded = packing.tokenized(frame, WORDS, 2).withColumn("loss_from", F.col("doc_id") % 5)
    pieces = packing.packed(encoded, limits).collect()
    ids, starts = {r.doc_id: bytes(r.ids) for r in encoded.collect()}, defaultdict(list)
    for p in pieces:
        assert bytes(p.ids) == ids[p.doc_id][4 * p.start:4 * (p.start + p.length)] and p.doc_tokens == len(ids[p.doc_id]) // 4 and p.length > 0
        starts[p.doc_id].append((p.start, p.length))
    for doc_id, found in starts.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == len(ids[doc_id]) // 4
    assert set(starts) == set(ids)
    for sequence in by_sequence(pieces).values():
        total = 0
        for p in sequence:
            assert p.offset == total
            total += p.length
        assert total <= limits.tokens and len(sequence) <= limits.segments and sum(p.loss_tokens for p in sequence) <= limits.loss_tokens
        assert total == limits.tokens or total & (total - 1) == 0


def by_sequence(pieces):
    out = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        out[p.sequence_id].append(p)
    return out


def test_packed_query(spark, tmp_path):
    frame = data.documents(spark)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = packing.query(spark, str(tmp_path)).collect()
    encoded = {(r.doc_id, bytes(r.ids)) for r in packing.tokenized(frame, WORDS, 2).collect()}
    known = {d: i for d, i in encoded}
    assert all(p.ids_crc32 == zlib.crc32(known[p.doc_id][4 * p.start:4 * (p.start + p.length)]) for p in pieces)
    assert sum(p.length for p in pieces) == sum(len(known[r.doc_id]) // 4 for r in frame.collect())
    assert packing.packed_documents(data.empty(spark), WORDS).count() == 0


def test_packing_takes_one_python_process_a_task(spark):
    frame = data.documents(spark, data.texts() + [(None, "no id"), (None, None)])
    one = packing.packed_documents(frame, WORDS)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    steps = packing.packed(packing.tokenized(frame, WORDS, 2)).withColumn("ids_crc32", F.crc32("ids")).select(*one.columns)
    assert sorted(map(repr, one.collect())) == sorted(map(repr, steps.collect()))


def test_rules_count_as_the_plain_version(spark):
    frame = data.documents(spark)
    got = divergence_rules.judged(frame).collect()
    key = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert Counter((r.doc_id, *key(r)) for r in got) == Counter((r.doc_id, *brute.quality_counts(r.text or "")) for r in frame.collect())
    assert all(not r.kept for r in got if r.base_failed)
    assert divergence_rules.judged(data.empty(spark)).count() == 0


def test_rules_against_sql(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = duckdb.sql(divergence_rules.oracle_sql()).fetchall()
    got = divergence_rules.query(spark, sf_dir)
    assert Counter(map(tuple, got.collect())) == Counter(expected)


def test_far_texts_fail_and_plain_ones_stay(spark):
    plain = [(i, "the cat of the house is in and to a that walks the garden path of stones, and it goes on. " * 1 + data.prose(i, 80)) for i in range(20)]
    shouted = [(100, data.prose(3, 100).upper()), (101, " ".join(w + "$%&" for w in data.prose(4, 100).split()))]
    got = {r.doc_id: r.kept for r in divergence_rules.judged(data.documents(spark, plain + shouted, repeated=False)).collect()}
    assert all(got[i] for i in range(20)) and not got[100] and not got[101]


def plan_nodes(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rules_run_no_python(spark):
    plan = plan_nodes(divergence_rules.judged(data.documents(spark)))
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def vectors(spark, n=3000, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.4 * r.normal(size=16)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(200)]
    rows += [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (9005, [1.0, 2.0]), (None, rows[3][1]), (9100, [3.0, 1.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "ids": F.lit(2), "rank": F.lit(3)})


def exact(rows, asks, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, v in good:
        if asks(q):
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def test_neighbours_against_all(spark):
    rows, table = vectors(spark)
    got = defaultdict(list)
    for r in multi_index.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    expected = exact(rows, lambda q: q % 100 == 0)
    assert set(got) == {q for q, near in expected.items() if near}
    hits = sum(len({i for _, i in got[q]} & {i for _, i in near}) for q, near in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))
    assert all(got[q] == sorted(got[q]) for q in got) and got[9100][0][1] == 9005
    assert got[3000][:2] == [(0.0, 7), (0.0, 3001)] and len(got[3000]) == 10


def test_no_vectors(spark):
    _, table = vectors(spark, 10)
    assert multi_index.nearest(table.where("false"), F.lit(True)).count() == 0
    assert multi_index.nearest(table, F.lit(False)).count() == 0
