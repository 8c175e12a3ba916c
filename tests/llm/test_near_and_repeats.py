from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import anchors, chosen_path, factoring, suffix_columns, text
from tapewright.llm.components import components
from tests.llm import brute, data


def write(tmp_path, frame):
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def many(seed):
    """Documents that share passages, with copies and near copies."""
    passages = [data.prose(900 + i, 70) for i in range(4)]
    rows = []
    for i in range(60):
        t = data.prose(seed + i % 45, 30 + 5 * i)
        if i % 3 == 0:
            t = t[:200] + " " + passages[i % 4] + " " + t[200:]
        if i % 7 == 0:
            w = t.split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("rows", [data.texts(), many(50)])
def test_removed_bytes_are_those_of_the_plain_version(spark, tmp_path, rows):
    frame = data.documents(spark, rows)
    got = suffix_columns.query(spark, write(tmp_path, frame)).collect()
    expected = brute.repeats(data.as_bytes([(r.doc_id, r.text) for r in frame.collect()]))
    assert Counter(map(tuple, got)) == Counter(expected)


@pytest.mark.parametrize("rows", [data.texts(), many(50)])
def test_removed_words_are_those_of_the_plain_version(spark, tmp_path, rows):
    frame = data.documents(spark, rows)
    got = factoring.query(spark, write(tmp_path, frame)).collect()
    expected = brute.earlier(data.as_bytes([(r.doc_id, r.text) for r in frame.collect()]))
    assert Counter(map(tuple, got)) == Counter(expected)


def test_one_segment_a_class_and_document_is_parsed(spark, tmp_path, monkeypatch):
    """Documents of one repeated word or line, and passages that stand twice in the document that has them first."""
    passage, around = data.prose(70, 80), [data.prose(71, 30), data.prose(72, 30)]
    twice = f"{around[0]} {passage} {around[1]}"
    line = data.prose(73, 7)
    rows = [(1, passage), (2, f"{twice} {data.prose(74, 60)} {twice}"), (3, "echo " * 3000), (4, data.prose(75, 20) + " echo" * 2000), (5, f"{line}\n" * 400),
            (6, f"{data.prose(76, 60)} {line} {line} " + f"{line}\n" * 300 + twice), (2, f"{data.prose(77, 60)} {twice}")]
    sent, plain = [], anchors.segments

    def counting(wanted, *more):
        sent.append(wanted.count())
        return plain(wanted, *more)

    monkeypatch.setattr(anchors, "segments", counting)
    frame = data.documents(spark, rows, repeated=False)
    got = factoring.query(spark, write(tmp_path, frame)).collect()
    assert Counter(map(tuple, got)) == Counter(brute.earlier(data.as_bytes(rows)))
    assert sum(sent) < 1000
    usual = factoring.WORDS
    monkeypatch.setattr(factoring, "WORDS", anchors.Shape(usual.length, usual.k, group_limit=1))
    assert Counter(map(tuple, factoring.query(spark, str(tmp_path)).collect())) == Counter(map(tuple, got))


@pytest.mark.parametrize("module,shape", [(suffix_columns, "BYTES"), (factoring, "WORDS")])
def test_large_anchors_are_settled_alike(spark, tmp_path, monkeypatch, module, shape):
    rows = many(50)
    plain = getattr(module, shape)
    sf_dir = write(tmp_path, data.documents(spark, rows))
    usual = Counter(map(tuple, module.query(spark, sf_dir).collect()))
    monkeypatch.setattr(module, shape, anchors.Shape(plain.length, plain.k, group_limit=1))
    assert Counter(map(tuple, module.query(spark, sf_dir).collect())) == usual


@pytest.mark.parametrize("k", [2, 5])
def test_groups_are_those_of_the_plain_version(spark, k):
    rows = [r for r in data.texts() + [(d + 100, t) for d, t in many(50)] if r[0] is not None]
    got = chosen_path.near_duplicates(data.documents(spark, rows), chosen_path.Settings(words=k)).distinct().collect()
    expected = brute.groups(data.as_bytes(rows), k)
    assert {tuple(r) for r in got} == {(d, n, c, d == c) for d, n, c in expected}


def test_chains_and_crowds_of_near_copies(spark):
    """A chain whose ends are unlike, and a crowd larger than a node may be."""
    base = data.prose(3, 100).split()
    chain = [(i, " ".join(["new%d" % j if j < 4 * i else w for j, w in enumerate(base)])) for i in range(12)]
    crowd_base = data.prose(4, 60).split()
    crowd = [(100 + i, " ".join([*crowd_base[:i % 59], f"c{i}", *crowd_base[i % 59 + 1:]])) for i in range(90)]
    settings = chosen_path.Settings(words=2, node_limit=16, deepest=5)
    got = chosen_path.near_duplicates(data.documents(spark, chain + crowd, repeated=False), settings).collect()
    assert {tuple(r)[:3] for r in got} == set(brute.groups(data.as_bytes(chain + crowd), 2))


def test_meetings_hold_two_blocks_a_task_and_hide_no_pair(spark):
    """A node of many classes that are alike and not connected, with and without a common component."""
    r, limit = np.random.default_rng(5), 16
    base = r.integers(0, 256, 16, np.uint8)
    sketch = [base.copy() for _ in range(150)]
    for i, one in enumerate(sketch):
        one[r.choice(16, i % 12, replace=False)] ^= 0x11
    settings = chosen_path.Settings(words=2, node_limit=limit)
    nodes = spark.createDataFrame([(1, 10, i, bytes(x)) for i, x in enumerate(sketch)], "path long, n_blocks long, rep long, sketch binary")

    for size in (1, 60):
        label = {i: 0 if i < size else i for i in range(150)}
        labels = spark.createDataFrame([(i, 0) for i in range(size)] if size > 1 else [], "node long, component long")
        tasks = chosen_path.meeting_tasks(nodes, labels, settings).groupBy("path", "a", "b", "inner").count()
        assert tasks.agg(F.max("count")).first()[0] <= 4 * limit
        groups = defaultdict(set)
        for x, target in map(tuple, chosen_path.meetings(nodes, labels, settings).collect()):
            groups[target].add(x)
        compared = {frozenset((x, y)) for target, comers in groups.items() for x in comers for y in comers | {i for i in label if label[i] == target}}
        met = {frozenset(label[x] for x in pair) for pair in compared}
        for i in range(150):
            alike = chosen_path._agree(sketch[i], np.stack(sketch)) >= settings.sketch_match
            assert all(label[i] == label[j] or frozenset((label[i], label[j])) in met for j in np.flatnonzero(alike).tolist())


def test_one_of_each_group_stays_with_all_columns(spark):
    frame = data.documents(spark)
    left = chosen_path.representatives(frame)
    assert left.columns == frame.columns
    ids = [r.doc_id for r in left.collect()]
    assert Counter(ids)[1] == 1 and 2 not in ids and 3 not in ids and None in ids and Counter(ids)[4] == 1


def test_removal_keeps_columns_rows_and_whole_characters(spark):
    frame = data.documents(spark)
    out = suffix_columns.remove_repeats(frame)
    assert out.columns == frame.columns and out.count() == frame.count()
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[6].text is None and by_id[1].text == "" and by_id[1].n_chars == 0 and by_id[11].text == data.prose(7, 9000)
    assert len(by_id[5].text) < len(data.texts()[4][1]) and by_id[5].n_chars == len(by_id[5].text)


def test_empty_tables(spark, tmp_path):
    sf_dir = write(tmp_path, data.empty(spark))
    assert suffix_columns.query(spark, sf_dir).count() == factoring.query(spark, sf_dir).count() == chosen_path.query(spark, sf_dir).count() == 0
    assert suffix_columns.remove_repeats(data.empty(spark)).count() == chosen_path.representatives(data.empty(spark)).count() == 0


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (9, 8), (7, 9), (5, 5), (2, 1)] + [(i, i + 1) for i in range(20, 60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7} | {i: 20 for i in range(20, 61)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_word_hashes_do_not_depend_on_place_or_part(monkeypatch):
    t = data.prose(1, 500).encode()
    whole = text.words_of(np.frombuffer(t, np.uint8))[2]
    monkeypatch.setattr(text, "PART", 64)
    assert (text.words_of(np.frombuffer(t, np.uint8))[2] == whole).all() and len(whole) == 500
    assert len(set(whole.tolist())) == len(set(t.split()))


def mirrored():
    """Two words of 1 024 letters that every polynomial modulo 2**64 takes for the same."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_mirrored_words_are_no_copies(spark, tmp_path):
    one, other = mirrored()
    frame = data.documents(spark, [(1, one), (2, other), (3, other)], repeated=False)
    got = {r.doc_id: (r.component_id, r.kept) for r in chosen_path.query(spark, write(tmp_path, frame)).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (2, False)}


def test_windows_of_mirrored_words_are_kept(spark, tmp_path):
    one, other = mirrored()
    around = data.prose(5, 60)
    frame = data.documents(spark, [(1, f"{one} {around}"), (2, f"{other} {around}"), (3, f"{one} {around}")], repeated=False)
    got = {r.doc_id: r.n_removed for r in factoring.query(spark, write(tmp_path, frame)).collect()}
    assert got == {1: 0, 2: 60, 3: 61}


def test_word_hashes_of_long_words_and_small_tables(monkeypatch):
    words = data.prose(3, 40).split() + ["x" * 63, "x" * 64, "x" * 65, "x" * 200, "x" * 199 + "y", "é" * 50]
    joined = np.frombuffer(" ".join(words).encode(), np.uint8)
    hashes = text.words_of(joined)[2].tolist()
    assert len(set(hashes)) == len(set(words))
    monkeypatch.setattr(text, "NEAR", 4)
    text._tables.clear()
    assert text.words_of(joined)[2].tolist() == hashes
    text._tables.clear()


def test_anchors_do_not_depend_on_place_or_part(monkeypatch):
    t = np.frombuffer(data.prose(1, 2000).encode(), np.uint8)
    shape = anchors.Shape(200, 32)
    at, anchor, _ = anchors.anchors_of(text.BYTE[t], shape)
    monkeypatch.setattr(anchors, "PART", 1024)
    again, anchor2, _ = anchors.anchors_of(text.BYTE[t], shape)
    assert set(at.tolist()) <= set(again.tolist()) or set(at.tolist()) == set(again.tolist())
    for i in range(len(t) - 200):
        assert ((at >= i) & (at <= i + 168)).any()


def test_hot_copies_make_few_rows(spark):
    """Two hundred copies of one text: pairs are never made, each but the first is a copy."""
    frame = data.documents(spark, [(i, data.prose(1, 100)) for i in range(200)], repeated=False)
    got = chosen_path.near_duplicates(frame, chosen_path.Settings(words=2))
    assert got.where("kept").count() == 1 and got.agg(F.max("component_id")).first()[0] == 0
