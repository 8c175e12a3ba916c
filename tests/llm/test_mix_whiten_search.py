import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import mixing, ranked_search, whitening
from tests.llm import data

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("size", "copy", "first", "m", "h", "source_no", "part", "n", "x", "component", "row", "score", "rank", "block", "term")


def clashing(frame):
    return frame.withColumns({c: F.lit("extra") for c in CLASH})


def sourced(spark):
    """Sources of very different sizes, one null, one without words, one with a third of all rows, and repeated rows."""
    r = random.Random(2)
    rows = [(i, data.prose(i, r.randint(0, 120)), ("b", "a", None, "Z", "é")[i % 5]) for i in range(60)]
    rows += [(100 + i, data.prose(100 + i, 30), "hot") for i in range(40)] + [(7, "same text here", "hot")] * 30
    rows += [(200, None, "none"), (201, "", "none"), (202, " \t", "none"), (None, "lost id words", "a"), (300, data.prose(5, 4000), "b"), (7, "same text here", "a"), (7, "other text now", "hot")]
    return rows


def mixed_rows(spark, rows, settings):
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    mixed = mixing.mix(docs, settings)
    return docs, mixed


@pytest.mark.parametrize("settings", [mixing.Settings(), mixing.Settings(block=16, shard_slots=32, bucket_rows=7)])
def test_mix_holds_its_targets_and_its_sql(spark, tmp_path, settings):
    rows = sourced(spark)
    docs, mixed = mixed_rows(spark, rows, settings)
    taken, sources = Counter(), {r.source_no: r for r in mixed.sources.collect()}
    for r in mixed.spans.collect():
        taken[r.source_no, r.first] += r.length
    assert [r.source for r in sorted(sources.values(), key=lambda r: r.source_no)] == sorted({s for _, _, s in rows if s}) + [None]
    per_source = Counter()
    for r in mixed.rows.where("size > 0").collect():
        assert taken[r.source_no, r.first] <= 2 * r.size
        per_source[r.source_no] += taken[r.source_no, r.first]
    for no, s in sources.items():
        assert per_source[no] == math.floor(s.target) and s.target <= 2 * s.source_size
    total = sum(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert sum(s.target for s in sources.values()) == pytest.approx(1.5 * total)
    assert mixed.rows.count() == len(rows)
    # Every shard but the last is full, and no slot is used twice.
    slots = mixed.slots.collect()
    assert len({r.slot for r in slots}) == len(slots) == max(r.slot for r in slots) + 1
    assert all(r.shard == r.slot // settings.shard_slots for r in slots)
    docs.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = Counter(con.sql(mixing.oracle_sql(settings)).fetchall())
    names = mixed.sources.select("source_no", "source_size", "target")
    used = mixed.spans.groupBy("source_no", "first").agg(F.sum("length").alias("taken"))
    got = mixed.rows.join(used.withColumn("size", F.lit(True)).withColumnRenamed("size", "_"), ["source_no", "first"], "left").join(names, "source_no")
    got = got.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).alias("taken"))
    # Equal rows are exchangeable: sums over a key have to agree row by row once they are sorted.
    assert Counter(tuple(r) for r in got.collect()) == want


def test_mix_query_and_texts(spark, tmp_path):
    rows = sourced(spark)
    docs, mixed = mixed_rows(spark, rows, mixing.Settings(block=16, shard_slots=32))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and out.count() == len(rows)
    once, again = (Counter(tuple(r) for r in mixing.query(spark, str(tmp_path)).collect()) for _ in range(2))
    assert once == again
    pieces = mixing.mixed_texts(mixed, docs).collect()
    words = defaultdict(set)
    for d, t, _ in rows:
        words[d].add(tuple(WORD.findall(t or "")))
    for p in pieces:
        assert any(" ".join(w[p.start:p.start + p.length]) == p.words for w in words[p.doc_id])
    per_slot = Counter()
    for p in sorted(pieces, key=lambda p: (p.slot, p.at)):
        assert p.at == per_slot[p.slot]
        per_slot[p.slot] += p.length
    assert {r.slot: r.words for r in mixed.slots.collect() if r.words} == dict(per_slot)


def test_permutations_are_bijections(spark):
    settings = mixing.Settings()
    for n in (1, 2, 3, 10, 257):
        rows = spark.range(n).crossJoin(spark.range(3).toDF("key")).select("key", mixing.permuted(F.col("id"), F.lit(n), F.col("key"), settings).alias("p"))
        for got in rows.groupBy("key").agg(F.sort_array(F.collect_list("p")).alias("p")).collect():
            assert got.p == list(range(n))


@pytest.mark.parametrize("rows", [[], [(1, None, None), (2, "", "a")]])
def test_mix_of_nothing(spark, rows):
    _, mixed = mixed_rows(spark, rows, None)
    assert mixed.spans.count() == 0 and mixed.rows.count() == len(rows)


def vectors():
    r = np.random.default_rng(3)
    base = r.standard_normal((200, 12)) @ np.diag(np.linspace(3, 0.2, 12))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(500 + i, rows[0][1]) for i in range(100)]  # one vector on a third of the rows
    rows += [(700, None), (701, [None] + [0.5] * 11), (702, [float("nan")] * 12), (703, [float("inf")] + [0.0] * 11), (704, [0.0] * 12),
             (705, [-0.0] * 12), (None, [0.25] * 12), (7, [1.0] * 12), (706, []), (707, [1.0, 2.0, 3.0]), (708, [1.5, 0.0, 3.0])]
    return rows


def test_whitening_against_plain_eigenvectors(spark):
    rows = vectors()
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = whitening.whitened(frame).collect()
    x = {(i, n): np.floor(256 * np.array(v, float)).astype(np.int64) for n, (i, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v)}
    expected = Counter()
    for (i, _), v in x.items():
        expected[i] += min(4, len(v))
    assert Counter(r.vec_id for r in got) == expected
    for d in (12, 3):
        mine = [v for v in x.values() if len(v) == d]
        fit = np.unique(np.stack(mine), axis=0)
        n, s = len(fit), fit.sum(axis=0)
        y = fit - s / n
        e, q = np.linalg.eigh(y.T @ y / n)
        e, q = e[::-1][:4], q[:, ::-1][:, :4]
        live = e > 1e-9
        for c in range(len(e)):
            want = sorted((i if i is not None else -1, int(((n * v - s) ** 2).sum()), float((v - s / n) @ q[:, c] / np.sqrt(e[c])) if live[c] else 0.0) for (i, _), v in x.items() if len(v) == d)
            here = sorted((r.vec_id if r.vec_id is not None else -1, int(r.deviation), r.whitened or 0.0) for r in got if r.component == c + 1 and (r.n == n))
            assert [w[:2] for w in want] == [h[:2] for h in here]
            a, b = (np.array([z[2] for z in k]) for k in (want, here))
            assert np.allclose(a, b * np.sign(a @ b), atol=1e-9)
            assert all((r.whitened is None) == (not live[c]) for r in got if r.component == c + 1 and r.n == n)
        share = {r.component: r.explained for r in got if r.n == n}
        assert np.allclose([share[c + 1] for c in range(len(e))], np.where(live, e, 0) / np.trace(y.T @ y / n))
    assert all(r.identity_error < 1e-10 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_whitening_of_nothing(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_whitening_without_variance_and_with_huge_entries(spark):
    same = whitening.whitened(spark.createDataFrame([(1, [2.0, 1.0]), (2, [2.0, 1.0])], "vec_id long, embedding array<float>")).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)
    huge = whitening.whitened(spark.createDataFrame([(1, [3e38, 1.0]), (2, [1e15, -2.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>"))
    x = [[2**63 - 1, 256], [int(math.floor(256 * float(np.float32(1e15)))), -512], [256, 256]]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = {i + 1: sum((3 * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in enumerate(x)}
    for r in huge.collect():
        assert r.deviation == (want[r.vec_id] if want[r.vec_id] < 10**38 else None)


def test_counts_and_repeated_eigenvalues():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.standard_normal((20, 20)))[0]
    for e in (np.linspace(0, 5, 20), np.r_[np.zeros(15), [1, 2, 5, 5, 5]], np.ones(20), np.r_[np.ones(17), [3, 3 + 1e-12, 3 + 1e-9]]):
        v = (q * e) @ q.T
        v = (v + v.T) / 2
        exact = np.linalg.eigvalsh(v)
        for shift in (-0.5, 0.7, 1.3, 4.0, 6.0):
            assert whitening.count_above(v, shift) == (exact > shift).sum()
        got = whitening.leading(v, 4)
        u = np.stack([g.vector for g in got])
        assert np.allclose([g.value for g in got], exact[::-1][:4], atol=1e-12) and np.allclose(u @ u.T, np.eye(4), atol=1e-12)
        assert max(np.linalg.norm(v @ g.vector - g.value * g.vector) for g in got) < 1e-11
        assert all(g.above < k <= g.at_least for k, g in enumerate(got, 1))


def plain_search(docs, items, best):
    def terms(text):
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)

    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = set()
    for item, wanted in asked.items():
        scores = []
        for d, c in counted:
            m = 50 + 50 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out |= {(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:best], 1)}
    return out


@pytest.mark.parametrize("settings", [
    ranked_search.Settings(), ranked_search.Settings(best=3, owners=6, block_rows=5, chunk_items=2, bits=64, part=10), ranked_search.Settings(best=5, owners=1)])
def test_search_against_plain_scores(spark, settings):
    rows = data.texts() + [(40 + i, data.prose(30 + i, 40)) for i in range(60)] + [(4, data.texts()[3][1]), (None, "ka LO mi"), (99, "naïve Ärger—x_y9")]
    items = [(1, data.prose(1, 20)), (2, "ka lo mi x_Y9 NAÏVE"), (3, None), (4, "..."), (5, "unheard ofwords"), (1, "tusel"), (None, data.prose(8, 30)), (6, data.prose(40, 40) + " same line here")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    asked = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = {tuple(r) for r in ranked_search.search(docs, asked, settings).collect()}
    assert got == plain_search(rows, items, settings.best)


def test_search_of_nothing_and_the_query(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "ka lo")], "item_id long, text string")
    assert ranked_search.search(none, item).count() == 0
    docs = spark.createDataFrame(data.texts(), "doc_id long, text string")
    assert ranked_search.search(docs, item.limit(0)).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    item.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = ranked_search.query(spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == plain_search(data.texts(), [(1, "ka lo")], 50)
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
