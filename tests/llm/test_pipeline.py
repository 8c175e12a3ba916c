import random
from collections import Counter, defaultdict

import corpus_pipeline
import __spark_entry__
from tests.llm import brute, data

LABEL = "doc_id long, quality int, toxic int"


def corpus(spark, tmp_path):
    """Plain documents, junk, rude ones, near copies and a passage shared by three."""
    r = random.Random(4)
    rows, labels = [], []
    passage = data.prose(999, 90)
    for i in range(300):
        t = data.prose(i, r.randint(60, 140))
        kind = ("plain", "plain", "junk", "rude", "plain")[i % 5]
        if kind == "junk":
            t = " ".join(w + "***" for w in t.split())
        if kind == "rude":
            w = t.split()
            w[5], w[40] = "Grobian", "lout"
            t = " ".join(w)
        if i in (20, 21, 25):
            t = t + " " + passage
        rows.append((i, t, kind))
        labels.append((i, int(kind != "junk"), int(kind == "rude")))
    for k in range(10):
        w = rows[30 + 5 * (k % 2)][1].split()
        w[10 + k] = "changed"
        rows.append((300 + k, " ".join(w), "copy"))
    rows += [(400, None, "plain"), (401, "", "plain")]
    data.documents(spark, [(i, t) for i, t, _ in rows], repeated=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABEL).write.parquet(f"{tmp_path}/labels.parquet")
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = corpus(spark, tmp_path)
    sf_dir, kind = str(tmp_path), {i: k for i, _, k in rows}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "substrings", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, held = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        held.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == columns
        if name == "near_duplicates":
            before = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/toxicity").collect()]
            assert held[-1] == {c for _, _, c in brute.groups(before, 5)}
        if name == "substrings":
            before = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/near_duplicates").collect()]
            sizes = {d: n - gone for d, n, gone, _, _ in brute.repeats(before)}
            assert {r.doc_id: len((r.text or "").encode()) for r in docs.collect()} == sizes  # ASCII there but for é and ß
            assert sum(passage in (r.text or "") for r in docs.collect()) == 0
    assert sum(kind[i] == "junk" for i in held[0]) <= 2 and sum(kind[i] in ("plain", "copy") for i in held[0]) >= 0.98 * sum(k in ("plain", "copy") for k in kind.values())
    assert sum(kind[i] == "rude" for i in held[1]) <= 3 and sum(kind[i] in ("plain", "copy") for i in held[1]) >= 0.97 * sum(k in ("plain", "copy") for k in kind.values())
    assert held[4] == held[3] == held[2]
    whole = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect())
    staged = docs.collect()
    assert sum(n for (_, _, n, _), c in whole.items() for _ in range(c)) == sum(r.length for r in staged)
    per_document = defaultdict(int)
    for r in staged:
        per_document[r.doc_id] += r.length
    assert all(per_document[r.doc_id] == r.doc_tokens for r in staged)


def test_every_query_of_the_folder_is_registered():
    names = __spark_entry__.queries()
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
