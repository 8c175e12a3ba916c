"""Batches in file order: which row of a key is kept and why another is not, and revisions of filings of the same batch."""

import random

import pytest
from pyspark.sql import functions as F

from tapewright.operators import merge
from tapewright.operators.ingest import dedupe_two_keys

ROW = "artifact_id string, row_no bigint, a string, b string, issue struct<severity:string,code:string,message:string>"


def in_order(rows):
    """row -> code, by a plain pass: the first key is looked at first, and only rows that were kept count."""
    seen_a, seen_b, out = set(), set(), {}
    for n, a, b in sorted(rows):
        out[n] = "A" if a in seen_a else "B" if b in seen_b else None
        if out[n] is None:
            seen_a.add(a)
            seen_b.add(b)
    return out


def codes(spark, rows):
    df = spark.createDataFrame([("f", n, a, b, None) for n, a, b in rows], ROW)
    got = dedupe_two_keys(df, (["a"], "A", "first"), (["b"], "B", "second"))
    assert got.columns == df.columns
    return {r.row_no: r.issue.code if r.issue else None for r in got.collect()}


def test_codes_of_crosswise_duplicates(spark):
    # Row 4 shares its second key with row 1 and its first with row 3, which is kept only in the second round.
    rows = [(1, "p", "x"), (2, "p", "y"), (3, "q", "y"), (4, "q", "x")]
    assert codes(spark, rows) == in_order(rows) == {1: None, 2: "A", 3: None, 4: "A"}


def test_codes_of_random_batches(spark):
    r = random.Random(3)
    for size, keys in ((40, 6), (60, 25)):
        rows = [(n, f"a{r.randrange(keys)}", f"b{r.randrange(keys)}") for n in range(size)]
        assert codes(spark, rows) == in_order(rows)


def test_rows_with_an_issue_keep_it_and_reserve_nothing(spark):
    df = spark.createDataFrame([("f", 1, "p", "x", ("ERROR", "BAD", "bad")), ("f", 2, "p", "x", None), ("g", 3, "p", "x", None)], ROW)
    got = {r.row_no: r.issue.code if r.issue else None for r in dedupe_two_keys(df, (["a"], "A", ""), (["b"], "B", "")).collect()}
    assert got == {1: "BAD", 2: None, 3: None}
    assert dedupe_two_keys(df.where("row_no = 1"), (["a"], "A", ""), (["b"], "B", "")).count() == 1


GROUP = ("symbol string, isin string, source_filing_id string, facts bigint, inconsistent boolean, place struct<artifact_id:string,row_no:bigint>, "
         "supersedes_source_filing_id string, fingerprint string")


def merged(spark, filings, stored=(), **settings):
    """{filing: (action, code)} for filings (id, place, filing it revises, inconsistent)."""
    rows = [("S", "I", i, 1, bad, ("f", place), old, f"h{i}") for i, place, old, bad in filings]
    held = spark.createDataFrame(list(stored), "symbol string, source_filing_id string, fingerprint string, supersedes_source_filing_id string")
    out = merge.merge_filings(spark.createDataFrame(rows, GROUP), held, spark.createDataFrame([("S", "I")], "symbol string, isin string"), **settings)
    return {r.source_filing_id: (r.action, r.code) for r in out.collect()}


NEW, LOST, FORK = ("INSERT", None), ("REJECT", "SUPERSEDED_FILING_NOT_FOUND"), ("CONFLICT", "FILING_REVISION_CONFLICT")


def test_filing_and_its_revision_in_one_batch(spark):
    assert merged(spark, [("1", 1, None, False), ("2", 2, "1", False)]) == {"1": NEW, "2": NEW}
    assert merged(spark, [("1", 1, None, False), ("2", 2, "1", False)], in_batch=False) == {"1": NEW, "2": LOST}
    # a revision before what it revises, one of itself, two of each other
    assert merged(spark, [("2", 1, "1", False), ("1", 2, None, False), ("3", 3, "3", False), ("4", 4, "5", False), ("5", 5, "4", False)]) == {
        "1": NEW, "2": LOST, "3": LOST, "4": LOST, "5": LOST}


@pytest.mark.parametrize("length", [3, 9])
def test_long_chains_stand_or_fall_with_every_link(spark, length):
    chain = [(str(i), i, str(i - 1) if i else None, False) for i in range(length)]
    assert merged(spark, chain) == {str(i): NEW for i in range(length)}
    broken = [(i, p, old, i == "1") for i, p, old, _ in chain]
    assert merged(spark, broken) == {"0": NEW, "1": ("CONFLICT", "INCONSISTENT_FILING_METADATA"), **{str(i): LOST for i in range(2, length)}}


def test_of_rival_revisions_the_first_sound_one_is_inserted(spark):
    batch = [("1", 1, None, False), ("bad", 2, "1", True), ("b", 3, "1", False), ("c", 4, "1", False), ("d", 5, "c", False), ("e", 6, "b", False)]
    assert merged(spark, batch) == {
        "1": NEW, "bad": ("CONFLICT", "INCONSISTENT_FILING_METADATA"), "b": NEW, "c": FORK, "d": LOST, "e": NEW}


def test_what_is_stored_comes_first(spark):
    stored = [("S", "old", "x", None), ("S", "rev", "y", "old"), ("S", "same", "hsame", None)]
    batch = [("late", 1, "old", False), ("next", 2, "rev", False), ("after", 3, "next", False), ("same", 4, None, False), ("on", 5, "same", False), ("old", 6, None, False)]
    assert merged(spark, batch, stored) == {
        "late": FORK, "next": NEW, "after": NEW, "same": ("UNCHANGED", None), "on": NEW, "old": ("CONFLICT", "FILING_CONTENT_CONFLICT")}


def test_classification_rows_of_one_key(spark):
    schema = "series bigint, snapshot_date string, macro string, sector string, industry string, basic_industry string, row_no bigint"
    rows = spark.createDataFrame([(1, "d", "m", "s", "i", "b", 1), (1, "d", "m", "s", "i", "b", 2), (1, "d", "m", "s", "j", "b", 3)], schema)
    got = merge.merge_classification(rows, rows.where("false").drop("row_no"), rows.select("series").distinct(), {"s": "X"})
    assert [(r.action, r.code) for r in got.orderBy("row_no").collect()] == [
        NEW, ("UNCHANGED", None), ("CONFLICT", "CLASSIFICATION_SNAPSHOT_CONFLICT")]
    assert got.where(F.col("benchmark").isNull()).isEmpty()
