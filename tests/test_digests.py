"""Digests that combine, and the run log."""

from tapewright.operators import repro


def digest_of(frame):
    return repro.multiset_digest(repro.row_fingerprint(frame, ("k", "v"))).first().digest


def test_order_and_partitions_do_not_matter_but_every_row_does(spark):
    rows = [(i % 5, i * i) for i in range(200)]
    make = lambda r, n: spark.createDataFrame(r, "k long, v long").repartition(n)
    first = digest_of(make(rows, 1))
    assert first == digest_of(make(rows[::-1], 7))
    assert len({first, digest_of(make(rows[1:], 3)), digest_of(make(rows + rows[:1], 3)), digest_of(make([(0, 1)] + rows[1:], 3)), digest_of(make([], 1))}) == 1 + 3 + (rows[0] != (0, 1))


def test_no_group_is_gathered(spark):
    frame = repro.row_fingerprint(spark.range(10).selectExpr("id % 2 AS k", "id AS v"), ("k", "v"))
    plan = repro.multiset_digest(frame, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "collect_list" not in plan and "Python" not in plan and "InArrow" not in plan


def test_prefixes_are_digests_of_what_came_before(spark):
    frame = spark.createDataFrame([(s, d, d * s) for s in (1, 2) for d in range(6)], "series long, session int, v long")
    got = {(r.series, r.session): r.prefix_digest for r in repro.prefix_digest(frame, ("series", "session", "v")).collect()}
    for (s, d), digest in got.items():
        some = repro.row_fingerprint(frame.where(f"series = {s} AND session <= {d}"), ("series", "session", "v"))
        assert repro.multiset_digest(some).first().digest == digest
    assert len(set(got.values())) == 12


def test_a_run_is_logged_once_and_never_changed(spark):
    log = spark.createDataFrame([(1, "e", "a"), (2, "e", None)], "run_id long, experiment string, sha256 string")
    runs = spark.createDataFrame([(1, "e", "a"), (1, "e", "b"), (2, "e", None), (3, "e", "c"), (3, "e", "c"), (4, "e", "c"), (4, "e", "d")], log.schema)
    got = sorted((r.run_id, r.sha256 or "", r.outcome) for r in repro.append_run(log, runs).collect())
    assert got == [(1, "a", "ALREADY_LOGGED"), (1, "b", "RUN_ID_CONFLICT"), (2, "", "ALREADY_LOGGED"), (3, "c", "ALREADY_LOGGED"), (3, "c", "APPENDED"),
                   (4, "c", "APPENDED"), (4, "d", "RUN_ID_CONFLICT")]
