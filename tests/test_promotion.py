"""Promotion previews and code checks on small rows."""

from pyspark.sql import functions as F

from quern.operators import cases, promotion


def test_decisions_change_their_labels_alone(spark):
    labels = spark.createDataFrame(
        [(1, 1, "pending", True, "x"), (1, 2, "verified", True, "x"), (2, 1, "pending", True, None), (2, 2, None, None, "x"), (3, 1, "pending", False, "x"), (None, 1, "pending", True, "x"), (1, 1, "pending", True, "x")],
        "case_id long, evidence_id long, status string, required boolean, new_status string",
    )
    decisions = spark.createDataFrame([(1, 1, "verified"), (2, 1, None), (9, 9, "verified"), (None, 1, "rejected"), (None, 1, "pending")], "case_id long, evidence_id long, new_status string")
    after = promotion.promoted(labels, decisions)
    assert after.columns == [*labels.columns, "before_status"] and after.count() == 7
    assert sorted(map(tuple, promotion.differences(after).collect()), key=str) == sorted([(1, 1, "pending", "verified")] * 2 + [(None, 1, "pending", "rejected")], key=str)
    assert {r.status: (r.n_before, r.n_after) for r in promotion.status_counts(after).collect()} == {"pending": (5, 2), "verified": (1, 3), "rejected": (0, 1), None: (1, 1)}
    assert {r.case_id: r.verified for r in promotion.verified_cases(after).collect()} == {1: True, 2: False, 3: True, None: False}
    none = promotion.promoted(labels.where("false"), decisions)
    assert promotion.status_counts(none).collect() == [] and promotion.verified_cases(none).collect() == []


def test_code_checks_and_timings(spark):
    df = spark.createDataFrame([("ok", False, 2, 0), ("cache_hit", True, 0, 1), (None, None, None, None)], "s string, e boolean, c int, n int")
    got = [[(x.check, x.passed, x.value) for x in r.x] for r in df.select(cases.code_checks(F.col("s"), F.col("e"), F.col("c"), F.col("n")).alias("x")).collect()]
    assert [[p for _, p, _ in r] for r in got] == [[True, True, False], [False, False, True], [False, False, False]]
    assert got[2][0] == ("request_completed", False, "unobserved") and got[2][1][2] == "0"
    steps = spark.createDataFrame([({"b": 1.23456, "a": None, "c": 2.0},), ({},), (None,)], "m map<string,double>")
    got = [None if r.x is None else [tuple(x) for x in r.x] for r in steps.select(cases.timings(F.col("m"), ("c", "b", "a")).alias("x")).collect()]
    assert got == [[("c", 2.0), ("b", 1.2346)], [], []]
