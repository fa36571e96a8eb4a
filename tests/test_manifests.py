"""Fingerprints, capacities, decisions and reports on small rows with known results."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quern.operators import manifests


def test_fingerprints_are_those_of_sorted_json(spark):
    rows = [(1, 'a "b"\\ \n é', True, None), (2, "", False, 7), (3, None, None, -1)]
    df = spark.createDataFrame(rows, "id int, `b.name` string, flag boolean, a long")
    got = {r.id: r.fingerprint for r in manifests.fingerprints(df, ("flag", "b.name", "a")).collect()}
    for i, name, flag, a in rows:
        text = json.dumps({"flag": flag, "b.name": name, "a": a}, ensure_ascii=False, sort_keys=True)
        assert got[i] == hashlib.sha256(text.encode()).hexdigest()
    assert {r.fingerprint for r in manifests.fingerprints(df, ()).collect()} == {hashlib.sha256(b"{}").hexdigest()}
    with pytest.raises(TypeError, match="only text"):
        manifests.fingerprints(df.withColumn("x", F.lit(0.5)), ("x",))


def test_suite_changes_with_order_case_and_configuration_but_not_with_partitions(spark):
    cases = spark.createDataFrame([(i, f"question {i}", None if i % 7 else "x") for i in range(700)], "id int, query string, truth string")
    digest = lambda df, configuration="{}": manifests.suite_fingerprint(df, "id", ("query", "truth"), configuration).first()
    first = digest(cases)
    assert first.cases == 700 and first == digest(cases.repartition(13)) == digest(cases.union(cases.limit(5)))
    swapped = cases.withColumn("id", F.when(F.col("id") == 3, 4).when(F.col("id") == 4, 3).otherwise(F.col("id")))
    others = [swapped, cases.where("id <> 699"), cases.withColumn("truth", F.when(F.col("id") == 699, "y").otherwise(F.col("truth")))]
    found = [first.fingerprint, digest(cases, "{1}").fingerprint, *(digest(o).fingerprint for o in others)]
    assert len(set(found)) == len(found)
    assert digest(cases.limit(0)).cases == 0


def test_capacities(spark):
    columns = ("name", "structural", *manifests.LIMITS, *manifests.STRUCTURAL_LIMITS)
    index = (64, 48, 24, 20, 6, 4)
    rows = [("plain", False, 24, 24, 16, 4, 24, 3, 3, *index), ("open", None, None, 24, None, 4, None, 3, 3, *index), ("index", True, 24, 24, 16, 4, 24, 3, 3, *index)]
    df = spark.createDataFrame(rows, f"name string, structural boolean, {', '.join(f'{c} int' for c in columns[2:])}")
    found = manifests.stage_capacities(df.withColumn("dense", F.lit("clash")), "name")
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == {
        "plain": (24, 24, 48, 16, None, 64, 24, 3, 3), "open": (24, None, None, None, None, None, None, 3, 3), "index": (64, 48, 24, 24, 24, None, 20, 6, 4),
    }
    assert manifests.by_stage(found, "name").where("stage = 'final' AND name = 'index'").collect()[0].capacity == 4
    assert manifests.by_stage(found.limit(0), "name").collect() == []


def test_decisions(spark):
    good = dict(scope_errors=0, technical_errors=0, drift=False, document=1.0, article=0.95, clause=0.9, required=0.95, no_candidate=0.0, retrieval_error=0.0, reranker_error=0.0)
    changes = {
        "PASS_PILOT": [{}, {"drift": None, "scope_errors": None, "reranker_error": None}],
        "FAIL_QUALITY": [{"document": 0.999}, {"article": 0.94}, {"clause": None}, {"required": 0.9}, {"no_candidate": 0.01}, {"retrieval_error": 0.1}, {"reranker_error": 1.0}],
        "BLOCKED_TECHNICAL": [{"technical_errors": 1, "document": 0.0}, {"drift": True}],
        "BLOCKED_SCOPE": [{"scope_errors": 2, "technical_errors": 1}],
    }
    rows = [(want, *(good | change).values()) for want, some in changes.items() for change in some]
    kinds = "want string, scope_errors int, technical_errors int, drift boolean, document double, article double, clause double, required double, no_candidate double, retrieval_error double, reranker_error double"
    found = manifests.pilot_decisions(spark.createDataFrame(rows, kinds), "want").collect()
    assert len(found) == len(rows) and all(r.want == r.decision for r in found)


def test_markdown(spark):
    kinds = "stage string, measure string, level string, k int, macro double, micro double, scored_cases long, skipped_cases long, skip_reasons string"
    rows = [("final", "recall", "document", 3, 0.5, None, 2, 1, "no_gold:1"), ("dense", "recall", "document", 10, 0.25, 1.0, 3, 0, ""), ("dense", "recall", "document", 3, 0.25, 0.33335, 3, 0, ""), ("run", "ndcg", None, None, None, None, 0, 0, "")]
    assert manifests.markdown_text(spark.createDataFrame(rows, kinds).repartition(3), "Title").split("\n") == [
        "# Title", "", "## ndcg", "", "| stage | level | k | macro | micro | scored | skipped for |", "|-|-|-|-|-|-|-|", "| run | - | - | N/A | N/A | 0/0 | - |", "",
        "## recall", "", "| stage | level | k | macro | micro | scored | skipped for |", "|-|-|-|-|-|-|-|",
        "| dense | document | 3 | 0.2500 | 0.3334 | 3/3 | - |", "| dense | document | 10 | 0.2500 | 1.0000 | 3/3 | - |", "| final | document | 3 | 0.5000 | N/A | 2/3 | no_gold:1 |", "",
    ]
    assert manifests.markdown_text(spark.createDataFrame([], kinds), "Empty") == "# Empty\n"
