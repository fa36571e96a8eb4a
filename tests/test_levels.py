"""Evidence levels, cases and records on small rows with known results."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import answers, cases, levels
from quern.sources import records

GOLD = "case_id long, evidence_id long, document_id long, document_number string, article string, clause string, required_level string"
CAND = "case_id long, stage string, rank int, document_id long, document_number string, article string, clause string"


def both(spark, gold, candidates):
    g, c = spark.createDataFrame(gold, GOLD), spark.createDataFrame(candidates, CAND)
    return g, levels.level_matches(g, c)


def test_wrong_clause_first(spark):
    gold, hits = both(
        spark,
        [(1, 1, 10, None, "Article 5", "2", "clause")],
        [(1, "final", 1, 10, None, "article  5", "1"), (1, "final", 2, 10, None, "Article 5.", "2."), (1, "final", 3, 11, None, "Article 5", "2")],
    )
    rr = {r.level: r.rr for r in levels.level_reciprocal_ranks(gold, hits, "final").collect()}
    assert rr == {"document": 1.0, "article": 1.0, "clause": 0.5}
    recall = {(r.level, r.k): (r.recall, r.reason) for r in levels.stage_recalls(gold, hits, {"final": 3}, ()).collect()}
    assert recall["clause", 1] == (0.0, None) and recall["clause", 3] == (1.0, None) and recall["clause", 6] == (None, "k_exceeds_configured_capacity")
    assert levels.greedy_ndcg(gold, hits, "final").first().ndcg == pytest.approx(0.6309)


def test_levels_inherit_and_fail_closed(spark):
    gold, hits = both(
        spark,
        [(1, 1, None, "12.", None, None, "article"), (1, 2, None, None, "a", None, "article"), (2, 3, 5, None, None, "1", "clause"), (3, 4, 5, None, None, None, "document")],
        [(1, "s", 1, None, "12", "a", None), (2, "s", 1, 5, None, "x", None), (None, "s", 1, 5, None, None, None)],
    )
    got = {(r.evidence_id, r.by_document, r.by_article, r.by_clause) for r in hits.collect()}
    assert got == {(1, True, True, True), (2, False, True, True), (3, True, True, False)}
    losses = {r.evidence_id: r.stage for r in levels.first_losses(gold, hits, ("s", "t"), ("s",)).collect()}
    assert losses == {1: "t", 2: "s", 3: "t", 4: "s"}
    bundle = {r.case_id: (r.required_n, r.found_n, r.all_required) for r in levels.case_bundle(gold, hits, "s").collect()}
    assert bundle == {1: (2, 2, True), 2: (1, 0, False), 3: (1, 0, False)}
    empty, none = both(spark, [], [])
    assert levels.stage_recalls(empty, none, {"s": 3}, ()).collect() == levels.greedy_ndcg(empty, none, "s").collect() == []


def test_one_candidate_serves_one_gold_item(spark):
    gold, hits = both(spark, [(1, 1, 5, None, None, None, "document"), (1, 2, 5, None, None, None, "document")], [(1, "s", 2, 5, None, None, None)])
    assert levels.greedy_ndcg(gold, hits, "s").first().ndcg == pytest.approx(0.6309 / 1.6309, abs=1e-4)


def test_cases_without_labels_meet_no_condition(spark):
    known = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "case_id long, answerable boolean")
    labels = spark.createDataFrame([(1, 1, True, "verified"), (2, 2, False, "verified"), (3, 3, True, "verified"), (4, 4, True, "verified"), (4, 5, True, None)], "case_id long, evidence_id long, required boolean, status string")
    ids = lambda df: [r.case_id for r in df.collect()]
    assert ids(cases.selected_cases(known, labels, "all-required-verified")) == [1]
    assert ids(cases.selected_cases(known, labels, "any-verified")) == [1, 2, 4]
    assert ids(cases.selected_cases(known, labels, "all-verified")) == [1, 2]
    assert ids(cases.selected_cases(known, labels, "none", include_unanswerable=True, limit=2)) == [1, 2]
    assert ids(cases.eligible_cases(known, labels)) == [4]
    with pytest.raises(ValueError):
        cases.selected_cases(known, labels, "some")


def test_plans_and_paths(spark):
    assert cases.sample_places("p", 10, 0) == {0, 9} and all(0 <= p < 10 for p in cases.sample_places("p", 10, 5))
    paths = {".env": True, "a/.ENV.local": True, ".env.example": False, "k/x.pem": True, "credentials.json": True, "x\\y.key": True, "readme.md": False, None: False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.s for r in df.select("p", cases.sensitive_path(F.col("p")).alias("s")).collect()} == paths
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "k long")
    assert {tuple(r) for r in cases.partition_faults(rows(1, 2, 3), [rows(1, 2), rows(2, 4)], "k").collect()} == {(2, "repeated"), (3, "missing"), (4, "foreign")}
    left, kids = cases.cascade(rows(1, 2), rows(1, 1, 2), rows(1), "k")
    assert [r.k for r in left.collect()] == [r.k for r in kids.collect()] == [2]


def test_json_contracts(spark, tmp_path):
    put = lambda name, x: (tmp_path / name).write_text(json.dumps(x)) and str(tmp_path / name)
    label = "case_id long, evidence_id long, status string".replace(" ", ":").replace(",:", ",")
    good = {"schema_version": 3, "total_cases": 1, "total_evidence_items": 2, "labels": [{"case_id": 1, "evidence_id": 1}, {"case_id": 1, "evidence_id": 2, "status": "verified"}]}
    assert records.sidecar(spark, put("good.json", good), label, 3).count() == 2
    for name, bad in (("version", good | {"schema_version": 2}), ("count", good | {"total_evidence_items": 3}), ("twice", good | {"labels": good["labels"][:1] * 2})):
        with pytest.raises(ValueError):
            records.sidecar(spark, put(f"{name}.json", bad), label, 3)
    assert records.cases(spark, put("cases.json", [{"question": "a", "numbers": ["1"]}, {"question": None}]), "question string, numbers array<string>").count() == 2
    (tmp_path / "log.json").write_text('{"a": 1}\nbroken\n{"b": 2}\n')
    assert sorted(map(str, (r.a for r in records.log_snapshot(spark, str(tmp_path / "log.json"), "a long").collect()))) == ["1", "None", "None"]


def test_contexts_and_salvage(spark):
    df = spark.createDataFrame([("[5/2020/A]\ntitle: T\nsource: https://x.y\nbody\n\nmore",), ("source: ftp://x\nonly",), (None,)], "c string")
    got = [r.p for r in df.select(answers.presented(F.col("c")).alias("p")).collect()]
    assert tuple(got[0]) == ("5/2020/A", "T", "https://x.y", "body\nmore") and got[1].url is None and got[1].excerpt == "only" and got[2].excerpt == ""
    df = spark.createDataFrame([('so ```json\n{"a": 1}\n``` end',), ('{"a": 2}',), ("none",), (None,)], "c string")
    assert [r.x and r.x.a for r in df.select(answers.salvaged_json(F.col("c"), "a long").alias("x")).collect()] == [1, 2, None, None]
