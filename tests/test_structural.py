"""Identities, neighbours, checked lanes, scorers and whole runs on small rows with known results."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quern.operators import expansion, identity, rerank, runs


def test_identity_doesnt_depend_on_partitions_but_on_every_place(spark):
    rows = spark.range(700).select(F.col("id"), (F.col("id") * 37 % 700).alias("place"), F.lit("g").alias("g"), F.lit("a b").alias("t"))
    one = identity.ordered_digest(rows.coalesce(1), "id", "place").first()
    assert one == identity.ordered_digest(rows.repartition(50), "id", "place").first()
    ids = [r.id for r in rows.orderBy("place").collect()]
    sha = lambda parts: hashlib.sha256(",".join(parts).encode()).hexdigest()
    leaves = [sha([str(i) for i in ids[k : k + identity.LEAF]]) for k in range(0, 700, identity.LEAF)]
    assert one.ordered_ids_sha256 == sha([sha(leaves)]) and one.ids == 700
    swapped = rows.withColumn("id", F.when(F.col("id") == 3, 4).when(F.col("id") == 4, 3).otherwise(F.col("id")))
    assert identity.ordered_digest(swapped, "id", "place").first().ordered_ids_sha256 != one.ordered_ids_sha256


def test_identity_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "x", None), (1, "x", " a  b"), (None, None, "é")], "id long, g string, t string")
    got = identity.corpus_identity(rows, "id", ("g",), "g", "t").first()
    assert (got.records, got.ids, got["groups"], got.bytes, got.tokens) == (3, 2, ":1,x:2", 7, 3)
    assert identity.corpus_identity(rows.limit(0), "id", ("g",), "g", "t").first().ordered_ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_near_articles(spark):
    rows = spark.createDataFrame([(a,) for a in ("Điều 1", " điều 10. Scope", "Điều 02", "Điều x", "Chapter 3", None)], "a string")
    got = [r[0] for r in rows.select(expansion.near_articles(F.col("a"))).collect()]
    assert got == [["Điều 1", "Điều 2"], [" điều 10. Scope", "Điều 9", "Điều 11"], ["Điều 02", "Điều 1", "Điều 3"], ["Điều x"], ["Chapter 3"], []]


SEEDS = "query_id long, rank int, record_id string, document_id long, article string"
RECORDS = "record_id string, document_id long, article string, seq int"


def test_neighbours_are_interleaved_after_each_seed(spark):
    records = spark.createDataFrame(
        [(f"{d}-{n}{p}", d, f"Điều {n}", k) for d in (1, 2) for n in (8, 9, 10, 11) for k, p in enumerate("ab")] + [("1-none", 1, None, 0)], RECORDS
    )
    seeds = [(5, 1, "1-9b", 1, "Điều 9"), (5, 2, "1-none", 1, None), (5, 3, "2-11a", 2, "Điều 11"), (5, 4, "1-10a", 1, "Điều 10"), (6, 1, "lone", 9, "Điều 1"), (7, 1, "1-none", 1, None)]
    got = expansion.expanded(spark.createDataFrame(seeds, SEEDS), records, 20).orderBy("query_id", "place").collect()
    # Articles in the order of their text: "Điều 10" before "Điều 8"; a record stays where it came first.
    assert [r.record_id for r in got if r.query_id == 5] == ["1-9b", "1-10a", "1-10b", "1-8a", "1-8b", "1-9a", "1-none", "2-11a", "2-10a", "2-10b", "2-11b", "1-11a", "1-11b"]
    assert [(r.record_id, r.place, r.verdict) for r in got if r.query_id != 5] == [("lone", 1, "ok"), ("1-none", 1, "ok")]
    tight = expansion.expanded(spark.createDataFrame(seeds, SEEDS), records, 11).collect()
    assert [tuple(r) for r in tight if r.query_id == 5] == [(5, None, None, "overflow")]
    assert {r.verdict for r in tight if r.query_id != 5} == {"ok"}
    assert expansion.expanded(spark.createDataFrame([], SEEDS), records, 5).collect() == []


def test_a_conflict_fails_its_query_alone(spark):
    lanes = [(1, "dense", 1, "a", "x"), (1, "dense", 2, "b", "x"), (1, "exact", 1, "b", "x"), (2, "dense", 1, "a", "x"), (2, "exact", 1, "a", "y"), (3, "dense", 1, "a", None), (3, "exact", 1, "a", "y"), (4, "dense", 1, "a", None)]
    got = expansion.checked_fusion(spark.createDataFrame(lanes, "query_id long, lane string, rank int, record_id string, payload string"), "payload").collect()
    assert sorted((r.query_id, r["rank"], r.record_id, r.verdict) for r in got if r.verdict == "ok") == [(1, 1, "b", "ok"), (1, 2, "a", "ok"), (4, 1, "a", "ok")]
    assert sorted((r.query_id, r.record_id, r.score) for r in got if r.verdict == "conflict") == [(2, None, None), (3, None, None)]


def test_malformed_answers_reject_their_query_alone(spark):
    class Broken(rerank.TermOverlap):
        """Answers by the query's own word."""

        def rank(self, query, texts, most):
            answers = {"none": [], "twice": [(0, 1.0), (0, 1.0)], "far": [(9, 1.0)], "nan": [(0, float("nan"))], "true": [(True, 1.0)], "text": [(0, "1")], "long": [(k, 1.0) for k in range(most + 1)]}
            return answers.get(query) if query in answers else super().rank(query, texts, most)

    words = ["none", "twice", "far", "nan", "true", "text", "long", "red fox", None]
    texts = ["a red hen", None, "red fox", "the fox"]
    rows = [(q, w, 10 * q + k, k, t) for q, w in enumerate(words) for k, t in enumerate(texts)]
    got = rerank.reranked(spark.createDataFrame(rows, "query_id long, query string, chunk_id long, place int, text string").repartition(3), Broken, 3).collect()
    by_query = {q: [(r.chunk_id - 10 * q, r.score, r.verdict) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in range(len(words))}
    for q, w in enumerate(words):
        if w not in ("red fox", None):
            assert by_query[q] == [(0, None, "rejected"), (1, None, "rejected"), (2, None, "rejected")], w
    assert by_query[7] == [(2, 1.0, "reranked"), (0, 0.5, "reranked"), (3, 0.5, "reranked")]
    assert by_query[8] == [(0, 0.0, "reranked"), (1, 0.0, "reranked"), (2, 0.0, "reranked")]
    least = rerank.reranked(spark.createDataFrame(rows, "query_id long, query string, chunk_id long, place int, text string"), Broken, 3, 0.6)
    assert [r.chunk_id for r in least.where("query_id = 7").collect()] == [72]


def run(spark, capacities, stages=("source", "final")):
    gold = spark.createDataFrame([(c, 1, c, None, "a", None, "article", True, "verified") for c in (1, 2)], "case_id long, evidence_id long, document_id long, document_number string, article string, clause string, required_level string, required boolean, status string")
    candidates = spark.createDataFrame([(1, s, k, d, None, "a", None) for s in stages for k, d in ((1, 9), (2, 1))], "case_id long, stage string, rank int, document_id long, document_number string, article string, clause string")
    cases = spark.createDataFrame(capacities, "case_id long, stage string, capacity int")
    return runs.report(gold, candidates, cases, stages, ("source",), "final", "final")


def test_a_run_is_aggregated(spark):
    rows = run(spark, [(1, "source", 5), (2, "source", None), (1, "final", 2), (2, "final", 2)]).collect()
    got = {(r.stage, r.measure, r.level, r.k): r for r in rows}
    assert got["final", "recall", "article", 1].macro == 0.0 and got["final", "recall", "document", 3].skip_reasons == "k_exceeds_configured_capacity:2"
    assert (got["source", "recall", "document", 3].macro, got["source", "recall", "document", 3].scored_cases) == (0.5, 2)
    assert got["source", "recall", "article", 3].skip_reasons == "stage_does_not_expose_structural_locators:2"
    assert got["final", "reciprocal_rank", "article", None].macro == 0.25 and got["final", "reciprocal_rank", "clause", None].skip_reasons == "no_applicable_gold:2"
    assert (got["final", "candidates", None, None].macro, got["source", "first_loss", None, None].numerator, got["final", "first_loss", None, None].numerator) == (1.0, 1.0, 0.0)
    assert got["run", "coverage", None, None].micro == 1.0 and got["run", "multi_hop_all", None, None].macro == 0.5
    assert {r.capacity for r in rows if r.stage == "source"} == {5} and {r.capacity for r in rows if r.stage == "final"} == {2}


@pytest.mark.parametrize(
    ("capacities", "says"),
    [
        ([(1, "source", 5), (2, "source", 5), (1, "final", 4), (2, "final", 6)], "inconsistent configured capacity for final"),
        ([(1, "source", 5), (2, "source", 5), (1, "final", 4)], "cases are missing, further or repeated"),
        ([(1, "source", 5), (2, "source", 5), (1, "final", 4), (3, "final", 4)], "cases are missing, further or repeated"),
        ([(1, "source", 5), (1, "source", 5), (1, "final", 4), (1, "final", 4)], "cases are missing, further or repeated"),
    ],
)
def test_a_run_that_breaks_its_rules_fails(spark, capacities, says):
    with pytest.raises(Exception, match=says):
        run(spark, capacities)


def test_an_empty_run(spark):
    assert run(spark, []).collect() == []
