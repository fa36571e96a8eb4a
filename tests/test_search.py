"""Tiers, payloads and scores."""

from pyspark.sql import functions as F

from quern.operators import ranking, search


def test_second_tier_only_for_open_queries(spark):
    docs = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    first = docs((1, "a b c d"), (2, "x a b c"), (3, None))
    second = docs((4, "a b c"), (5, "p q r s"), (6, "p q r"), (7, "p q r t"))
    asked = spark.createDataFrame([(1, "a b c"), (2, "P q  r"), (3, "nowhere at all"), (4, None), (None, "a b c")], "query_id long, text string")
    got = search.tiered(asked, [("narrow", first), ("wide", second)], 2)
    assert sorted(map(tuple, got.collect())) == [(1, 1, "narrow", 1), (1, 2, "narrow", 2), (2, 5, "wide", 1), (2, 6, "wide", 2)]
    assert search.tiered(asked.where("false"), [("narrow", first)], 2).collect() == []


def test_payloads_must_agree_with_the_store(spark):
    hits = spark.createDataFrame(
        [
            (1, 1, 1, False, "r1", 1, "h1"), (1, 2, 2, False, "r0", 2, "h2"), (1, 3, 3, False, "r1", 9, "h3"), (1, 4, 4, False, "r1", 4, "old"), (1, 5, 5, True, None, None, None),
            (1, 6, 6, False, "r1", 6, "old"), (1, 6, 7, True, None, None, None), (1, 7, 8, False, "r1", 7, "h7"), (1, 8, 9, False, "r1", 8, None), (1, 9, 1, False, "r1", 9, "h9"), (1, 9, 2, False, "r1", 9, "old"),
        ],
        "query_id long, doc_id long, rank int, lexical boolean, revision string, store_key long, content_sha256 string",
    )
    store = spark.createDataFrame([(i, f"h{i}") for i in (1, 2, 3, 4, 5, 6, 8, 9)], "doc_id long, content_sha256 string")
    assert sorted(map(tuple, search.valid_hits(hits, store, "r1").collect())) == [(1, 1, False), (1, 5, True), (1, 6, True), (1, 9, False)]


def test_only_finite_scores_count(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 0.5, float("nan"), float("inf"), float("-inf"), None)], "s double")
    assert [r.u for r in df.select(search.usable(F.col("s"), 1.0).alias("u")).collect()] == [True, False, False, False, False, False]
    items = [(float("nan"), "1", 1, 1), (float("inf"), "2", 1, 2), (3.0, "3", 1, 3)]
    held = spark.createDataFrame([(items,)], "items array<struct<score:double,group:string,tokens:long,id:long>>")
    assert [h.id for h in held.select(ranking.within_budget(F.col("items"), 9, 1.0, 1, 3).alias("x")).first().x.held] == [3]
