"""Small cases of the reference's operators."""

import random

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers, corpus, gates, measures, ranking, sampling
from quern.streaming import breaker, ingest


def lanes(spark, rows):
    return spark.createDataFrame(rows, "query_id long, lane string, rank int, doc_id long")


def test_fusion_orders_by_reciprocal_ranks(spark):
    got = ranking.fused(lanes(spark, [(1, "dense", 1, 1), (1, "dense", 2, 2), (1, "bm25", 1, 2), (1, "bm25", 2, 3), (1, "exact", 1, 3), (1, "exact", 5, 3)]))
    assert [r.doc_id for r in got.orderBy("rank").collect()] == [3, 2, 1]


def test_interleaving_and_merging(spark):
    a = lanes(spark, [(1, "a", i + 1, i + 1) for i in range(12)])
    b = lanes(spark, [(1, "b", i + 1, 101 + i) for i in range(11)] + [(1, "b", 12, 1)])
    ids = lambda df: [r.doc_id for r in df.orderBy("rank").collect()]
    assert ids(ranking.interleaved(a, b, 6)) == [1, 101, 2, 102, 3, 103]
    assert ids(ranking.merged(b, a, 14)) == [*range(101, 112), 1, 2, 3]


def test_budget_passes_over_what_does_not_fit(spark):
    items = [(5.0, "1", 120, 1), (4.0, "1", 120, 2), (3.0, "2", 500, 3), (2.0, "2", 120, 4), (0.5, "3", 1, 5)]
    df = spark.createDataFrame([(items,)], "items array<struct<score:double,group:string,tokens:long,id:long>>")
    got = df.select(ranking.within_budget(F.col("items"), 250, 1.0, 1, 3).alias("x")).first().x
    assert got.used == 240 and [h.id for h in got.held] == [1, 4]


def test_containment_against_brute_force(spark):
    rnd = random.Random(2)
    words = ["ab", "abc", "b", "bca", "cc", "d\n", "E"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(80)] + [(200, None), (201, "")]
    asked = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 5)))) for i in range(40)] + [(99, None)]
    flat = lambda t: " ".join((t or "").lower().split())
    want = {(q, d) for q, a in asked for d, t in docs if flat(a) and flat(a) in flat(t)}
    got = ranking.containment(spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want


def test_windows_stop_at_the_end(spark):
    df = spark.createDataFrame([(["a"] * n,) for n in (0, 1, 4, 5, 9)], "t array<string>")
    got = [[len(w) for w in r.w] for r in df.select(T.windows(F.col("t"), 4, 1).alias("w")).collect()]
    assert got == [[], [1], [4], [4, 2], [4, 4, 3]]


def test_normalisation_and_redaction(spark):
    row = spark.createDataFrame([("﻿ a b\r\n\r\n\r\n\r\nc\t d \n e ", "x a.b@c.de 0912345678 +84912345678 123456789 1234567890", "u?token=abc&x=1 Bearer a.b-c mongodb://me:pw@host")], "a string, b string, c string")
    got = row.select(T.normalized(F.col("a")).alias("a"), T.redact_contacts(F.col("b")).alias("b"), T.redact_secrets(F.col("c")).alias("c")).first()
    assert got.a == "a b\n\nc d\ne"
    assert got.b == "x [EMAIL] [PHONE] [PHONE] [ID] 1234567890"
    assert got.c == "u?token=[REDACTED]&x=1 Bearer [REDACTED] mongodb://me:[REDACTED]@host"


def test_undefined_is_not_zero(spark):
    cases = spark.createDataFrame([(1,), (2,)], "query_id long")
    found = spark.createDataFrame([(1, 5, 2), (1, 6, None)], "query_id long, doc_id long, rank int")
    got = {(r.query_id, r.k): (r.recall, r.reason) for r in measures.recall_at(cases, found, (1, 3, 30), 24).collect()}
    assert got[1, 1] == (0.0, None) and got[1, 3] == (0.5, None)
    assert got[1, 30] == (None, "k_exceeds_configured_capacity") and got[2, 3] == (None, "no_gold")
    macro = {r.k: (r.macro, r.micro, r.n_undefined) for r in measures.macro_micro(measures.recall_at(cases, found, (3, 30), 24)).collect()}
    assert macro == {3: (0.5, 0.5, 1), 30: (None, None, 2)}


def test_answer_measures(spark):
    df = spark.createDataFrame([("the cat", "The cat!"), ("", ""), ("a", None), ("a b c d", "a x c d")], "a string, b string")
    got = df.select(answers.token_f1(F.col("a"), F.col("b")).alias("t"), answers.gram_f1(F.col("a"), F.col("b")).alias("g"), answers.rouge_l(F.col("a"), F.col("b")).alias("r"), answers.chrf(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.t for r in got] == [1.0, 1.0, 0.0, 0.75]
    assert [r.r for r in got] == [1.0, 1.0, 0.0, 0.75]
    assert got[0].g == got[0].c == got[1].c == 1.0 and got[2].c == 0.0


def test_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(200):
        x, y = ([rnd.choice("abc") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        assert answers._longest_common(x, y) == table[-1][-1]


def test_ties_have_no_winner(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "profile string, k int, recall double")
    assert gates.winner(rows(("a", 3, 0.5), ("b", 3, 0.4), ("a", 9, None))).first().winner == "a"
    assert gates.winner(rows(("a", 3, 0.5), ("b", 3, 0.5))).first().winner is None
    assert gates.winner(rows(("a", 3, 0.0), ("b", 3, 0.0))).first().winner is None


def test_quartiles_and_flags_of_odd_rows(spark):
    rows = spark.createDataFrame([(i, "g") for i in range(5)], "id long, g string")
    assert [r.bucket for r in sampling.quartiles(rows, "g", "id").orderBy("id").collect()] == [0, 0, 1, 2, 3]
    docs = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "x" * 50, "s"), (4, "x" * 50 + " ", "s"), (5, "Ã© " * 30, "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r.quality_flags for r in corpus.flagged(docs).collect()}
    assert got == {1: ["duplicate_content_hash", "empty_content", "missing_source_url"], 2: ["duplicate_content_hash", "empty_content"], 3: ["duplicate_content_hash"], 4: ["duplicate_content_hash"], 5: ["encoding_damage"]}


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_breaker_streams_as_it_replays(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=10 * i), i % 2, "error" if i % 7 < 5 else "view", 1.0) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    batch = {r.user_id: tuple(r) for r in breaker.replay(spark.createDataFrame(rows, EVENTS), 2, 60.0).collect()}
    assert any(r[2] > 0 and r[3] > 0 for r in batch.values())
    last = {}

    def keep(df, _):
        last.update({r.user_id: tuple(r) for r in df.collect()})

    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = breaker.stream(source, 2, 60.0).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert last.keys() == batch.keys() and all(last[u][1] == batch[u][1] for u in batch)


def test_ingest_holds_each_key_once(spark, tmp_path):
    put = lambda ids, k: spark.createDataFrame([(i, str(i)) for i in ids], "id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(range(5), 0)
    put(range(3, 8), 1)
    go = lambda: ingest.ingest(spark, f"{tmp_path}/in", "id long, text string", f"{tmp_path}/out", f"{tmp_path}/check", "id", 1).awaitTermination(120)
    go()
    put(range(7, 10), 2)
    go()
    got = [r.id for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect()]
    assert sorted(got) == list(range(10))


def test_integrity_both_ways(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k long") for xs in ([1, 1, 2], [2, 3]))
    assert {tuple(r) for r in corpus.integrity(a, b, "k", "k").select("side", "key").collect()} == {("left_only", 1), ("right_only", 3)}
    assert tuple(corpus.set_difference(a, b, "k").first()) == (1, 1, 1)


def test_ingest_refuses_another_row_of_a_key(spark, tmp_path):
    import pytest

    put = lambda rows: spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go = lambda: ingest.ingest(spark, f"{tmp_path}/in", "id long, text string", f"{tmp_path}/out", f"{tmp_path}/check", "id", 1).awaitTermination(120)
    put([(1, "a"), (2, "b")])
    go()
    put([(1, "a"), (3, "c")])
    go()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out/batch=*").collect()) == [1, 2, 3]
    put([(2, "other")])
    with pytest.raises(Exception, match="another row"):
        go()


def test_samples_of_many_rows_are_right_twice(spark):
    rows = spark.range(2_000_000).select((F.col("id") * 7919 % 2_000_000).alias("id")).repartition(7)
    for _ in range(2):
        assert sorted(r.id for r in sampling.systematic(rows, "id", 13).collect()) == [i * 2_000_000 // 13 for i in range(13)]
        assert sorted(r.id for r in sampling.evenly_spaced(rows, "id", 17).collect()) == [i * 1_999_999 // 16 for i in range(17)]


def test_containment_by_windows(spark):
    words = [f"w{i}" for i in range(30)]
    anchor = " ".join(words)
    changed = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(words))
    texts = [anchor, changed(2), changed(2, 28), changed(20), " ".join(words[:12]) + " and " + " ".join(words[-12:]), " ".join(words[:12]), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(1, anchor), (2, " ".join(words[:19]))], "query_id long, text string")
    assert sorted(map(tuple, ranking.containment(asked, docs).collect())) == [(1, 0), (1, 1), (1, 4), (2, 0), (2, 3)]


def test_queries_beyond_one_block(spark):
    table = spark.range(10)
    parts = ranking.blocks(table, 24)  # bytes: a row is eight as JSON
    assert len(parts) == 4 and sorted(r.id for r in ranking.together(parts).collect()) == list(range(10))


def test_lanes_merge_with_conflicts(spark):
    rows = lanes(spark, [(1, "a", 1, 7), (1, "b", 2, 7), (1, "b", 1, 8)]).withColumn("payload", F.concat("doc_id", F.when(F.col("lane") == "b", "x").otherwise("y")))
    got = {r.doc_id: (r.ranks, r.conflict) for r in ranking.merged_lanes(rows, "payload").collect()}
    assert got == {7: ({"a": 1, "b": 2}, True), 8: ({"b": 1}, False)}
