"""What keeps the memory, disk and time of a query in proportion to its input."""

from pyspark.sql import functions as F

from quern.operators import ranking


def test_lexical_pairs_stay_with_their_document_in_tasks_of_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TASK_PAIRS", 50)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("one two two three").alias("text"))
    queries = spark.createDataFrame([(1, "two one"), (2, "three four"), (3, "x")], "query_id long, text string")
    found = ranking.lexical_lane(queries, docs, top=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "REPARTITION_BY_NUM" in plan and ", 12)" in plan
    assert plan.count("hashpartitioning(") == 2  # by document, and what is left of each query
    assert [tuple(r)[:2] for r in found.orderBy("query_id", "rank").collect()] == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_a_whole_phrase_without_terms_still_scores(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "ab a")], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "a b"), (8, "ab")], "query_id long, text string")
    rows = ranking.lexical_lane(queries, docs, phrase_bonus=8.0).orderBy("query_id").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in rows] == [(7, 1, 8.0), (8, 2, 9.0)]


def test_titles_that_are_alike_are_scored_once(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "red bolt").otherwise("bolt new bolt").alias("text"))
    queries = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), F.concat("text", F.lit(" unheard"), F.col("doc_id").cast("string")).alias("text"))
    written, made = ranking.written, {}
    try:
        ranking.written = lambda df, label: made.setdefault(label, written(df, label)) if label in ("classes", "members", "found") else written(df, label)
        rows = ranking.bm25(queries, docs, 3).orderBy("query_id", "rank").collect()
    finally:
        ranking.written = written
    assert [made[k].count() for k in ("classes", "members", "found")] == [2, 6, 3]
    assert len(rows) == 900 and [r.doc_id for r in rows[:6]] == [0, 2, 4, 0, 2, 4]


def test_numbers_of_five_digits_are_named_by_neither_query_nor_sql(spark, tmp_path):
    import duckdb

    from quern.plans import catalogue

    parts = spark.createDataFrame([(k, f"name{k}") for k in (9_950, 10_000, 19_900, 20_000)], "p_partkey long, p_name string")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    rows = catalogue.QUERIES["numbers_first"](spark, str(tmp_path)).select("query_id", "doc_id", "rank", "by_number").collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(f"SELECT query_id, doc_id, rank, by_number FROM ({catalogue.ORACLE_SQL['numbers_first']})").fetchall())
    assert [r.query_id for r in rows if r.by_number] == [19_900]


def test_the_driver_never_holds_the_plan_of_a_whole_report(spark):
    from quern.plans.structural import run_report

    plan = run_report(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 8 and len(plan) < 40_000


def test_scores_by_matrices_equal_those_by_pairs_and_shuffle_few_rows(spark, monkeypatch):
    from quern.operators import vectors

    monkeypatch.setattr(vectors, "HELD_SCORES", 64)
    odd = [(900, [1.0, None], 1), (901, [float("nan"), 1.0], 2), (902, [1.0], 1), (903, None, 1), (904, [0.0, 0.0], None), (None, [1.0, 1.0], 1)]
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 3) - 1], k % 4 or None) for k in range(300)] + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    queries = rows.where("vec_id % 50 = 0 OR vec_id > 900").withColumnRenamed("vec_id", "query_id")
    order = F.desc("score"), F.asc("vec_id")
    told = lambda df: sorted(map(repr, df.select("query_id", "vec_id", "label", "q_label", "score", "rank").collect()))
    assert told(vectors.nearest(queries, rows, 4)) == told(ranking.ranked(vectors.scored(queries, rows), 4, *order))
    blend = F.round(0.75 * F.col("score") + 0.25 * (F.col("label") == F.col("q_label")).cast("double"), 6)
    assert told(vectors.hybrid(queries, rows, 0.75, 4)) == told(ranking.ranked(vectors.scored(queries, rows).withColumn("score", blend), 4, *order))
    good = rows.where("vec_id < 300")
    assert vectors._best(good.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), good, 4).count() < 6 * 4 * 4


def test_late_interaction_by_matrices_equals_that_by_pairs(spark, monkeypatch):
    from quern.operators import vectors

    monkeypatch.setattr(vectors, "HELD_SCORES", 32)
    odd = [(900, [1.0, None], 1), (901, [float("nan"), 1.0], 2), (902, [1.0], 7), (903, None, 8), (904, [0.0, 0.0], None)]
    rows = spark.createDataFrame([(k, [float(k % 7) - 3, float(k % 3) - 1], k % 4 or None) for k in range(300)] + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    parts = rows.where("vec_id % 50 = 0 OR vec_id > 900").select(F.floor(F.col("vec_id") / 100).alias("query_id"), F.col("vec_id").alias("part"), F.col("embedding").alias("q"))
    pairs = parts.crossJoin(rows.select("label", vectors.doubles(F.col("embedding")).alias("v")))
    best = pairs.groupBy("query_id", "part", "label").agg(F.max(vectors.dot(vectors.doubles(F.col("q")), F.col("v"))).alias("best"))
    told = lambda df: sorted(map(repr, df.collect()))
    assert told(vectors.max_sim(parts, rows)) == told(best.groupBy("query_id", "label").agg(F.round(F.sum("best"), 6).alias("score")))
    good = rows.where("vec_id < 300")
    plan = vectors.max_sim(parts.where("part < 300"), good)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_cases_and_documents_of_one_key_meet_in_blocks_and_are_never_shuffled_as_pairs(spark, monkeypatch):
    from quern.operators import evidence

    monkeypatch.setattr(evidence, "BLOCK_ROWS", 8)
    meta = [(k, f"u{k % 2}" if k < 60 else None, f"N {k % 5}") for k in range(70)] + [(3, "u1", "n 3"), (3, "u0", None), (None, "u1", "N 9")]
    hints = [(k, k if k % 9 == 0 else None, f" u{k % 3} " if k % 2 else "", f"n{k % 8}") for k in range(60)] + [(1, None, "u0", None), (1, None, "u0", None), (7, None, None, "n1"), (80, None, None, "x"), (None, 3, "u1", "n1")]
    lexical = [(80, 5), (80, 5), (80, 6), (99, 1), (9, 1)]
    number = lambda x: "".join(x.split()).upper() if x else ""
    found: dict = {}
    for case, i, u, n in hints:
        for d, v, m in meta:
            for way, same in ((1, i is not None and i == d), (2, (u or "").strip() not in ("",) and (u or "").strip() == v), (3, number(n) != "" and number(n) == number(m))):
                if same and case is not None:
                    found.setdefault(case, set()).add((way, d))
    for case, d in lexical:
        found.setdefault(case, set()).add((4, d))
    names = {1: "exact_doc_id", 2: "exact_source_url", 3: "exact_metadata_doc_number", 4: "lexical_candidate_fallback"}
    want = []
    for case, *_ in hints:
        least = min((w for w, _ in found.get(case, ())), default=None)
        want += [(case, d, names[w], w < 4) for w, d in found.get(case, ()) if w == least] or [(case, None, "not_applicable", True)]
    got = evidence.resolve_identities(
        spark.createDataFrame(hints, "case_id long, document_id long, source_url string, document_number string"),
        spark.createDataFrame(meta, "document_id long, source_url string, document_number string"), spark.createDataFrame(lexical, "case_id long, document_id long"),
    )
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    one = spark.range(300).select(F.col("id").alias("case_id"), F.lit(None).cast("long").alias("document_id"), F.lit("u").alias("source_url"), F.lit(None).cast("string").alias("document_number"))
    all_of_one = evidence.resolve_identities(one, one.select(F.col("case_id").alias("document_id"), "source_url", "document_number"))
    blocks = [line for line in all_of_one._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode(documents" in line]
    assert blocks and all_of_one.count() == 90_000


def test_lanes_are_scored_once_for_what_is_before_and_after_fusion(spark, monkeypatch):
    from quern.plans import catalogue

    made = []
    for name in ("lexical_lane", "containment"):
        monkeypatch.setattr(ranking, name, lambda *a, _name=name, _made=getattr(ranking, name), **k: made.append(_name) or _made(*a, **k))
    for name in ("reranker_delta", "winner_by_recall"):
        made.clear()
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert sorted(made) == ["containment", "lexical_lane"]


def test_levels_of_a_case_are_measured_with_one_shuffle_of_its_lines(spark):
    from quern.plans import catalogue

    shuffles = {}
    for name in ("level_match", "required_level_match", "level_recall", "stage_metrics", "level_mrr", "greedy_ndcg", "level_first_loss", "case_metrics"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "evidence-" not in plan
        shuffles[name] = sum("Exchange hashpartitioning(l_orderkey" in line for line in plan.splitlines()), plan.count("Exchange")
    assert all(lines == 1 for lines, _ in shuffles.values())
    assert {name for name, (_, n) in shuffles.items() if n > 1} == {"required_level_match", "stage_metrics"}  # these add up what is left of all cases


def test_a_report_writes_what_is_counted_once(spark, monkeypatch):
    from quern.operators import runs
    from quern.plans.structural import run_report

    made, written = [], runs.written
    monkeypatch.setattr(runs, "written", lambda df, label: made.append((label, df)) or written(df, label))
    rows = run_report(spark, "/root/testdata/sf0.001").collect()
    plan = made[0][1]._jdf.queryExecution().executedPlan().toString()
    assert [label for label, _ in made] == ["counts"] and "Join" not in plan
    assert len(rows) == 162


def test_a_case_without_id_meets_no_candidate(spark):
    from quern.operators import levels

    gold = spark.createDataFrame([(None, 1, 5, None, None, None, "document"), (2, 1, 5, None, None, None, "document")], "case_id long, evidence_id long, document_id long, document_number string, article string, clause string, required_level string")
    found = spark.createDataFrame([(None, "s", 1, 5, None, None, None), (2, "s", 1, 5, None, None, None)], "case_id long, stage string, rank int, document_id long, document_number string, article string, clause string")
    cases = levels.judged(levels.listed_gold(gold).withColumnRenamed("case_id", "c").join(levels.listed_candidates(found).withColumnRenamed("case_id", "c2"), F.col("c").eqNullSafe(F.col("c2"))).withColumnRenamed("c", "case_id"))
    assert {r.case_id: r.found_n for r in levels.case_bundle(None, cases, "s").collect()} == {None: 0, 2: 1}
    assert [r.case_id for r in levels.level_matches(gold, found).collect()] == [2]


def test_a_cache_scored_by_matrices_answers_as_one_scored_by_pairs(spark, monkeypatch):
    from quern.operators import search, vectors

    monkeypatch.setattr(vectors, "HELD_SCORES", 64)
    odd = [(900, [1.0, None], "r1"), (901, [float("nan"), 1.0], "r1"), (902, [1.0], "r1"), (903, None, "r1"), (904, [0.0, 0.0], "r1"), (None, [1.0, 5.0], "r1"), (7, [5.0, 1.0], "r1")]
    every = [(k, [float(k % 7) - 3, float(k % 11) - 5], f"r{k % 3 % 2}") for k in range(300)]
    for rows in (every + odd, every):
        entries = spark.createDataFrame(rows, "entry_id long, embedding array<float>, revision string").withColumn("response", F.concat(F.lit("a "), F.to_json(F.struct("entry_id", "embedding")))).repartition(3)
        asked = entries.where("entry_id % 13 = 0 OR entry_id > 900").select(F.col("entry_id").alias("query_id"), F.transform("embedding", lambda x: x + 0.25).alias("embedding"))
        score = F.round(vectors.cosine(vectors.doubles(F.col("q")), vectors.doubles(F.col("embedding"))), 6)
        pairs = entries.where("revision = 'r1'").join(asked.withColumnRenamed("embedding", "q"), score >= 0.9).select("query_id", "entry_id", score.alias("score"), "response")
        told = lambda df: sorted(map(repr, df.collect()))
        found = search.cache_lookup(asked, entries, "r1", 0.9)
        assert told(found) == told(ranking.ranked(pairs, 1, F.desc("score"), F.asc("entry_id")).drop("rank"))
    plan = vectors.closest(asked, entries.withColumnRenamed("entry_id", "vec_id"), 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan


def test_sparse_vectors_shuffle_no_terms_and_hold_texts_that_span_batches(spark):
    from quern.operators import sparse

    docs = spark.createDataFrame([(k % 7, " ".join(f"t{(k * j) % 13}" for j in range(k))) for k in range(1, 40)] + [(None, "a b"), (3, None)], "doc_id long, text string").repartition(2)
    whole = sparse.vectors(docs, 20.0, F.length, most=3, lead=1)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString().replace("Exchange RoundRobin", "")
    told = sorted(map(repr, whole.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert sorted(map(repr, sparse.vectors(docs, 20.0, F.length, most=3, lead=1).collect())) == told and len(told) == 40
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
