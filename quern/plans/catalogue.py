"""All registered queries over the driver's tables, with the DuckDB SQL that checks each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers, corpus, gates, logs, measures, ranking, sampling, search, title_index, vectors
from quern.plans import answering, evaluation, manifests, oracles, stores, structural, upkeep  # noqa: F401  all but oracles add their queries to those of evaluation
from quern.sources.scratch import shared_dir, written
from quern.sources.tables import table

CAP, TOP = 2, 10


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return ranking.lexical_lane(_queries(spark, d), table(spark, d, "documents"))


def _exact_of(hits: DataFrame) -> DataFrame:
    return ranking.ranked(hits.withColumn("score", F.lit(1.0)), 24, F.asc("doc_id"))


def _exact(spark: SparkSession, d: str) -> DataFrame:
    return _exact_of(ranking.containment(_queries(spark, d), table(spark, d, "documents")))


def _lanes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return written(_lexical(spark, d), "lexical"), written(_exact(spark, d), "exact")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return _fused_of(*_lanes(spark, d))


def _fused_of(lexical: DataFrame, exact: DataFrame) -> DataFrame:
    both = lexical.select("query_id", "doc_id", "rank", F.lit("lexical").alias("lane")).unionByName(exact.select("query_id", "doc_id", "rank", F.lit("exact").alias("lane")))
    return ranking.fused(both)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).where(F.col("rank") <= TOP)


def balanced_interleave(spark: SparkSession, d: str) -> DataFrame:
    return ranking.interleaved(*_lanes(spark, d), TOP)


def stable_merge(spark: SparkSession, d: str) -> DataFrame:
    lexical, exact = _lanes(spark, d)
    return ranking.merged(exact, lexical, TOP)


def per_doc_cap_topn(spark: SparkSession, d: str) -> DataFrame:
    hits = _fused(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return ranking.capped(hits, "source", CAP, TOP).select("query_id", "doc_id", "source", "final_rank")


def local_topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return ranking.ranked(docs, 3, F.desc("n_chars"), F.asc("doc_id"), by="source")


def lexical_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return ranking.lexical_lane(_queries(spark, d), table(spark, d, "documents"), top=5, phrase_bonus=8.0)


def token_budget_select(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") / 5).cast("long").alias("tokens"))
    hits = written(_lexical(spark, d), "lexical").join(docs, "doc_id")
    items = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "score", F.col("source").alias("group"), "tokens", F.col("doc_id").alias("id")))),
        lambda x: F.struct(x["score"].alias("score"), x["group"].alias("group"), x["tokens"].alias("tokens"), x["id"].alias("id")),
    )
    held = hits.groupBy("query_id").agg(items.alias("items"))
    chosen = held.select("query_id", ranking.within_budget(F.col("items"), 720, 2.0, 1, 3).alias("x"))
    return chosen.select("query_id", F.col("x.used").alias("used"), F.array_join(F.transform(F.col("x.held"), lambda h: h["id"].cast("string")), ",").alias("chosen"))


def bm25_title_topk(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    return ranking.bm25(parts.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text"), parts, 5)


def title_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same ranking, read from an index that is built in runs and published."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    folder = f"{shared_dir(spark)}/title-index-{uuid.uuid4().hex[:8]}"
    title_index.build(parts, folder, "1")
    return title_index.search(spark, folder, parts.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text"), 5)


def sparse_bm25_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return ranking.saturation_weights(docs, docs.agg(F.avg(F.size(T.terms(F.col("text"))))).first()[0] or 1.0, 64)


def query_tf_weights(spark: SparkSession, d: str) -> DataFrame:
    words = _queries(spark, d).select("query_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return words.groupBy("query_id", "term").agg(F.round(1 + F.log(F.count(F.lit(1))), 6).alias("weight"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    return rows.where(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id"), rows


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(*_vectors(spark, d), top=5).select("query_id", "vec_id", "score", "rank")


def dot_hybrid_alpha(spark: SparkSession, d: str) -> DataFrame:
    return vectors.hybrid(*_vectors(spark, d), alpha=0.75, top=5).select("query_id", "vec_id", "score", "rank")


def semantic_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(*_vectors(spark, d), top=1, least=0.3).select("query_id", "vec_id", "score")


def maxsim_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    parts = rows.where(F.col("vec_id") % 100 == 0).select(F.floor(F.col("vec_id") / 300).alias("query_id"), F.col("vec_id").alias("part"), F.col("embedding").alias("q"))
    return vectors.max_sim(parts, rows)


def class_recall(spark: SparkSession, d: str) -> DataFrame:
    hits = vectors.nearest(*_vectors(spark, d), top=10)
    return hits.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("q_label")).cast("double")), 6).alias("precision_at_10"), F.min(F.when(F.col("label") == F.col("q_label"), F.col("rank"))).alias("first_rank"))


def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    seeds = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seed_rank"), "l_orderkey", "l_linenumber")
    return ranking.neighbours(seeds, lines.distinct(), "l_orderkey", "l_linenumber")


def exact_ref_lane(spark: SparkSession, d: str) -> DataFrame:
    exact = ranking.containment(_queries(spark, d), table(spark, d, "documents"))
    kept = ranking.lexical_lane(_queries(spark, d), table(spark, d, "documents"), within=exact)
    return kept.select("query_id", "doc_id", "rank")


def anchor_containment(spark: SparkSession, d: str) -> DataFrame:
    return ranking.containment(_queries(spark, d), table(spark, d, "documents"))


def tiered_search(spark: SparkSession, d: str) -> DataFrame:
    """English documents first, all others for passages that none of those holds."""
    docs, english = table(spark, d, "documents"), F.coalesce(F.col("lang") == "en", F.lit(False))
    return search.tiered(_queries(spark, d), [("en", docs.where(english)), ("other", docs.where(~english))], 5)


def payload_validity(spark: SparkSession, d: str) -> DataFrame:
    """Lexical hits, and exact ones whose payload (a seventh of another revision, a fifth of another hash) agrees with the documents."""
    lexical, exact = _lanes(spark, d)
    docs = table(spark, d, "documents").select("doc_id", F.sha2(T.normalized(F.col("text")), 256).alias("content_sha256"))
    stale = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("content_sha256"))
    revision = F.when(F.col("doc_id") % 7 == 0, "r0").otherwise("r1")
    told = exact.join(docs, "doc_id").select("query_id", "doc_id", "rank", F.lit(False).alias("lexical"), revision.alias("revision"), F.col("doc_id").alias("store_key"), stale.alias("content_sha256"))
    named = lexical.select("query_id", "doc_id", "rank", F.lit(True).alias("lexical"))
    return search.valid_hits(told.unionByName(named, allowMissingColumns=True), docs, "r1")


def join_integrity(spark: SparkSession, d: str) -> DataFrame:
    return corpus.integrity(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "doc_id")


def full_outer_diff(spark: SparkSession, d: str) -> DataFrame:
    return corpus.set_difference(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


def metadata_join(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return joined.groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    return corpus.duplicate_groups(table(spark, d, "documents"))


def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return corpus.flagged(table(spark, d, "documents")).select("doc_id", "content_sha256", F.to_json("quality_flags").alias("flags"))


def quality_histogram(spark: SparkSession, d: str) -> DataFrame:
    return corpus.flag_histogram(corpus.flagged(table(spark, d, "documents")))


def build_report(spark: SparkSession, d: str) -> DataFrame:
    return corpus.build_report(table(spark, d, "documents"))


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where((F.col("doc_id") > 100) & F.trim("lang").isin("de", "fr"))
    return docs.orderBy("doc_id").limit(25).select("doc_id", "lang")


def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.normalized(F.col("text")), 256).alias("sha"), F.length(T.clean(F.col("text"))).alias("clean_chars"))


def token_windows(spark: SparkSession, d: str) -> DataFrame:
    cut = T.windows(T.spaced(F.col("text")), 96, 16)
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(cut).alias("window_no", "tokens"))
    return parts.select("doc_id", "window_no", F.size("tokens").alias("n_tokens"), F.sha2(F.concat_ws(" ", "tokens"), 256).alias("sha"))


def dense_text(spark: SparkSession, d: str) -> DataFrame:
    head = F.concat(F.lit("source "), F.coalesce("source", F.lit("")))
    body = T.bound(T.spaced(F.concat_ws(" ", head, F.col("text"))), lambda ts: F.concat_ws(" ", F.slice(ts, 1, 420)))
    return table(spark, d, "documents").select("doc_id", F.trim(F.substring(body, 1, 2400)).alias("dense_text"))


def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.redact_contacts(F.coalesce("text", F.lit(""))), 256).alias("sha"))


def secret_redact(spark: SparkSession, d: str) -> DataFrame:
    message = F.concat(F.col("url"), F.lit("&token=s3cret Bearer ab.c-9 forbearer kept xy-known-1 mongodb://u:p4ss@h/x"))
    return table(spark, d, "pages").select("page_id", T.redact_secrets(message, ("xy-known-1", "kept")).alias("message"))


def source_host(spark: SparkSession, d: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    return table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"))


def _found(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gold (documents that hold the passage), lexical hits, and gold with its first rank."""
    gold = written(ranking.containment(_queries(spark, d), table(spark, d, "documents")), "gold")
    hits = written(_lexical(spark, d), "lexical")
    return gold, hits, measures.first_ranks(gold, hits)


def _recalls(spark: SparkSession, d: str) -> DataFrame:
    return measures.recall_at(_queries(spark, d).select("query_id"), _found(spark, d)[2], (1, 3, 5, 10, 24, 50), 24)


def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _recalls(spark, d).withColumn("recall", F.round("recall", 6))


def macro_micro(spark: SparkSession, d: str) -> DataFrame:
    return measures.macro_micro(_recalls(spark, d))


def null_reasons(spark: SparkSession, d: str) -> DataFrame:
    return measures.null_reasons(_recalls(spark, d))


def mrr(spark: SparkSession, d: str) -> DataFrame:
    return measures.reciprocal_rank(_found(spark, d)[2])


def ndcg10(spark: SparkSession, d: str) -> DataFrame:
    return measures.ndcg(_found(spark, d)[2])


def multihop_coverage(spark: SparkSession, d: str) -> DataFrame:
    return measures.coverage(_found(spark, d)[2])


def first_loss(spark: SparkSession, d: str) -> DataFrame:
    gold, hits, _ = _found(spark, d)
    return measures.first_loss(gold, [("lexical", hits), ("top_10", hits.where("rank <= 10")), ("top_3", hits.where("rank <= 3"))])


def candidate_distribution(spark: SparkSession, d: str) -> DataFrame:
    return measures.distribution(_lexical(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits")), "n_hits")


def reranker_delta(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 3 before and after fusion with the exact lane."""
    gold, hits, _ = _found(spark, d)
    cases = _queries(spark, d).select("query_id")
    one = lambda h, name: measures.macro_micro(measures.recall_at(cases, measures.first_ranks(gold, h), (1, 3), 24)).select("k", F.col("macro").alias(name))
    return one(hits, "before").join(one(_fused_of(hits, _exact_of(gold)).select("query_id", "doc_id", "rank"), "after"), "k").withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def winner_by_recall(spark: SparkSession, d: str) -> DataFrame:
    gold, hits, _ = _found(spark, d)
    cases = _queries(spark, d).select("query_id")
    profiles = {"fused": _fused_of(hits, _exact_of(gold)).select("query_id", "doc_id", "rank"), "lexical": hits}
    rows = None
    for name, h in profiles.items():
        one = measures.macro_micro(measures.recall_at(cases, measures.first_ranks(gold, h), (3, 10), 24)).select(F.lit(name).alias("profile"), "k", F.col("macro").alias("recall"))
        rows = one if rows is None else rows.unionByName(one)
    return gates.winner(rows)


def threshold_gate(spark: SparkSession, d: str) -> DataFrame:
    rates = table(spark, d, "events").agg(
        (F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))).alias("error_rate"), F.avg("value").alias("mean_value"), F.count_if(F.col("event_type") == "absent").cast("double").alias("absent")
    )
    return gates.verdicts(rates, (("error_rate", "lte", 0.5), ("mean_value", "gte", 1e9), ("absent", "eq", 0.0)))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return answers.answer_pairs(table(spark, d, "conversations"))


def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", answers.token_f1(F.col("answer"), F.col("reference")).alias("f1"))


def char3_f1(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", answers.gram_f1(F.col("answer"), F.col("reference")).alias("f1"))


def chrf(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", answers.chrf(F.col("answer"), F.col("reference")).alias("score"))


def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("conv_id", "turn", answers.rouge_l(F.col("answer"), F.col("reference")).alias("score"))


def _refusals(spark: SparkSession, d: str) -> DataFrame:
    return answering.refusals(_pairs(spark, d))


def refusal_classify(spark: SparkSession, d: str) -> DataFrame:
    return _refusals(spark, d).select("conv_id", "turn", "category")


def entity_extract(spark: SparkSession, d: str) -> DataFrame:
    found = answers.entities(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *(F.array_join(c, "|").alias(k) for k, c in found.items()))


def answer_aggregate(spark: SparkSession, d: str) -> DataFrame:
    f1 = answers.token_f1(F.col("answer"), F.col("reference"))
    rows = _refusals(spark, d).select("category", f1.alias("f1"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.avg((F.col("f1") >= 0.1).cast("double")), 6).alias("pass_rate"))


def bounded_context(spark: SparkSession, d: str) -> DataFrame:
    """Turns in order up to 60 tokens; the last one that still has room is cut."""
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", T.spaced(F.col("text")).alias("tokens")).alias("t"))
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    used = F.aggregate("ts", F.lit(0), lambda s, t: F.least(F.lit(60), s + F.size(t["tokens"])))
    whole = F.aggregate("ts", F.struct(F.lit(0).alias("used"), F.lit(0).alias("n")), lambda s, t: F.when(s["used"] + F.size(t["tokens"]) <= 60, F.struct((s["used"] + F.size(t["tokens"])).alias("used"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(61).alias("used"), s["n"].alias("n"))), lambda s: s["n"])
    return held.select("conv_id", used.alias("tokens"), whole.alias("whole_turns"))


def session_export(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("**"), F.coalesce("role", F.lit("")), F.lit("**: "), F.coalesce("text", F.lit("")))
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("conv_id", F.sha2(F.array_join(F.col("ts.line"), "\n\n"), 256).alias("sha"))


def session_title(spark: SparkSession, d: str) -> DataFrame:
    words = T.spaced(F.col("text"))
    title = F.concat(F.concat_ws(" ", F.slice(words, 1, 5)), F.when(F.size(words) > 5, "...").otherwise(""))
    return table(spark, d, "conversations").where("turn = 0").select("conv_id", title.alias("title"))


def title_search(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    return parts.where(F.contains(F.lower("p_name"), F.lit("g"))).orderBy(F.desc("p_retailprice"), "p_partkey").offset(5).limit(20).select("p_partkey", "p_name")


def admin_facet(spark: SparkSession, d: str) -> DataFrame:
    return logs.facet(table(spark, d, "events"))


def online_rollup(spark: SparkSession, d: str) -> DataFrame:
    return logs.by_type(table(spark, d, "events"))


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    timed = table(spark, d, "events").select(F.explode(F.create_map(F.lit("total"), F.col("value"), F.lit("half"), F.col("value") / 2)).alias("stage", "ms"))
    return logs.summarised(timed, "stage", "ms", 4, F.count("ms"))


def nearest_rank_p95(spark: SparkSession, d: str) -> DataFrame:
    return logs.nearest_rank(table(spark, d, "events"), 0.95)


def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    return logs.daily_quota(table(spark, d, "events"), 2, 40)


def rate_limit_windows(spark: SparkSession, d: str) -> DataFrame:
    return logs.rate_limited(table(spark, d, "events"), "1 hour", 1)


def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return logs.latest(table(spark, d, "events"))


def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    done = table(spark, d, "lineitem").where("l_linenumber >= 5").select(F.col("l_orderkey").alias("o_orderkey"))
    return logs.pending(orders, done, "o_orderkey").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    from quern.streaming.breaker import replay

    return replay(table(spark, d, "events"), failures=3, cooldown_s=3600.0)


def hash_bucket_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hash_bucket(table(spark, d, "documents"), "doc_id", 0.1).select("doc_id")


def stratified_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return sampling.round_robin(table(spark, d, "documents").select("doc_id", "lang", "source"), ("lang", "source"), "doc_id", 50, "seed-1").select("doc_id", "lang", "source", "turn")


def quantile_strata(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quartiles(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


def evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    return sampling.evenly_spaced(table(spark, d, "documents").select("doc_id"), "doc_id", 17)


def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.systematic(table(spark, d, "documents").select("doc_id"), "doc_id", 13)


def representative_min_hash(spark: SparkSession, d: str) -> DataFrame:
    return sampling.representatives(table(spark, d, "documents"), "source", "doc_id")


_NOT_QUERIES = {"table", "written", "replay"}
QUERIES = {
    name: value
    for name, value in list(globals().items())
    if callable(value) and getattr(value, "__module__", None) == __name__ and not name.startswith("_") and name not in _NOT_QUERIES
}

QUERIES |= evaluation.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | evaluation.ORACLE_SQL | {"title_index_topk": oracles.ORACLE_SQL["bm25_title_topk"]}

__all__ = ["ORACLE_SQL", "QUERIES"]
