"""Queries over structured records: neighbours, checked lanes, reranking, whole runs; each beside the DuckDB SQL that checks it.

Order lines stand for records: an order is a document, a line an article of it, a supplier asks the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import expansion, gates, identity, ranking, rerank, runs
from quern.operators.evidence import rerank_candidates
from quern.plans.evaluation import NDCG_SQL, ORACLE_SQL, evidence_cases, evidence_sql, query
from quern.plans.oracles import LEXICAL_SQL
from quern.sources.scratch import written
from quern.sources.tables import table


@query("""WITH u AS (SELECT DISTINCT source, doc_id FROM documents), p AS (SELECT doc_id::VARCHAR AS id, row_number() OVER (ORDER BY source, doc_id) - 1 AS pos FROM u),
leaf AS (SELECT pos // 256 AS g, sha256(string_agg(id, ',' ORDER BY pos)) AS h FROM p GROUP BY ALL),
upper AS (SELECT g // 256 AS g, sha256(string_agg(h, ',' ORDER BY g)) AS h FROM (SELECT leaf.g AS g, h FROM leaf) GROUP BY ALL),
kind AS (SELECT lang || ':' || count(*) AS k FROM documents GROUP BY lang)
SELECT (SELECT count(*) FROM documents) AS records, (SELECT string_agg(k, ',' ORDER BY k) FROM kind) AS groups, (SELECT sum(strlen(text))::BIGINT FROM documents) AS bytes,
  (SELECT sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT FROM documents) AS tokens, (SELECT count(*) FROM p) AS ids,
  (SELECT sha256(string_agg(h, ',' ORDER BY g)) FROM upper) AS ordered_ids_sha256""")
def corpus_identity(spark: SparkSession, d: str) -> DataFrame:
    return identity.corpus_identity(table(spark, d, "documents"), "doc_id", ("source",), "lang", "text")


SEEDS, READS = 12, 30


@query(f"""WITH line AS (SELECT l_orderkey, l_linenumber, min({{'part': l_partkey, 'supp': l_suppkey, 'price': l_extendedprice, 'discount': l_discount, 'tax': l_tax}}) AS m FROM lineitem GROUP BY ALL),
rec AS (SELECT l_orderkey * 8 + l_linenumber AS record_id, l_orderkey AS document_id, CASE WHEN m.part % 11 > 0 THEN 'Điều ' || (l_linenumber + 7) END AS article, m.part AS seq, m.supp AS query_id, m.price AS price, m.discount AS discount, m.tax AS tax FROM line),
lanes AS (SELECT query_id, record_id, 'dense' AS lane, row_number() OVER (PARTITION BY query_id ORDER BY price DESC, record_id) AS rank, seq AS payload FROM rec QUALIFY rank <= 20
  UNION ALL SELECT query_id, record_id, 'bm25', row_number() OVER (PARTITION BY query_id ORDER BY discount DESC, record_id) AS rank, seq + (record_id % 3 = 0)::INT FROM rec QUALIFY rank <= 10
  UNION ALL SELECT query_id, record_id, 'exact', row_number() OVER (PARTITION BY query_id ORDER BY tax DESC, record_id) AS rank, seq FROM rec QUALIFY rank <= 5),
clash AS (SELECT DISTINCT query_id FROM (SELECT query_id, record_id FROM lanes GROUP BY ALL HAVING count(DISTINCT payload) > 1)),
score AS (SELECT query_id, record_id, list_reduce(list_transform(list_sort(list(rank)), lambda r: 1.0::DOUBLE / (60 + r)), lambda a, b: a + b) AS total, min(rank) FILTER (lane = 'exact') AS own FROM lanes WHERE query_id NOT IN (FROM clash) GROUP BY ALL),
seed AS (SELECT s.query_id, record_id, document_id, article, row_number() OVER (PARTITION BY s.query_id ORDER BY total DESC, own NULLS LAST, record_id) AS rank FROM score AS s JOIN rec USING (record_id) QUALIFY rank <= {SEEDS}),
want AS (SELECT query_id, rank, document_id, unnest(list_filter([article, CASE WHEN n > 1 THEN 'Điều ' || (n - 1) END, 'Điều ' || (n + 1)], lambda a: a IS NOT NULL)) AS article
  FROM (SELECT *, substr(article, 6)::INT AS n FROM seed WHERE article IS NOT NULL)),
reads AS (SELECT x.query_id, count(*) AS n FROM (SELECT DISTINCT query_id, document_id, article FROM want) AS x JOIN rec USING (document_id, article) GROUP BY ALL),
over AS (SELECT query_id FROM reads WHERE n > {READS}),
every AS (SELECT query_id, record_id, {{'rank': rank, 'kind': 0, 'article': '', 'seq': 0::BIGINT}} AS spot FROM seed
  UNION ALL SELECT want.query_id, record_id, {{'rank': rank, 'kind': 1, 'article': article, 'seq': seq}} FROM want JOIN rec USING (document_id, article)),
placed AS (SELECT query_id, record_id, row_number() OVER (PARTITION BY query_id ORDER BY spot, record_id) AS place FROM (SELECT query_id, record_id, min(spot) AS spot FROM every GROUP BY ALL) WHERE query_id NOT IN (FROM over))
SELECT query_id, record_id, place, 'ok' AS verdict FROM placed UNION ALL SELECT query_id, NULL, NULL, 'overflow' FROM over UNION ALL SELECT query_id, NULL, NULL, 'conflict' FROM clash""")
def structural_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Three lanes of a supplier's lines fused under one payload each, the first seeds widened by the lines beside them."""
    pick = F.min(F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(pick.alias("m"))
    article = F.when(F.col("m.part") % 11 > 0, F.concat(F.lit(f"{expansion.ARTICLE} "), (F.col("l_linenumber") + 7).cast("string")))
    rows = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record_id"), F.col("l_orderkey").alias("document_id"), article.alias("article"), F.col("m.part").alias("seq"), F.col("m.supp").alias("query_id"), "m.price", "m.discount", "m.tax")
    held = written(rows, "records")
    other = F.col("seq") + (F.col("record_id") % 3 == 0).cast("int")
    lanes = [
        ranking.ranked(held, top, F.desc(by), F.asc("record_id")).select("query_id", "record_id", F.lit(lane).alias("lane"), "rank", payload.alias("payload"))
        for lane, by, top, payload in (("dense", "price", 20, F.col("seq")), ("bm25", "discount", 10, other), ("exact", "tax", 5, F.col("seq")))
    ]
    fused = written(expansion.checked_fusion(ranking.together(lanes), "payload"), "fused")
    seeds = fused.where((F.col("verdict") == "ok") & (F.col("rank") <= SEEDS)).select("query_id", "rank", "record_id").join(held.select("record_id", "document_id", "article"), "record_id")
    found = expansion.expanded(seeds, held.select("record_id", "document_id", "article", "seq"), READS)
    failed = fused.where(F.col("verdict") != "ok").select("query_id", "record_id", F.col("rank").alias("place"), "verdict")
    return found.unionByName(failed)


class Planted(rerank.TermOverlap):
    """Term overlap with answers that break the contract: an index twice, or a score that is no number, for some lengths of query."""

    def rank(self, query: str, texts: Sequence[str], most: int) -> list[tuple[int, float]]:
        pairs = super().rank(query, texts, most)
        if len(query) % 5 == 0:
            return pairs[:1] * 2
        return [(k, float("nan")) for k, _ in pairs] if len(query) % 7 == 0 else pairs


RERANK_CAP, RERANK_INPUT, RERANK_OUTPUT, LEAST_SCORE = 2, 10, 5, 0.2
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda x: x <> ''))"


@query(f"""WITH {LEXICAL_SQL},
hit AS (SELECT query_id, doc_id AS chunk_id, source, rank AS position, CASE WHEN rank % 3 = 0 THEN 0 ELSE score END AS score FROM lexical JOIN documents USING (doc_id)),
one AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, position) AS turn FROM hit WHERE score > 0 QUALIFY turn <= {RERANK_CAP}),
used AS (SELECT query_id, source, count(*) AS n FROM one GROUP BY ALL),
rest AS (SELECT hit.*, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY query_id, source ORDER BY position) AS turn FROM (FROM hit ANTI JOIN one USING (query_id, chunk_id)) AS hit LEFT JOIN used USING (query_id, source)),
phases AS (SELECT query_id, chunk_id, position, 1 AS phase, -score AS key FROM one
  UNION ALL SELECT query_id, chunk_id, position, CASE WHEN n = 0 AND turn = 1 THEN 2 ELSE 3 END, 0 FROM rest WHERE n + turn <= {RERANK_CAP}),
given AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY phase, key, position) AS place FROM phases QUALIFY place <= {RERANK_INPUT}),
pair AS (SELECT query_id, chunk_id, place, b.text AS q, {_WORDS.format(c='b.text')} AS a, {_WORDS.format(c='d.text')} AS t FROM given JOIN benchmark AS b ON item_id = query_id JOIN documents AS d ON doc_id = chunk_id),
marked AS (SELECT *, len(list_intersect(a, t)) / greatest(len(a), 1)::DOUBLE AS score, length(q) % 5 = 0 AND count(*) OVER (PARTITION BY query_id) > 0 OR length(q) % 7 = 0 AS bad FROM pair),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN bad THEN 0 ELSE -score END, place) AS rank FROM marked)
SELECT query_id, chunk_id, place, CASE WHEN NOT bad THEN score END AS score, rank, CASE WHEN bad THEN 'rejected' ELSE 'reranked' END AS verdict FROM ordered WHERE rank <= {RERANK_OUTPUT} AND (bad OR score >= {LEAST_SCORE})""")
def reranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Lexical hits, every third without a score, chosen in three phases and reranked; some answers are malformed."""
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    lexical = ranking.lexical_lane(asked.select("query_id", F.col("query").alias("text")), docs)
    hits = lexical.join(docs.select("doc_id", "source"), "doc_id").select(
        "query_id", F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("rank").alias("position"), F.when(F.col("rank") % 3 == 0, 0.0).otherwise(F.col("score")).alias("score")
    )
    chosen = written(rerank_candidates(hits, RERANK_CAP, RERANK_INPUT).select("query_id", "chunk_id", "place"), "chosen")
    texts = docs.select(F.col("doc_id").alias("chunk_id"), "text").join(ranking.bounded(chosen), "chunk_id")
    return rerank.reranked(texts.join(asked, "query_id"), Planted, RERANK_OUTPUT, LEAST_SCORE)


#: Stages of a whole run with their capacities; the first five know documents alone.
RUN_STAGES = {"dense": 24, "titles": 12, "source": 24, "merged": 20, "resolved": 8, "chunks": 5, "local": 4, "rerank_input": 6, "rerank_output": 3, "final": 2}
RUN_DOCUMENT_ONLY = tuple(RUN_STAGES)[:5]
LOSS_ORDER = tuple(RUN_STAGES)[2:]
_LISTED = ", ".join(f"('{s}', {c}, {s in RUN_DOCUMENT_ONLY}, {s in LOSS_ORDER}, {k})" for k, (s, c) in enumerate(RUN_STAGES.items()))
_OF = "CASE level WHEN 'document' THEN {d} WHEN 'article' THEN {a} ELSE {c} END"


@query(f"""WITH RECURSIVE {evidence_sql(RUN_STAGES)}, {NDCG_SQL},
st(stage, capacity, document_only, loses, number) AS (VALUES {_LISTED}),
lk(level, k) AS (VALUES ('document', 1), ('document', 3), ('document', 5), ('document', 10), ('document', 24), ('article', 1), ('article', 3), ('article', 6), ('clause', 1), ('clause', 3), ('clause', 6)),
firsts AS (SELECT case_id, evidence_id, stage, min(rank) FILTER (d) AS rd, min(rank) FILTER (a) AS ra, min(rank) FILTER (c) AS rc,
  bool_or(CASE WHEN stage IN (SELECT stage FROM st WHERE document_only) THEN d ELSE r END) AS alive, bool_or(r) AS met FROM need GROUP BY ALL),
cells AS (SELECT case_id, stage, capacity, document_only, level, k, count(*) FILTER ({_OF.format(d='true', a='g_article IS NOT NULL', c='g_clause IS NOT NULL')}) AS den,
  count(*) FILTER ({_OF.format(d='rd <= k', a='g_article IS NOT NULL AND ra <= k', c='g_clause IS NOT NULL AND rc <= k')}) AS num
  FROM gold CROSS JOIN st CROSS JOIN lk LEFT JOIN firsts USING (case_id, evidence_id, stage) GROUP BY ALL),
ratios AS (SELECT stage, 'recall' AS measure, level, k, num, den, CASE WHEN why IS NULL THEN round(num / den, 4) END AS value, why FROM (
    SELECT *, CASE WHEN document_only AND level <> 'document' THEN 'stage_does_not_expose_structural_locators' WHEN k > capacity THEN 'k_exceeds_configured_capacity' WHEN den = 0 THEN 'no_applicable_gold' END AS why FROM cells)
  UNION ALL SELECT stage, 'reciprocal_rank', level, NULL, CASE WHEN why IS NULL THEN coalesce(round(1.0::DOUBLE / r, 4), 0) END, 1, CASE WHEN why IS NULL THEN coalesce(round(1.0::DOUBLE / r, 4), 0) END, why FROM (
    SELECT stage, level, CASE WHEN document_only AND level <> 'document' THEN 'stage_does_not_expose_structural_locators' WHEN {_OF.format(d='false', a='count(g_article) = 0', c='count(g_clause) = 0')} THEN 'no_applicable_gold' END AS why,
      min({_OF.format(d='rd', a='CASE WHEN g_article IS NOT NULL THEN ra END', c='CASE WHEN g_clause IS NOT NULL THEN rc END')}) AS r
    FROM gold CROSS JOIN st CROSS JOIN (SELECT DISTINCT level FROM lk) LEFT JOIN firsts USING (case_id, evidence_id, stage) GROUP BY case_id, stage, level, document_only)
  UNION ALL SELECT stage, 'candidates', NULL, NULL, n, 1, n, NULL FROM (SELECT case_id, stage, count(cand.rank) AS n FROM (SELECT DISTINCT case_id FROM gold) CROSS JOIN st LEFT JOIN cand USING (case_id, stage) GROUP BY case_id, stage)
  UNION ALL SELECT 'run', 'coverage', NULL, NULL, 1, 1, 1, NULL FROM (SELECT DISTINCT case_id FROM gold)
  UNION ALL SELECT 'run', 'ndcg', NULL, NULL, ndcg, 1, ndcg, NULL FROM ndcg
  UNION ALL SELECT 'run', unnest(['multi_hop_all', 'multi_hop_share']), NULL, NULL, unnest([(num = den)::INT, num]), unnest([1, den]), unnest([(num = den)::INT, round(num / den, 4)]), NULL
    FROM (SELECT case_id, count(*) AS den, count(*) FILTER (met) AS num FROM gold LEFT JOIN (FROM firsts WHERE stage = 'final') USING (case_id, evidence_id) GROUP BY case_id)),
why AS (SELECT stage, measure, level, k, why || ':' || count(*) AS w FROM ratios WHERE why IS NOT NULL GROUP BY stage, measure, level, k, why),
whys AS (SELECT stage, measure, level, k, string_agg(w, ',' ORDER BY w) AS w FROM why GROUP BY ALL),
lost AS (SELECT case_id, evidence_id, arg_min(stage, number) FILTER (NOT coalesce(alive, false)) AS stage FROM (SELECT case_id, evidence_id, st.stage, number, alive FROM gold CROSS JOIN (FROM st WHERE loses) AS st LEFT JOIN firsts USING (case_id, evidence_id, stage)) GROUP BY ALL),
means AS (SELECT stage, measure, level, k, round(avg(value), 4) AS macro, round(sum(num) FILTER (value IS NOT NULL) / nullif(sum(den) FILTER (value IS NOT NULL), 0), 4) AS micro,
  round(coalesce(sum(num) FILTER (value IS NOT NULL), 0)::DOUBLE, 6) AS numerator, coalesce(sum(den) FILTER (value IS NOT NULL), 0)::DOUBLE AS denominator, count(value) AS scored_cases, count(*) - count(value) AS skipped_cases FROM ratios GROUP BY stage, measure, level, k)
SELECT stage, measure, level, k::INT AS k, macro, micro, numerator, denominator, scored_cases, skipped_cases,
  coalesce((SELECT w FROM whys WHERE whys.stage = means.stage AND whys.measure = means.measure AND whys.level IS NOT DISTINCT FROM means.level AND whys.k IS NOT DISTINCT FROM means.k), '') AS skip_reasons, capacity FROM means LEFT JOIN st USING (stage)
UNION ALL SELECT stage, 'first_loss', NULL, NULL, NULL, round(n / total, 4), n::DOUBLE, total::DOUBLE, total, 0, '', capacity FROM (SELECT stage, capacity, (SELECT count(*) FROM lost WHERE lost.stage = st.stage) AS n, (SELECT count(*) FROM gold) AS total FROM st WHERE loses)""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    """Ten stages of a run over order lines, checked and aggregated."""
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(c).alias("capacity")) for s, c in RUN_STAGES.items()))
    cases = evidence_cases(spark, d, RUN_STAGES).withColumn("configured", stages)
    return runs.reported(cases, tuple(RUN_STAGES), LOSS_ORDER, RUN_DOCUMENT_ONLY, "source", "final")


#: The gates of a run: measures of the report by their names, what is asked of them, and two that no run has or can measure.
GATES = (
    ("recall.final.document.1", "gte", 0.3), ("recall.source.document.24", "eq", 1.0), ("recall.final.document.24", "gte", 0.5), ("reciprocal_rank.final.article.", "lte", 0.9),
    ("multi_hop_all.run..", "gte", 0.99), ("candidates.final..", "lte", 2.0), ("recall.source.article.3", "gte", 0.1), ("absent", "eq", 0.0),
)
_RULES = ", ".join(f"('{m}', '{how}', {t}::DOUBLE)" for m, how, t in GATES)


@query(f"""WITH rep AS ({ORACLE_SQL['run_report']}), named AS (SELECT measure || '.' || stage || '.' || coalesce(level, '') || '.' || coalesce(k::VARCHAR, '') AS metric, coalesce(micro, macro) AS value, denominator, nullif(skip_reasons, '') AS reason FROM rep),
rule(metric, how, required) AS (VALUES {_RULES}),
told AS (SELECT rule.metric, how, required, value, CASE WHEN named.metric IS NULL THEN 'metric_unavailable' WHEN denominator IS NULL THEN coalesce(reason, 'invalid_or_missing_denominator') WHEN denominator <= 0 THEN coalesce(reason, 'zero_or_non_finite_denominator')
  WHEN value IS NULL THEN coalesce(reason, 'invalid_or_missing_observed_value') END AS reason FROM rule LEFT JOIN named USING (metric))
SELECT metric, required, CASE WHEN reason IS NULL THEN value END AS observed, CASE WHEN reason IS NOT NULL THEN 'UNSUPPORTED' WHEN CASE how WHEN 'eq' THEN value = required WHEN 'gte' THEN value >= required ELSE value <= required END THEN 'PASS' ELSE 'FAIL' END AS verdict, reason,
  CASE WHEN reason IS NULL THEN printf('%.4f', value) ELSE 'N/A' END AS shown FROM told""")
def run_gates(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds over a run's report, those without a denominator unsupported."""
    return _gates(run_report(spark, d))


def _gates(report: DataFrame) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    name = F.concat_ws(".", "measure", "stage", part("level"), part("k"))
    rows = report.select(name.alias("metric"), F.coalesce("micro", "macro").alias("value"), "denominator", F.nullif("skip_reasons", F.lit("")).alias("reason"))
    found = gates.measured(rows, GATES)
    return found.select("*", gates.shown(F.col("observed")).alias("shown"))


@query(f"""WITH rep AS ({ORACLE_SQL['run_report']}), lines AS (SELECT level, max(micro) FILTER (stage = 'rerank_input') AS before, max(micro) FILTER (stage = 'rerank_output') AS after FROM rep WHERE measure = 'recall' AND k = 3 GROUP BY level)
SELECT level, before, after, round(after - before, 4) AS delta FROM lines""")
def reranker_contribution(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 3 before and after the reranker, by level."""
    rows = run_report(spark, d).where("measure = 'recall' AND k = 3")
    at = lambda stage: F.max(F.when(F.col("stage") == stage, F.col("micro")))
    found = rows.groupBy("level").agg(at("rerank_input").alias("before"), at("rerank_output").alias("after"))
    return found.withColumn("delta", F.round(F.col("after") - F.col("before"), 4))
