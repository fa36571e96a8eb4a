"""Queries over answers, the semantic cache and online records; each beside the DuckDB SQL that checks it.

An assistant's turn answers the user's turn before it. Citations, statuses and revisions are planted by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers, logs, measures, ranking, search, vectors
from quern.plans.evaluation import ORACLE_SQL, query
from quern.plans.oracles import ORACLE_SQL as EARLIER
from quern.plans.oracles import LEXICAL_SQL, METRIC_SQL, PAIRS_SQL, REFUSED_SQL, VECTORS
from quern.sources.tables import table

REFUSALS, ERRORS, DISCLAIMERS = ("ne sais", "nicht", "not the"), ("error", "timeout"), ("ein ", "le ")
_WORDS = "list_filter(string_split({c}, ' '), lambda x: x <> '')"

#: The longest common subsequence as rows of lengths, one for each word of the answer, each filled from the left.
ROUGE_SQL = f"""WITH {PAIRS_SQL},
words AS (SELECT conv_id, turn, {_WORDS.format(c=METRIC_SQL.format(c='answer'))} AS x, {_WORDS.format(c=METRIC_SQL.format(c='reference'))} AS y FROM pairs),
longest AS (SELECT conv_id, turn, len(x) AS n, len(y) AS m, list_reduce(list_transform(x, lambda w: {{'w': w, 'row': []::INT[]}}), lambda s, i: {{'w': '', 'row':
    list_reduce(list_transform(range(1, len(y) + 1), lambda j: [j::INT]),
      lambda row, j: list_append(row, CASE WHEN y[j[1]] = i.w THEN s.row[j[1]] + 1 ELSE greatest(s.row[j[1] + 1], row[len(row)]) END), [0])}},
    {{'w': '', 'row': list_transform(range(0, len(y) + 1), lambda j: 0)}}).row AS row FROM words)
SELECT conv_id, turn, CASE WHEN n = 0 AND m = 0 THEN 1.0 WHEN coalesce(row[m + 1], 0) = 0 THEN 0.0 ELSE round(2.0::DOUBLE * row[m + 1] / (n + m), 4) END AS score FROM longest"""
ORACLE_SQL["rouge_l"] = ROUGE_SQL

_CITES = r"list_distinct(list_transform(regexp_extract_all(coalesce({c}, ''), '(?i)(?:Điều|Khoản|Chương)\s+[0-9]+[A-Za-z]?'), lambda x: lower(regexp_replace(x, '\s+', ' ', 'g'))))"
_BUNDLE = f"""WITH conversations AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 5 > 0 THEN text || ' Điều ' || (turn % 3) || ', khoản  ' || (turn // 2) ELSE text END AS text FROM conversations),
r AS (WITH {PAIRS_SQL}, {REFUSED_SQL} SELECT conv_id, turn, category, {_CITES.format(c='answer')} AS ca, {_CITES.format(c='reference')} AS cr,
  ({METRIC_SQL.format(c='answer')} = {METRIC_SQL.format(c='reference')})::INT::DOUBLE AS exact_match FROM refused),
bundle AS (SELECT conv_id, turn, category, CASE WHEN turn % 7 = 3 THEN 'retrieval_error' WHEN turn % 7 = 5 THEN 'partial_retrieval_error' END AS status, CASE WHEN conv_id % 3 > 0 THEN conv_id % 3 = 1 END AS answerable,
  turn % 7 <> 3 AS applicable, CASE WHEN turn % 7 = 3 THEN 'retrieval_error' END AS skip_reason, category IN ('pure_refusal', 'no_evidence') AS is_refusal, exact_match,
  tp."precision" AS token_precision, tp.recall AS token_recall, tf.f1 AS token_f1, cf.f1 AS char_f1, ro.score AS rouge_l, ch.score AS chrf,
  CASE WHEN len(cr) > 0 THEN CASE WHEN len(ca) > 0 THEN round(len(list_intersect(ca, cr)) / len(ca), 4) ELSE 0 END END AS citation_precision, CASE WHEN len(cr) > 0 THEN round(len(list_intersect(ca, cr)) / len(cr), 4) END AS citation_recall,
  CASE WHEN len(cr) > 0 THEN CASE WHEN len(ca) > 0 THEN round((len(ca) - len(list_intersect(ca, cr))) / len(ca), 4) ELSE 0 END END AS citation_invalid_rate
  FROM r JOIN ({ORACLE_SQL['token_precision_recall']}) AS tp USING (conv_id, turn) JOIN ({EARLIER['token_f1']}) AS tf USING (conv_id, turn) JOIN ({EARLIER['char3_f1']}) AS cf USING (conv_id, turn)
  JOIN ({ROUGE_SQL}) AS ro USING (conv_id, turn) JOIN ({EARLIER['chrf']}) AS ch USING (conv_id, turn))"""


def refusals(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the category of each answer."""
    kind = answers.refusal(F.col("answer"), F.length(F.trim("reference")) > 60, REFUSALS, ERRORS, DISCLAIMERS, r"article [0-9]+")
    return pairs.select("conv_id", "turn", "answer", "reference", kind.alias("category"))


def _bundles(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    cites = F.concat(F.col("text"), F.lit(" Điều "), (t % 3).cast("string"), F.lit(", khoản  "), F.floor(t / 2).cast("string"))
    turns = table(spark, d, "conversations").withColumn("text", F.when(F.col("conv_id") % 5 > 0, cites).otherwise(F.col("text")))
    status = F.when(t % 7 == 3, "retrieval_error").when(t % 7 == 5, "partial_retrieval_error")
    known = F.when(F.col("conv_id") % 3 > 0, F.col("conv_id") % 3 == 1)
    return answers.case_bundle(refusals(answers.answer_pairs(turns)).select("*", status.alias("status"), known.alias("answerable")))


@query(_BUNDLE + " SELECT * FROM bundle")
def answer_bundle(spark: SparkSession, d: str) -> DataFrame:
    return _bundles(spark, d)


_MEANS = ", ".join(f"round(avg({c}) FILTER (applicable), 4) AS {c}" for c in answers.MEANS)
_RIGHT = "count(*) FILTER (applicable AND NOT coalesce(answerable, false) AND is_refusal)"
_CANNOT = "nullif(count(*) FILTER (applicable AND NOT coalesce(answerable, false)), 0)"


@query(f"""{_BUNDLE} SELECT count(*) AS total_cases, count(*) FILTER (applicable) AS scored_cases, count(*) FILTER (NOT applicable) AS skipped_cases, count(*) FILTER (applicable AND coalesce(answerable, true)) AS answerable_count,
  count(*) FILTER (applicable AND NOT coalesce(answerable, false)) AS unanswerable_count, round(count(*) FILTER (applicable AND category = 'mixed_claim_refusal') / count(*) FILTER (applicable), 4) AS mixed_claim_refusal_rate,
  round({_RIGHT} / nullif(count(*) FILTER (applicable AND is_refusal), 0), 4) AS refusal_precision, round({_RIGHT} / {_CANNOT}, 4) AS refusal_recall, round({_RIGHT} / {_CANNOT}, 4) AS unanswerable_accuracy,
  round(count(*) FILTER (applicable AND coalesce(answerable, true) AND token_f1 >= 0.5) / nullif(count(*) FILTER (applicable AND coalesce(answerable, true)), 0), 4) AS answer_similarity_pass_rate, {_MEANS} FROM bundle""")
def answer_report(spark: SparkSession, d: str) -> DataFrame:
    return answers.answer_report(_bundles(spark, d))


@query(_BUNDLE + """ SELECT 'skip_reason' AS kind, skip_reason AS name, count(*) AS n FROM bundle WHERE NOT applicable GROUP BY ALL
UNION ALL SELECT 'category', category, count(*) FROM bundle WHERE applicable GROUP BY ALL""")
def answer_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return answers.breakdown(_bundles(spark, d))


@query("""WITH q AS (SELECT vec_id AS query_id, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i <= vec_id // 100 % 6 THEN 0 ELSE x END) AS q FROM embeddings WHERE vec_id % 100 = 0),
hit AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) DESC, vec_id) AS rank FROM q, embeddings WHERE vec_id // 100 % 4 > 0)
SELECT query_id, vec_id AS entry_id, score, 'answer ' || vec_id AS response FROM hit WHERE rank = 1 AND score >= 0.96""")
def semantic_cache_revision(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the current revision alone, at the threshold of the cache; questions are entries with some dimensions lost."""
    rows, i = table(spark, d, "embeddings"), F.col("vec_id")
    lost = F.transform("embedding", lambda x, k: F.when(k < F.floor(i / 100) % 6, 0.0).otherwise(x))
    asked = rows.where(i % 100 == 0).select(i.alias("query_id"), lost.alias("embedding"))
    revision = F.when(F.floor(i / 100) % 4 > 0, "r1").otherwise("r0")
    entries = rows.select(i.alias("entry_id"), "embedding", revision.alias("revision"), F.concat(F.lit("answer "), i.cast("string")).alias("response"))
    return search.cache_lookup(asked, entries, "r1")


@query(r"SELECT item_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17])::INT % 4) + 1, 1) || h[18:20] || '-' || h[21:32] AS cache_id FROM (SELECT item_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('r1' || chr(10) || lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))))) AS h FROM benchmark)")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", search.cache_key(F.col("text"), "r1").alias("cache_id"))


_ONLINE = """WITH r AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'technical_error' WHEN 'view' THEN 'ok' WHEN 'purchase' THEN 'no_evidence' ELSE event_type END AS status, CASE WHEN user_id % 3 > 0 THEN 'p' || (user_id % 3) END AS provider,
  CASE WHEN user_id % 4 > 0 THEN 'm' || (user_id % 4) END AS model, CASE WHEN event_id % 5 > 0 THEN 'mode' || (event_id % 2) END AS judge_mode, CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 7 < 3 THEN 'done' END AS judge_status, CASE event_id % 9 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS feedback FROM events)"""


@query(_ONLINE + """ SELECT histogram, name, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM (SELECT unnest(['status', 'provider', 'model', 'judge_mode', 'judge_status', 'feedback']) AS histogram,
  unnest([coalesce(status, 'unknown'), coalesce(provider, 'unobserved'), coalesce(model, 'unobserved'), coalesce(judge_mode, 'off'), coalesce(judge_status, 'disabled'), coalesce(feedback, 'none')]) AS name FROM r) GROUP BY ALL""")
def online_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Six histograms of online records in one pass."""
    e, u = F.col("event_id"), F.col("user_id")
    status = F.when(F.col("event_type") == "error", "technical_error").when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "purchase", "no_evidence").otherwise(F.col("event_type"))
    named = lambda prefix, n, k: F.when(n % k > 0, F.concat(F.lit(prefix), (n % k).cast("string")))
    rows = table(spark, d, "events").select(
        status.alias("status"), named("p", u, 3).alias("provider"), named("m", u, 4).alias("model"), F.when(e % 5 > 0, F.concat(F.lit("mode"), (e % 2).cast("string"))).alias("judge_mode"),
        F.when(e % 7 == 0, "failed").when(e % 7 < 3, "done").alias("judge_status"), F.when(e % 9 == 0, "up").when(e % 9 == 1, "down").alias("feedback"),
    )
    return logs.histograms(rows, {"status": "unknown", "provider": "unobserved", "model": "unobserved", "judge_mode": "off", "judge_status": "disabled", "feedback": "none"})


@query(r"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM conversations),
f AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, 60 AS remaining, '' AS context, false AS done FROM conversations
  UNION ALL SELECT f.conv_id, t.n, CASE WHEN remaining - 5 > 0 AND len(w) > 0 THEN remaining - 5 - least(remaining - 5, len(w)) ELSE remaining END::INT,
    CASE WHEN remaining - 5 > 0 AND len(w) > 0 THEN context || CASE WHEN context = '' THEN '' ELSE chr(10) || chr(10) END || '[Tài liệu tham khảo #' || t.n || ']' || chr(10) || array_to_string(w[1:remaining - 5], ' ') ELSE context END,
    remaining - 5 <= 0 OR len(w) = 0 OR len(w) > remaining - 5 FROM f JOIN t ON t.conv_id = f.conv_id AND t.n = f.n + 1 WHERE NOT done)
SELECT conv_id, sha256(context) AS sha, (60 - remaining)::BIGINT AS tokens FROM f WHERE context <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1""")
def bounded_context_text(spark: SparkSession, d: str) -> DataFrame:
    """Turns as labelled contexts under 60 tokens."""
    order = F.struct("turn", "role")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), order.alias("rank"), "text")
    return answers.bounded_text(rows, 60).select(F.col("key").alias("conv_id"), F.sha2("context", 256).alias("sha"), "tokens")


_RANKS = f"""WITH {VECTORS}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored QUALIFY rank <= 10),
ranks AS (SELECT query_id, min(rank) FILTER (label = q_label) AS rank FROM top GROUP BY query_id)"""


@query(_RANKS + """ SELECT unnest(['recall_at_1', 'recall_at_3', 'recall_at_10', 'mrr']) AS metric, unnest([count(*) FILTER (rank <= 1)::DOUBLE, count(*) FILTER (rank <= 3)::DOUBLE, count(*) FILTER (rank <= 10)::DOUBLE, round(sum(coalesce(1.0::DOUBLE / rank, 0)), 6)]) AS numerator,
count(*) AS denominator, unnest([round(count(*) FILTER (rank <= 1) / count(*), 6), round(count(*) FILTER (rank <= 3) / count(*), 6), round(count(*) FILTER (rank <= 10) / count(*), 6), round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 6)]) AS value FROM ranks""")
def probe_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Where the first of the ten nearest rows with the question's own label stands."""
    rows = table(spark, d, "embeddings")
    hits = vectors.nearest(rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), rows, top=10)
    ranks = hits.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("q_label"), F.col("rank"))).alias("rank"))
    return measures.probe(ranks, (1, 3, 10))


@query("SELECT doc_id, lang, source FROM documents WHERE regexp_matches(coalesce(lang, ''), '(?i)^(de|FR)$') OR regexp_matches(coalesce(source, ''), '(?i)^(de|FR)$') OR regexp_matches(doc_id::VARCHAR, '(?i)^(de|FR)$') ORDER BY doc_id DESC LIMIT 50 OFFSET 5")
def record_search(spark: SparkSession, d: str) -> DataFrame:
    """A page of the newest records of which one of three columns matches."""
    return logs.search_any(table(spark, d, "documents"), ("lang", "source", "doc_id"), "^(de|FR)$", ("doc_id",), 5, 50).select("doc_id", "lang", "source")


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND contains(lower(text), 'la. ') ORDER BY conv_id DESC, turn DESC LIMIT 100")
def owned_title_search(spark: SparkSession, d: str) -> DataFrame:
    """The newest 100 titles of one owner that hold a text as it is, full stop included."""
    return logs.search_titles(table(spark, d, "conversations"), "text", "La. ", ("role", "user"), ("conv_id", "turn")).select("conv_id", "turn", "text")


_INTENTS = " + ".join(
    f"CASE WHEN ({' OR '.join(f'contains(p, {chr(39)}{w}{chr(39)})' for w in asked)}) AND ({' OR '.join(f'contains(b, {chr(39)}{w}{chr(39)})' for w in told)}) THEN 4.0::DOUBLE ELSE 0 END" for asked, told in ranking.INTENTS.values()
)
_PLAIN = r"lower(trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g')))"


@query(rf"""WITH {LEXICAL_SQL},
pair AS (SELECT query_id, doc_id, {_PLAIN.format(c="b.text || CASE query_id % 2 WHEN 0 THEN ' thời hạn' ELSE '' END")} AS p, {_PLAIN.format(c="d.text || CASE doc_id % 3 WHEN 0 THEN ' thời hiệu' ELSE '' END")} AS b FROM lexical JOIN benchmark AS b ON item_id = query_id JOIN documents AS d USING (doc_id)),
term AS (SELECT *, list_distinct(list_transform(list_filter(regexp_extract_all(p, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2), lambda x: replace(x, '_', ' '))) AS t FROM pair)
SELECT query_id, doc_id, round(coalesce(list_sum(list_transform(list_filter(t, lambda x: contains(b, x)), lambda x: 1 + ln((length(b) - length(replace(b, x, ''))) / length(x)))), 0) + CASE WHEN p <> '' AND contains(b, p) THEN 8 ELSE 0 END + {_INTENTS}, 6) AS score FROM term""")
def passage_scores(spark: SparkSession, d: str) -> DataFrame:
    """Substring counts, whole phrases and the seven intents over lexical candidates; some texts name a deadline by rule."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    lexical = ranking.lexical_lane(asked, table(spark, d, "documents")).select("query_id", "doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " thời hiệu").otherwise("")).alias("body"))
    queries = asked.select("query_id", F.concat("text", F.when(F.col("query_id") % 2 == 0, " thời hạn").otherwise("")).alias("q"))
    pairs = docs.join(ranking.bounded(lexical), "doc_id").join(ranking.bounded(queries), "query_id")
    return pairs.select("query_id", "doc_id", ranking.passage_score(F.col("q"), F.col("body")).alias("score"))
