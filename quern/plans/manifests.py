"""Queries over what runs declare: fingerprints, capacities, decisions and reports; each beside the DuckDB SQL that checks it.

Parts stand for profiles, whose limits follow from their numbers; customers stand for pilot runs, their order lines for cases.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import manifests
from quern.plans.evaluation import ORACLE_SQL, query
from quern.plans.structural import run_report
from quern.sources import publication
from quern.sources.scratch import shared_dir, written
from quern.sources.tables import table

#: What the suite's fingerprint covers beside its cases.
CONFIGURATION = '{"use_cache": false, "version": 3}'


@query("""SELECT p_partkey, sha256('{"p_brand": ' || coalesce(to_json(p_brand)::VARCHAR, 'null') || ', "p_name": ' || coalesce(to_json(p_name)::VARCHAR, 'null') ||
  ', "p_size": ' || coalesce(p_size::VARCHAR, 'null') || ', "structural": ' || (p_partkey % 3 = 0)::VARCHAR || '}') AS fingerprint FROM part""")
def configuration_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").withColumn("structural", F.col("p_partkey") % 3 == 0)
    return manifests.fingerprints(parts, ("p_size", "p_brand", "structural", "p_name")).select("p_partkey", "fingerprint")


@query(f"""WITH one AS (SELECT DISTINCT doc_id, sha256('{{"lang": ' || coalesce(to_json(lang)::VARCHAR, 'null') || ', "source": ' || coalesce(to_json(source)::VARCHAR, 'null') || ', "text_sha256": ' || coalesce('"' || sha256(text) || '"', 'null') || '}}') AS id FROM documents),
p AS (SELECT id, row_number() OVER (ORDER BY doc_id, id) - 1 AS pos FROM one), leaf AS (SELECT pos // 256 AS g, sha256(string_agg(id, ',' ORDER BY pos)) AS h FROM p GROUP BY ALL),
upper AS (SELECT u AS g, sha256(string_agg(h, ',' ORDER BY g)) AS h FROM (SELECT g, h, g // 256 AS u FROM leaf) GROUP BY u)
SELECT (SELECT count(*) FROM p) AS cases, sha256('{CONFIGURATION}' || chr(10) || (SELECT sha256(string_agg(h, ',' ORDER BY g)) FROM upper)) AS fingerprint""")
def suite_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the cases of a suite."""
    cases = table(spark, d, "documents").select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"))
    return manifests.suite_fingerprint(cases, "doc_id", ("source", "lang", "text_sha256"), CONFIGURATION)


_PROFILE = {
    "title_limit": ("p_size", 7, 0), "retrieval_document_limit": ("p_size", 24, 1), "resolved_document_limit": ("p_partkey", 16, 1), "local_chunks_per_document": ("p_partkey", 5, 0), "rerank_input_limit": ("p_partkey", 24, 1),
    "rerank_return_limit": ("p_size", 3, 1), "final_evidence_limit": ("p_partkey", 3, 1), "dense_top_k": ("p_size", 64, 1), "sparse_top_k": ("p_partkey", 64, 1), "fused_limit": ("p_size", 30, 1),
    "structural_rerank_input_limit": ("p_partkey", 20, 1), "structural_rerank_return_limit": ("p_partkey", 4, 1), "structural_final_evidence_limit": ("p_size", 2, 1),
}
_LIMITS_SQL = ", ".join(f"{column} % {n} + {low} AS {name}" if low else f"nullif({column} % {n}, 0) AS {name}" for name, (column, n, low) in _PROFILE.items())


@query(f"""WITH prof AS (SELECT p_partkey, p_partkey % 3 = 0 AS s, {_LIMITS_SQL} FROM part), seen AS (SELECT l_partkey, l_linenumber, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL),
cap AS (SELECT p_partkey, unnest([{{'stage': 'dense', 'place': 1, 'c': CASE WHEN s THEN dense_top_k ELSE retrieval_document_limit END}}, {{'stage': 'title', 'place': 2, 'c': CASE WHEN s THEN sparse_top_k ELSE title_limit END}},
  {{'stage': 'merged', 'place': 3, 'c': CASE WHEN s THEN fused_limit ELSE title_limit + retrieval_document_limit END}}, {{'stage': 'resolved', 'place': 4, 'c': CASE WHEN s THEN fused_limit ELSE resolved_document_limit END}},
  {{'stage': 'structural_chunks', 'place': 5, 'c': CASE WHEN s THEN fused_limit END}}, {{'stage': 'local_chunks', 'place': 6, 'c': CASE WHEN NOT s THEN resolved_document_limit * local_chunks_per_document END}},
  {{'stage': 'rerank_input', 'place': 7, 'c': CASE WHEN s THEN structural_rerank_input_limit ELSE rerank_input_limit END}}, {{'stage': 'rerank_return', 'place': 8, 'c': CASE WHEN s THEN structural_rerank_return_limit ELSE rerank_return_limit END}},
  {{'stage': 'final', 'place': 9, 'c': CASE WHEN s THEN structural_final_evidence_limit ELSE final_evidence_limit END}}], recursive := true) FROM prof)
SELECT p_partkey, stage, c::BIGINT AS capacity, coalesce(n, 0)::BIGINT AS candidates, coalesce(n, 0) > c AS overflows FROM cap LEFT JOIN seen ON l_partkey = p_partkey AND l_linenumber = place""")
def profile_capacities(spark: SparkSession, d: str) -> DataFrame:
    """Capacities of each part's profile by stage, beside the orders that have the part in the line of the stage's place."""
    limit = lambda column, n, low: F.col(column) % n + low if low else F.nullif(F.col(column) % n, F.lit(0))
    profiles = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 3 == 0).alias("structural"), *(limit(*rule).alias(name) for name, rule in _PROFILE.items()))
    capacities = manifests.by_stage(manifests.stage_capacities(profiles, "p_partkey"), "p_partkey")
    place = F.array_position(F.array(*map(F.lit, manifests.STAGES)), F.col("stage"))
    seen = table(spark, d, "lineitem").groupBy("l_partkey", "l_linenumber").agg(F.count_distinct("l_orderkey").alias("n"))
    found = capacities.withColumn("place", place).join(seen, (F.col("p_partkey") == F.col("l_partkey")) & (F.col("place") == F.col("l_linenumber")), "left")
    n = F.coalesce("n", F.lit(0))
    return found.select("p_partkey", "stage", "capacity", n.alias("candidates"), (n > F.col("capacity")).alias("overflows"))


@query("""WITH run AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (l_discount = 0.1 AND l_tax = 0.08) AS scope, count(*) FILTER (l_discount = 0 AND l_tax = 0) AS technical, bool_or(l_quantity = 50 AND l_linenumber = 1) AS drift,
  count(*) FILTER (l_tax < 0.09) AS document, count(*) FILTER (l_discount < 0.1) AS article, count(*) FILTER (l_quantity <= 47) AS clause, count(*) FILTER (l_tax > 0) AS required, count(*) FILTER (l_quantity = 1) AS empty FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT o_custkey, CASE WHEN scope > 0 THEN 'BLOCKED_SCOPE' WHEN technical > 0 OR drift THEN 'BLOCKED_TECHNICAL'
  WHEN document / n = 1 AND article / n >= 0.95 AND clause / n >= 0.9 AND required / n >= 0.95 AND empty = 0 THEN 'PASS_PILOT' ELSE 'FAIL_QUALITY' END AS decision FROM run""")
def pilot_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's order lines as the cases of a pilot, errors and losses planted by their amounts."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    share = lambda when, name: (F.count_if(when) / F.count(F.lit(1))).alias(name)
    tax, discount, quantity = F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    pilots = lines.groupBy("o_custkey").agg(
        F.count_if((discount == 0.1) & (tax == 0.08)).alias("scope_errors"), F.count_if((discount == 0) & (tax == 0)).alias("technical_errors"), F.bool_or((quantity == 50) & (F.col("l_linenumber") == 1)).alias("drift"),
        share(tax < 0.09, "document"), share(discount < 0.1, "article"), share(quantity <= 47, "clause"), share(tax > 0, "required"), share(quantity == 1, "no_candidate"),
    )
    none = F.lit(None).cast("double")
    return manifests.pilot_decisions(pilots.withColumns({"retrieval_error": none, "reranker_error": none}), "o_custkey")


_CELLS = "stage, coalesce(level, '-'), coalesce(k::VARCHAR, '-'), coalesce(printf('%.4f', macro), 'N/A'), coalesce(printf('%.4f', micro), 'N/A'), scored_cases || '/' || (scored_cases + skipped_cases), CASE skip_reasons WHEN '' THEN '-' ELSE skip_reasons END"


@query(f"""WITH rep AS ({ORACLE_SQL['run_report']}), body AS (SELECT measure, '| ' || concat_ws(' | ', {_CELLS}) || ' |' AS line, row_number() OVER (PARTITION BY measure ORDER BY stage, coalesce(level, ''), coalesce(k, 0)) + 3 AS place FROM rep),
head AS (SELECT DISTINCT measure, unnest([{{'place': 0, 'line': '## ' || measure}}, {{'place': 1, 'line': ''}}, {{'place': 2, 'line': '| stage | level | k | macro | micro | scored | skipped for |'}}, {{'place': 3, 'line': '|-|-|-|-|-|-|-|'}}], recursive := true) FROM rep),
tail AS (SELECT measure, max(place) + 1 AS place, '' AS line FROM body GROUP BY ALL), every AS (SELECT measure, place, line FROM head UNION ALL SELECT measure, place, line FROM body UNION ALL SELECT measure, place, line FROM tail),
told AS (SELECT line, row_number() OVER (ORDER BY measure, place) + 1 AS n FROM every UNION ALL VALUES ('# Run', 0), ('', 1))
SELECT n::BIGINT AS n, line FROM told""")
def run_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The report of a run, written as one file over an older one and read back line by line."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex[:8]}.md"
    report = written(run_report(spark, d), "run-report")
    for title in ("Old run", "Run"):
        publication.replace_file(spark, path, manifests.markdown_text(report, title).encode())
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("n", "line")).select(F.col("n").cast("long").alias("n"), "line")
