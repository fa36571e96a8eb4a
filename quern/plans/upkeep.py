"""Queries over structure, sparse vectors, streams and the checks of records; each beside the DuckDB SQL that checks it.

Chapters, articles, citations, paths and hints are planted in the driver's tables by rule, as these have none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers, cases, evidence, sparse, structure
from quern.plans.evaluation import query
from quern.plans.oracles import NORMALIZED_SQL
from quern.sources import records
from quern.sources.scratch import shared_dir, written
from quern.sources.tables import table
from quern.streaming import ingest

_TOKENS = rf"list_filter(regexp_split_to_array({NORMALIZED_SQL}, '\s+'), lambda x: x <> '')"


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a chapter, a section and an article of two clauses: their first 50 tokens, and the others."""
    docs = table(spark, d, "documents").select("doc_id", "lang", T.spaced(T.normalized(F.col("text"))).alias("t"))
    number = (F.col("doc_id") % 9 + 1).cast("string")
    part = lambda low, high: F.array_join(F.slice("t", low, high), " ")
    text = F.concat(F.lit("Chương I\nMục 1\nĐiều "), number, F.lit(". "), F.col("lang"), F.lit("\n1. "), part(1, 50), F.lit("\n2. "), part(51, 1 << 30))
    return docs.select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.concat(number, F.lit("/2020/QH14"))).alias("document_number"), text.alias("text"))


@query(f"""WITH doc AS (SELECT doc_id, lang, {_TOKENS} AS t FROM documents),
unit AS (SELECT doc_id, k AS clause, list_concat(['Điều', (doc_id % 9 + 1) || '.', lang, k || '.'], CASE k WHEN 1 THEN t[1:50] ELSE t[51:] END) AS t FROM doc, (VALUES (1), (2)) AS c(k)),
win AS (SELECT doc_id, clause, i, t[i + 1:i + 280] AS w FROM unit, unnest(range(0, len(t), 256)) AS s(i) WHERE i = 0 OR i - 256 + 280 < len(t)),
named AS (SELECT *, i // 256 AS n, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc:' || doc_id || '#' || clause || ':' || (i // 256))) AS h FROM win)
SELECT doc_id, 'Chương I > Mục 1 > Điều ' || (doc_id % 9 + 1) AS heading_path, clause::VARCHAR AS clause, n::INT AS window,
  CASE WHEN doc_id % 4 > 0 THEN (doc_id % 9 + 1) || '/2020/QH14' ELSE 'ID ' || doc_id END || ', Điều ' || (doc_id % 9 + 1) || ', Khoản ' || clause AS citation, len(w)::INT AS token_count, sha256(array_to_string(w, ' ')) AS sha,
  h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17])::INT % 4) + 1, 1) || h[18:20] || '-' || h[21:32] AS chunk_id FROM named""")
def structural_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = structure.chunks(_planted(spark, d))
    name = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"), F.lit("#"), F.col("clause"), F.lit(":"), F.col("window").cast("string"))
    return found.select("doc_id", "heading_path", "clause", "window", "citation", "token_count", F.sha2("text", 256).alias("sha"), structure.name_uuid(name).alias("chunk_id"))


@query("""SELECT doc_id, 'Chương I|Mục 1|Điều ' || (doc_id % 9 + 1) || '. ' || lang AS headings FROM documents""")
def heading_outline(spark: SparkSession, d: str) -> DataFrame:
    return _planted(spark, d).select("doc_id", F.array_join(structure.headings(F.col("text")), "|").alias("headings"))


_MARKS = "(?i)[0-9]{1,4}/[0-9]{4}/[A-ZĐ0-9-]+|(?:Điều|Khoản)\\s+[0-9]+"


@query(rf"""WITH doc AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
txt AS (SELECT doc_id, 'Khoản ' || (doc_id % 3 + 1) || ' ' || array_to_string(t[1:doc_id % 5], ' ') || ' Điều ' || (doc_id % 20 + 1) || ' ' || array_to_string(t[6:6 + doc_id % 4], ' ') || ' ' || (doc_id % 90 + 10) || '/2020/QH14, ' ||
  array_to_string(t[11:11 + doc_id % 7], ' ') || ' Khoản 9 và Điều ' || (doc_id % 7 + 1) || ' theo ' || (doc_id % 50 + 1) || '/2019/NĐ-CP. ' || array_to_string(t[20:], ' ') AS x FROM doc),
cut AS (SELECT doc_id, regexp_split_to_array(x, '{_MARKS}') AS g, regexp_extract_all(x, '{_MARKS}') AS m FROM txt),
mark AS (SELECT doc_id, i, m[i] AS m, (sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id ORDER BY i) - length(m[i]))::BIGINT AS spot FROM cut, unnest(range(1, len(m) + 1)) AS s(i)),
kind AS (SELECT doc_id, spot, CASE WHEN m ILIKE 'Điều%' THEN 'a' WHEN m ILIKE 'Khoản%' THEN 'c' ELSE 'd' END AS kind, CASE WHEN m ILIKE 'Điều%' THEN 'Điều ' || regexp_extract(m, '[0-9]+$') WHEN m ILIKE 'Khoản%' THEN 'Khoản ' || regexp_extract(m, '[0-9]+$') ELSE upper(m) END AS name FROM mark),
clause AS (SELECT c.doc_id, c.spot, any_value(c.name) AS clause, arg_min(a.spot, {{'x': abs(a.spot - c.spot), 'y': a.spot}}) AS head, arg_min(a.name, {{'x': abs(a.spot - c.spot), 'y': a.spot}}) AS article FROM kind AS c LEFT JOIN kind AS a ON a.doc_id = c.doc_id AND a.kind = 'a' WHERE c.kind = 'c' GROUP BY ALL),
unit AS (SELECT doc_id, coalesce(head, spot) AS head, spot, coalesce(article, '') AS article, clause FROM clause
  UNION ALL SELECT doc_id, spot, spot, name, '' FROM kind WHERE kind = 'a' AND (doc_id, spot) NOT IN (SELECT (doc_id, head) FROM clause WHERE head IS NOT NULL)),
owned AS (SELECT u.doc_id, u.head, u.spot, any_value(article) AS article, any_value(clause) AS clause, arg_min(k.spot, {{'x': abs(k.spot - head), 'y': k.spot}}) AS doc, arg_min(k.name, {{'x': abs(k.spot - head), 'y': k.spot}}) AS number FROM unit AS u LEFT JOIN kind AS k ON k.doc_id = u.doc_id AND k.kind = 'd' GROUP BY ALL),
every AS (SELECT doc_id, {{'p': least(head, spot, coalesce(doc, spot)), 'h': head, 's': spot}} AS o, coalesce(number, '') AS document_number, article, clause FROM owned
  UNION ALL SELECT doc_id, {{'p': spot, 'h': spot, 's': spot}}, name, '', '' FROM kind WHERE kind = 'd' AND (doc_id, spot) NOT IN (SELECT (doc_id, doc) FROM owned WHERE doc IS NOT NULL))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o)::INT AS n, document_number, article, clause FROM (SELECT doc_id, document_number, article, clause, min(o) AS o FROM every GROUP BY ALL)""")
def cited_references(spark: SparkSession, d: str) -> DataFrame:
    """Citations in texts with two numbers, two articles and two clauses at distances that the documents' own words give."""
    docs = table(spark, d, "documents").select("doc_id", T.spaced(T.normalized(F.col("text"))).alias("t"))
    i = F.col("doc_id")
    n = lambda c: c.cast("string")
    part = lambda low, size: F.array_join(F.slice("t", low, size), " ")
    text = F.concat(
        F.lit("Khoản "), n(i % 3 + 1), F.lit(" "), part(1, (i % 5).cast("int")), F.lit(" Điều "), n(i % 20 + 1), F.lit(" "), part(6, (i % 4 + 1).cast("int")), F.lit(" "), n(i % 90 + 10), F.lit("/2020/QH14, "),
        part(11, (i % 7 + 1).cast("int")), F.lit(" Khoản 9 và Điều "), n(i % 7 + 1), F.lit(" theo "), n(i % 50 + 1), F.lit("/2019/NĐ-CP. "), part(20, 1 << 30),
    )
    return structure.cited(docs.select("doc_id", text.alias("text")), "doc_id", "text")


#: Ids of 12 bits, so that terms share some; the hash is one that SQL has as well.
def short_id(term: Column) -> Column:
    return F.conv(F.substring(F.md5(F.encode(term, "utf-8")), 1, 3), 16, 10).cast("long")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS t FROM documents),
mean AS (SELECT greatest(1.0, avg(len(t)))::DOUBLE AS average FROM w),
one AS (SELECT doc_id, len(t[1:2048]) AS n, unnest(t[1:2048]) AS term, unnest(range(0, len(t[1:2048]))) AS spot FROM w),
tf AS (SELECT doc_id, n, term, count(*) AS tf, min(spot) AS spot FROM one GROUP BY ALL),
weighted AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 3))::BIGINT AS id, spot, tf * (1.2 + 1)::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n / average)) AS weight FROM tf, mean),
ids AS (SELECT doc_id, id, min(spot) AS spot, list_reduce(list(weight ORDER BY spot), lambda a, b: a + b) AS weight FROM weighted GROUP BY ALL),
led AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) <= 16 AS lead FROM ids),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lead DESC, CASE WHEN lead THEN 0 ELSE -weight END, spot, id) AS k FROM led QUALIFY k <= 48)
SELECT doc_id, array_to_string(list(id ORDER BY id), ',') AS term_ids, sum(round(weight * 1e6)::BIGINT)::BIGINT AS micro FROM kept GROUP BY doc_id""")
def sparse_lead_vectors(spark: SparkSession, d: str) -> DataFrame:
    """48 ids of 12 bits a document, those of its first 16 terms among them."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    average = docs.agg(F.avg(F.size(T.terms(F.col("text"))))).first()[0] or 1.0
    found = sparse.vectors(docs, average, short_id, most=48, lead=16)
    micro = F.aggregate("weights", F.lit(0).cast("long"), lambda s, x: s + F.round(x * 1e6).cast("long"))
    return found.select("doc_id", F.array_join(F.transform("term_ids", lambda x: x.cast("string")), ",").alias("term_ids"), micro.alias("micro"))


@query("SELECT event_id, count(*) AS n, sum(user_id)::BIGINT AS users, 1 AS restarts FROM events GROUP BY event_id")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events streamed from six files, two a batch; the run breaks off in its second batch and is started again."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex[:8]}"
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    events.repartition(6).write.parquet(f"{folder}/in")
    schema = "event_id long, user_id long, event_type string, value double"
    restarts = 0

    def once(number: int) -> None:
        if number == 1 and not restarts:
            raise OSError("the second batch breaks off after its rows are written")

    while True:
        run = ingest.ingest(spark, f"{folder}/in", schema, f"{folder}/out", f"{folder}/checkpoint", "event_id", files_per_batch=2, after=once)
        try:
            run.awaitTermination()
            break
        except Exception:
            restarts += 1
            if restarts > 1:
                raise
    kept = ingest.committed(spark, f"{folder}/out", schema)
    return kept.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users")).withColumn("restarts", F.lit(restarts))


@query("SELECT page_id, p AS path, k IN (0, 1, 3, 4) AS sensitive, k NOT IN (2, 7) AS excluded FROM (SELECT page_id, page_id % 8 AS k, 'k' || page_id || ['/.env', '/.ENV.sample', '/.env.example', '/x.pem', '\\a.key', '/b.pyc', '/__pycache__/x', '/readme.md'][page_id % 8 + 1] AS p FROM pages)")
def source_paths(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, ("/.env", "/.ENV.sample", "/.env.example", "/x.pem", "\\a.key", "/b.pyc", "/__pycache__/x", "/readme.md")))
    path = F.concat(F.lit("k"), F.col("page_id").cast("string"), F.get(names, (F.col("page_id") % 8).cast("int")))
    return table(spark, d, "pages").select("page_id", path.alias("path"), cases.sensitive_path(path).alias("sensitive"), cases.excluded_path(path).alias("excluded"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def owned_rows(spark: SparkSession, d: str) -> DataFrame:
    return cases.owned(table(spark, d, "orders"), "F", "o_orderstatus").select("o_orderkey", "o_custkey")


@query("""SELECT 'orders' AS side, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)
UNION ALL SELECT 'lines', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_quantity")
    orders, kept = cases.cascade(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), lines.select("id"), lines.where("l_quantity > 45"), "id")
    return orders.select(F.lit("orders").alias("side"), "id").unionByName(kept.select(F.lit("lines").alias("side"), "id"))


@query("""WITH part AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id + (doc_id % 10 = 0)::INT * 1000000000 FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 21 = 0),
held AS (SELECT doc_id, count(*) AS n FROM part GROUP BY doc_id), whole AS (SELECT DISTINCT doc_id, 1 AS there FROM documents)
SELECT doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN there IS NULL THEN 'foreign' ELSE 'repeated' END AS fault FROM whole FULL JOIN held USING (doc_id) WHERE n IS NULL OR there IS NULL OR n > 1""")
def partition_check(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    moved = docs.where("doc_id % 3 <> 0").select((F.col("doc_id") + (F.col("doc_id") % 10 == 0).cast("long") * 1_000_000_000).alias("doc_id"))
    return cases.partition_faults(docs, [docs.where("doc_id % 3 = 0"), moved, docs.where("doc_id % 21 = 0")], "doc_id")


@query("""WITH made AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY doc_id), asked AS (SELECT DISTINCT doc_id, 1 AS q FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN q IS NULL THEN 'extra' ELSE 'duplicate' END AS fault FROM asked FULL JOIN made USING (doc_id) WHERE n IS NULL OR q IS NULL OR n > 1""")
def decision_check(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    return evidence.decision_faults(table(spark, d, "documents").where("doc_id % 2 = 0"), labels.unionByName(labels.where("toxic = 1")), "doc_id")


@query("""WITH meta AS (SELECT doc_id AS id, 'http://' || source || '/' || (doc_id % 50) AS u, 'N ' || (doc_id // 2) AS n FROM documents),
hint AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 4 = 0 THEN doc_id END AS id, CASE WHEN doc_id % 4 = 1 THEN ' http://' || source || '/' || (doc_id % 50) END AS u, CASE WHEN doc_id % 4 < 3 THEN 'n' || (doc_id // 2) END AS n FROM documents),
way AS (SELECT case_id, meta.id, 1 AS w FROM hint JOIN meta USING (id) UNION ALL SELECT case_id, meta.id, 2 FROM hint JOIN meta ON trim(hint.u) = meta.u
  UNION ALL SELECT case_id, meta.id, 3 FROM hint JOIN meta ON upper(replace(hint.n, ' ', '')) = upper(replace(meta.n, ' ', '')) UNION ALL SELECT doc_id, doc_id + 1, 4 FROM documents WHERE doc_id % 8 = 3),
best AS (SELECT DISTINCT case_id, id, w FROM way QUALIFY w = min(w) OVER (PARTITION BY case_id))
SELECT case_id, best.id AS document_id, CASE w WHEN 1 THEN 'exact_doc_id' WHEN 2 THEN 'exact_source_url' WHEN 3 THEN 'exact_metadata_doc_number' WHEN 4 THEN 'lexical_candidate_fallback' ELSE 'not_applicable' END AS method, coalesce(w < 4, true) AS complete FROM hint LEFT JOIN best USING (case_id)""")
def identity_resolution(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    i = F.col("doc_id")
    half = F.floor(i / 2).cast("string")
    url = F.concat(F.lit("http://"), "source", F.lit("/"), (i % 50).cast("string"))
    meta = docs.select(i.alias("document_id"), url.alias("source_url"), F.concat(F.lit("N "), half).alias("document_number"))
    hints = docs.select(i.alias("case_id"), F.when(i % 4 == 0, i).alias("document_id"), F.when(i % 4 == 1, F.concat(F.lit(" "), url)).alias("source_url"), F.when(i % 4 < 3, F.concat(F.lit("n"), half)).alias("document_number"))
    return evidence.resolve_identities(hints, meta, docs.where(i % 8 == 3).select(i.alias("case_id"), (i + 1).alias("document_id")))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Nghị định' WHEN page_id % 3 = 1 THEN 'Bộ luật' ELSE 'unspecified' END AS kind,
  CASE WHEN trim(regexp_replace(url, '\\s+', ' ', 'g')) <> '' THEN 'URL: ' || trim(regexp_replace(url, '\\s+', ' ', 'g')) ELSE '' END || chr(10) || 'Nội dung:' || chr(10) || page_id AS inference_text FROM pages""")
def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    number = F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit("/2020/nđ-cp"))).otherwise(F.lit("1/2"))
    text = F.when(n % 3 == 1, F.lit("theo bộ luật này")).otherwise(F.lit("vô luậtx"))
    return table(spark, d, "pages").select(
        "page_id", structure.document_type(number, text, F.lit(None).cast("string")).alias("kind"), structure.inference_text({"URL": F.col("url"), "Empty": F.lit(" ")}, n.cast("string")).alias("inference_text")
    )


@query("""SELECT page_id, 'Art ' || page_id AS citation, CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id END AS title, CASE WHEN page_id % 3 > 0 THEN 'https://h/' || page_id END AS url, 'first' || chr(10) || 'id ' || page_id AS excerpt,
  CASE WHEN page_id % 5 = 0 THEN NULL ELSE page_id END AS salvaged FROM pages""")
def presented_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts read back into their parts, and objects salvaged from answers, of which every fifth is broken."""
    n = F.col("page_id").cast("string")
    title = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("\r\nTITLE: Page "), n)).otherwise("")
    url = F.concat(F.when(F.col("page_id") % 3 > 0, F.lit("https")).otherwise("ftp"), F.lit("://h/"), n)
    context = F.concat(F.lit("[ Art "), n, F.lit("]"), title, F.lit("\nSource: "), url, F.lit("\n\n first \nid "), n)
    answer = F.concat(F.lit("Here:\n```json\n{\"id\": "), n, F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise("}"), F.lit("\n``` done"))
    held = table(spark, d, "pages").select("page_id", answers.presented(context).alias("x"), answers.salvaged_json(answer, "id long")["id"].alias("salvaged"))
    return held.select("page_id", "x.citation", "x.title", "x.url", "x.excerpt", "salvaged")


@query("SELECT doc_id, toxic, quality FROM labels")
def label_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """Labels written as one sidecar document and read back under its contract."""
    path = f"{shared_dir(spark)}/sidecar-{uuid.uuid4().hex[:8]}"
    rows = written(table(spark, d, "labels").select(F.col("doc_id").alias("case_id"), F.col("doc_id").cast("string").alias("evidence_id"), "toxic", "quality"), "labels")
    n = rows.count()
    whole = rows.agg(F.lit(1).alias("schema_version"), F.lit(n).alias("total_cases"), F.lit(n).alias("total_evidence_items"), F.collect_list(F.struct("*")).alias("labels"))
    whole.coalesce(1).write.json(path)
    return records.sidecar(spark, path, "case_id long, evidence_id string, toxic int, quality int", 1).select(F.col("case_id").alias("doc_id"), "toxic", "quality")


@query("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id FROM events WHERE event_id % 11 <> 0 UNION ALL SELECT NULL, NULL FROM events WHERE event_id % 11 = 0")
def tolerant_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines of which some are broken and some lack a field."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex[:8]}"
    n = F.col("event_id")
    line = F.when(n % 11 == 0, F.lit("{broken")).when(n % 7 == 0, F.to_json(F.struct("event_id"))).otherwise(F.to_json(F.struct("event_id", "user_id")))
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return records.log_snapshot(spark, path, "event_id long, user_id long").select("event_id", "user_id")


@query("SELECT doc_id, true AS placed FROM documents")
def sharded_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents in four shards, each row under its shard and a place of its own there."""
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex[:8]}"
    table(spark, d, "documents").select("doc_id", "lang").repartition(4).write.parquet(path)
    rows = records.sharded(spark, path)
    sizes = rows.groupBy("shard").agg(((F.max("position") + 1 == F.count(F.lit(1))) & (F.count_distinct("position") == F.count(F.lit(1)))).alias("placed"))
    return rows.join(F.broadcast(sizes), "shard").select("doc_id", "placed")
