"""DuckDB SQL of the registered queries."""

from __future__ import annotations

_TERMS = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')"
_CLEAN = r"trim(regexp_replace(coalesce({c}, ''), '\s+', ' ', 'g'))"
NORMALIZED_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(nfc_normalize(coalesce(text, '')), chr(65279), ''), chr(160), ' '), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_SPACED = r"list_filter(regexp_split_to_array(coalesce({c}, ''), '\s+'), lambda x: x <> '')"
METRIC_SQL = r"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _terms(c: str = "text") -> str:
    return _TERMS.format(c=c)


def _spaced(c: str = "text") -> str:
    return _SPACED.format(c=c)


LEXICAL_SQL = f"""
qt AS (
  SELECT DISTINCT item_id AS query_id, term FROM (
    SELECT item_id, unnest(list_distinct(list_filter(t, lambda x: length(x) >= 2))) AS term
    FROM (SELECT item_id, {_terms()} AS t FROM benchmark))),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms()}) AS term FROM documents) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(sum(1 + ln(tf)), 6) AS score FROM qt JOIN tf USING (term) GROUP BY ALL),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 24)"""
_GOLD = f"""
gold AS (
  SELECT DISTINCT item_id AS query_id, doc_id
  FROM (SELECT item_id, lower({_CLEAN.format(c='text')}) AS a, string_split(lower({_CLEAN.format(c='text')}), ' ') AS w FROM benchmark) AS q
  JOIN (SELECT doc_id, lower({_CLEAN.format(c='text')}) AS b FROM documents) AS x ON a <> '' AND (contains(b, a) OR (len(w) >= 20
    AND contains(b, array_to_string(w[1:12], ' '))::INT + contains(b, array_to_string(w[len(w) // 2 - 5:len(w) // 2 + 6], ' '))::INT + contains(b, array_to_string(w[len(w) - 11:], ' '))::INT >= 2))),
exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM gold) WHERE rank <= 24)"""
_FUSED = """
fusing AS (
  SELECT query_id, doc_id, list_reduce(list_transform(list_sort(list(rank)), lambda r: 1.0::DOUBLE / (60 + r)), lambda a, b: a + b) AS total, count(*) AS n_lanes, min(own) AS own
  FROM (SELECT query_id, doc_id, rank, NULL::BIGINT AS own FROM lexical UNION ALL SELECT query_id, doc_id, rank, rank FROM exact) GROUP BY query_id, doc_id),
fused AS (SELECT query_id, doc_id, round(total, 9) AS score, n_lanes, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, own NULLS LAST, doc_id) AS rank FROM fusing)"""
_FOUND = """
found AS (SELECT query_id, doc_id, rank FROM gold LEFT JOIN lexical USING (query_id, doc_id))"""


def _recalls(found: str, name: str = "recalls", ks: str = "1, 3, 5, 10, 24, 50") -> str:
    return f"""
{name} AS (
  SELECT *, CASE WHEN k <= 24 AND gold_n > 0 THEN found_n / gold_n END AS recall,
    CASE WHEN k > 24 THEN 'k_exceeds_configured_capacity' WHEN gold_n = 0 THEN 'no_gold' END AS reason
  FROM (SELECT item_id AS query_id, k, count(f.doc_id) AS gold_n, count(*) FILTER (f.rank <= k) AS found_n
    FROM benchmark CROSS JOIN (SELECT unnest([{ks}]) AS k) LEFT JOIN {found} AS f ON f.query_id = item_id GROUP BY ALL))"""


_BOTH = LEXICAL_SQL + "," + _GOLD
PAIRS_SQL = """
pairs AS (
  SELECT a.conv_id, a.turn, a.text AS answer, u.text AS reference FROM conversations AS a
  JOIN conversations AS u ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""
_MULTI = "list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x)))))"
REFUSED_SQL = r"""
refused AS (
  SELECT *, CASE
    WHEN contains(low, 'error') OR contains(low, 'timeout') THEN 'technical_error'
    WHEN NOT length(trim(reference)) > 60 THEN 'no_evidence'
    WHEN (contains(low, 'ne sais') OR contains(low, 'nicht') OR contains(low, 'not the')) AND (n > 50 OR regexp_matches(low, 'article [0-9]+')) THEN 'mixed_claim_refusal'
    WHEN contains(low, 'ne sais') OR contains(low, 'nicht') OR contains(low, 'not the') THEN 'pure_refusal'
    WHEN contains(low, 'ein ') OR contains(low, 'le ') THEN 'disclaimer' ELSE 'normal_answer' END AS category
  FROM (SELECT *, lower(trim(coalesce(answer, ''))) AS low, len(""" + _spaced("answer") + r""") AS n FROM pairs))"""
_F1 = f"""
f1s AS (
  SELECT *, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN coalesce(k, 0) = 0 THEN 0.0 ELSE round(2.0::DOUBLE * k / (len(a) + len(b)), 4) END AS f1
  FROM (SELECT *, {_MULTI.format(a='a', b='b')} AS k
    FROM (SELECT *, list_filter(string_split({METRIC_SQL.format(c='answer')}, ' '), lambda x: x <> '') AS a, list_filter(string_split({METRIC_SQL.format(c='reference')}, ' '), lambda x: x <> '') AS b FROM SOURCE)))"""
VECTORS = """
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, q.label AS q_label, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings AS q JOIN embeddings AS v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)"""


def _chrf() -> str:
    gram = "list_transform(range(1, greatest(length({s}) - {n} + 2, 1)), lambda i: substr({s}, i, {n}))"
    parts = []
    for n in range(1, 7):
        a, b = (gram.format(s=s, n=n) for s in "pr")
        parts.append(f"SELECT conv_id, turn, p, r, {n} AS n, {a} AS a, {b} AS b FROM texts WHERE length(p) >= {n} AND length(r) >= {n}")
    return f"""
WITH {PAIRS_SQL},
texts AS (SELECT conv_id, turn, replace({METRIC_SQL.format(c='answer')}, ' ', '') AS p, replace({METRIC_SQL.format(c='reference')}, ' ', '') AS r FROM pairs),
grams AS ({' UNION ALL '.join(parts)}),
ca AS (SELECT conv_id, turn, n, g, count(*) AS k FROM (SELECT conv_id, turn, n, unnest(a) AS g FROM grams) GROUP BY ALL),
cb AS (SELECT conv_id, turn, n, g, count(*) AS k FROM (SELECT conv_id, turn, n, unnest(b) AS g FROM grams) GROUP BY ALL),
common AS (SELECT conv_id, turn, n, sum(least(ca.k, cb.k)) AS c FROM ca JOIN cb USING (conv_id, turn, n, g) GROUP BY ALL),
s AS (
  SELECT conv_id, turn, avg(coalesce(c, 0) / len(a)) AS pr, avg(coalesce(c, 0) / len(b)) AS re
  FROM grams LEFT JOIN common USING (conv_id, turn, n) GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN p = '' OR r = '' THEN (p = r)::INT::DOUBLE WHEN pr = 0 AND re = 0 THEN 0.0 ELSE round(5.0::DOUBLE * pr * re / (4.0::DOUBLE * pr + re), 4) END AS score
FROM texts LEFT JOIN s USING (conv_id, turn)"""


_SUMMARY = "round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.95), 4) AS p95, round(min({c}), 4) AS least, round(max({c}), 4) AS most"
_MACRO = "round(avg(recall), 6) AS macro, round(sum(found_n) FILTER (recall IS NOT NULL) / nullif(sum(gold_n) FILTER (recall IS NOT NULL), 0), 6) AS micro"

ORACLE_SQL = {
    "rrf_fusion": f"WITH {_BOTH},{_FUSED} SELECT query_id, doc_id, score, n_lanes, rank FROM fused WHERE rank <= 10",
    "balanced_interleave": f"""WITH {_BOTH},
p AS (SELECT query_id, doc_id, min({{'r': rank, 'l': lane}}) AS place FROM (SELECT query_id, doc_id, rank, 0 AS lane FROM lexical UNION ALL SELECT query_id, doc_id, rank, 1 FROM exact) GROUP BY ALL)
SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place.r, place.l) AS rank FROM p) WHERE rank <= 10""",
    "stable_merge": f"""WITH {_BOTH},
p AS (SELECT query_id, doc_id, min({{'l': lane, 'r': rank}}) AS place FROM (SELECT query_id, doc_id, rank, 0 AS lane FROM exact UNION ALL SELECT query_id, doc_id, rank, 1 FROM lexical) GROUP BY ALL)
SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place.l, place.r) AS rank FROM p) WHERE rank <= 10""",
    "per_doc_cap_topn": f"""WITH {_BOTH},{_FUSED},
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS turn FROM fused JOIN documents USING (doc_id))
SELECT query_id, doc_id, source, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS final_rank FROM c WHERE turn <= 2) WHERE final_rank <= 10""",
    "local_topk_per_group": "SELECT * FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents) WHERE rank <= 3",
    "lexical_prefilter": f"""WITH {LEXICAL_SQL},
phrase AS (SELECT DISTINCT item_id AS query_id, doc_id FROM (SELECT item_id, lower({_CLEAN.format(c='text')}) AS a FROM benchmark) AS q JOIN (SELECT doc_id, lower({_CLEAN.format(c='text')}) AS b FROM documents) AS x ON a <> '' AND contains(b, a)),
s AS (SELECT query_id, doc_id, round(coalesce(score, 0) + CASE WHEN g.doc_id IS NULL THEN 0 ELSE 8.0::DOUBLE END, 6) AS score
  FROM scored FULL JOIN phrase AS g USING (query_id, doc_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
    "token_budget_select": f"""WITH {LEXICAL_SQL},
h AS (SELECT query_id, rank, score, source, trunc(n_chars / 5)::BIGINT AS tokens, doc_id FROM lexical JOIN documents USING (doc_id))
SELECT query_id, x.used AS used, array_to_string(list_transform(x.held, lambda h: h.id::VARCHAR), ',') AS chosen FROM (
  SELECT query_id, list_reduce(
    list_transform(list_sort(list({{'rank': rank, 'score': score, 'grp': source, 'tokens': tokens, 'id': doc_id}})), lambda i: {{'used': 0::BIGINT, 'held': [{{'grp': i.grp, 'id': i.id, 'score': i.score, 'tokens': i.tokens}}]}}),
    lambda s, i: CASE WHEN i.held[1].score >= 2.0 AND len(list_filter(s.held, lambda h: h.grp = i.held[1].grp)) < 1 AND s.used + i.held[1].tokens <= 720 AND len(s.held) < 3
      THEN {{'used': s.used + i.held[1].tokens, 'held': list_concat(s.held, i.held)}} ELSE s END,
    {{'used': 0::BIGINT, 'held': [{{'grp': 'x', 'id': 0::BIGINT, 'score': 0.0::DOUBLE, 'tokens': 0::BIGINT}}][1:0]}}) AS x FROM h GROUP BY query_id)""",
    "bm25_title_topk": """WITH w AS (SELECT p_partkey AS doc_id, regexp_extract_all(lower(coalesce(p_name, '')), '[\\p{L}\\p{N}]+') AS t FROM part),
st AS (SELECT count(*) AS n, avg(len(t)) AS al FROM w),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT doc_id AS query_id, term FROM (SELECT doc_id, unnest(t) AS term FROM w WHERE doc_id % 100 = 0) WHERE length(term) >= 2),
s AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / al))), 6) AS score
  FROM tf JOIN q USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
    "sparse_bm25_weights": f"""WITH w AS (SELECT doc_id, {_terms()} AS t FROM documents),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS l, unnest(t) AS term FROM w) GROUP BY ALL),
s AS (SELECT doc_id, term, round(tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / (SELECT greatest(avg(len(t)), 1) FROM w))), 6) AS weight FROM tf)
SELECT doc_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS k FROM s) WHERE k <= 64""",
    "query_tf_weights": f"SELECT item_id AS query_id, term, round(1 + ln(count(*)), 6) AS weight FROM (SELECT item_id, unnest({_terms()}) AS term FROM benchmark) GROUP BY ALL",
    "cosine_topk": f"WITH {VECTORS} SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5",
    "dot_hybrid_alpha": f"""WITH {VECTORS}, b AS (SELECT query_id, vec_id, round(0.75::DOUBLE * score + 0.25::DOUBLE * (label = q_label)::INT, 6) AS score FROM scored)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM b) WHERE rank <= 5""",
    "semantic_cache_lookup": f"WITH {VECTORS} SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored WHERE score >= 0.3) WHERE rank = 1",
    "maxsim_rerank": """SELECT query_id, label, round(sum(best), 6) AS score FROM (
  SELECT q.vec_id // 300 AS query_id, q.vec_id AS part, v.label, max(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS best
  FROM embeddings AS q CROSS JOIN embeddings AS v WHERE q.vec_id % 100 = 0 GROUP BY ALL) GROUP BY ALL""",
    "class_recall": f"""WITH {VECTORS}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10)
SELECT query_id, round(avg((label = q_label)::INT), 6) AS precision_at_10, min(rank) FILTER (label = q_label) AS first_rank FROM t GROUP BY query_id""",
    "neighbor_expand": """SELECT min(s.l_orderkey * 8 + s.l_linenumber) AS seed_rank, n.l_orderkey, n.l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) AS s
JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) AS n ON n.l_orderkey = s.l_orderkey AND abs(n.l_linenumber - s.l_linenumber) <= 1 GROUP BY ALL""",
    "exact_ref_lane": f"WITH {_BOTH} SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored SEMI JOIN gold USING (query_id, doc_id)) WHERE rank <= 24",
    "anchor_containment": f"WITH {_GOLD} SELECT DISTINCT query_id, doc_id FROM gold",
    "tiered_search": f"""WITH {_GOLD}, t AS (SELECT query_id, doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS tier FROM gold JOIN documents USING (doc_id)),
m AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS first FROM t)
SELECT query_id, doc_id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM m WHERE tier = first) WHERE rank <= 5""",
    "payload_validity": f"""WITH {_BOTH}, h AS (SELECT query_id, doc_id, true AS lexical FROM lexical
UNION ALL SELECT query_id, doc_id, false FROM exact WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0)
SELECT query_id, doc_id, bool_or(lexical) AS lexical FROM h GROUP BY ALL""",
    "join_integrity": """SELECT DISTINCT doc_id AS key, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT DISTINCT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "full_outer_diff": "SELECT count(*) FILTER (r IS NULL) AS left_only, count(*) FILTER (l IS NULL) AS right_only, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS both_sides FROM (SELECT DISTINCT doc_id, 1 AS l FROM documents) FULL JOIN (SELECT DISTINCT doc_id, 1 AS r FROM labels) USING (doc_id)",
    "metadata_join": "SELECT lang, quality, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "duplicate_content": f"SELECT sha256({NORMALIZED_SQL}) AS content_sha256, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "quality_flags": f"""WITH b AS (SELECT doc_id, source, {NORMALIZED_SQL} AS t FROM documents), h AS (SELECT *, sha256(t) AS s, count(*) OVER (PARTITION BY t) AS k FROM b)
SELECT doc_id, s AS content_sha256, '[' || array_to_string(list_filter([
  CASE WHEN length(t) > 0 AND (length(t) < 20 OR length(t) > 20000000) THEN '"abnormal_length"' END, CASE WHEN k > 1 THEN '"duplicate_content_hash"' END,
  CASE WHEN length(t) = 0 THEN '"empty_content"' END, CASE WHEN regexp_matches(t, '\\x{{FFFD}}|Ã[\\x{{80}}-\\x{{BF}}]|Â[\\x{{80}}-\\x{{BF}}]|Ä[\\x{{80}}-\\x{{BF}}ƒ‘’]|Æ[\\x{{80}}-\\x{{BF}}]|á[º»]|â[\\x{{80}}-\\x{{BF}}€‘-…]') THEN '"encoding_damage"' END,
  CASE WHEN coalesce(trim(source), '') = '' THEN '"missing_source_url"' END], lambda x: x IS NOT NULL), ',') || ']' AS flags FROM h""",
    "quality_histogram": f"""WITH b AS (SELECT doc_id, source, {NORMALIZED_SQL} AS t FROM documents), h AS (SELECT *, count(*) OVER (PARTITION BY t) AS k FROM b)
SELECT 'abnormal_length' AS flag, count(*) FILTER (length(t) > 0 AND (length(t) < 20 OR length(t) > 20000000)) AS n FROM h
UNION ALL SELECT 'duplicate_content_hash', count(*) FILTER (k > 1) FROM h UNION ALL SELECT 'empty_content', count(*) FILTER (length(t) = 0) FROM h
UNION ALL SELECT 'encoding_damage', count(*) FILTER (regexp_matches(t, '\\x{{FFFD}}|Ã[\\x{{80}}-\\x{{BF}}]|Â[\\x{{80}}-\\x{{BF}}]|Ä[\\x{{80}}-\\x{{BF}}ƒ‘’]|Æ[\\x{{80}}-\\x{{BF}}]|á[º»]|â[\\x{{80}}-\\x{{BF}}€‘-…]')) FROM h
UNION ALL SELECT 'missing_source_url', count(*) FILTER (coalesce(trim(source), '') = '') FROM h
UNION ALL SELECT unnest(['invalid_issuance_date', 'missing_document_number', 'missing_title']), 0""",
    "build_report": f"SELECT count(*) AS n_docs, sum(strlen({NORMALIZED_SQL}))::BIGINT AS content_bytes, count(*) FILTER (length({NORMALIZED_SQL}) = 0) AS n_empty, round(avg(CASE WHEN doc_id % 128 = 0 THEN len({_terms()}) END), 6) AS mean_terms FROM documents",
    "keyset_page": "SELECT doc_id, lang FROM documents WHERE doc_id > 100 AND trim(lang) IN ('de', 'fr') ORDER BY doc_id LIMIT 25",
    "text_normalize": f"SELECT doc_id, sha256({NORMALIZED_SQL}) AS sha, length({_CLEAN.format(c='text')})::INTEGER AS clean_chars FROM documents",
    "token_windows": f"""WITH w AS (SELECT doc_id, {_spaced()} AS t FROM documents),
s AS (SELECT doc_id, t, i FROM w, unnest(range(0, len(t), 80)) AS r(i) WHERE i = 0 OR i - 80 + 96 < len(t))
SELECT doc_id, (i / 80)::INTEGER AS window_no, len(t[i + 1:i + 96])::INTEGER AS n_tokens, sha256(array_to_string(t[i + 1:i + 96], ' ')) AS sha FROM s""",
    "dense_text": f"SELECT doc_id, trim(substr(array_to_string(({_spaced("'source ' || coalesce(source, '') || ' ' || coalesce(text, '')")})[1:420], ' '), 1, 2400)) AS dense_text FROM documents",
    "pii_redact": r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+', '[EMAIL]', 'g'),
  '(\+?84|0)([35789][0-9]{8})([^\p{L}\p{N}_]|$)', '[PHONE]\3', 'g'), '(^|[^\p{L}\p{N}_])([0-9]{12}|[0-9]{9})([^\p{L}\p{N}_]|$)', '\1[ID]\3', 'g')) AS sha FROM documents""",
    "secret_redact": r"""SELECT page_id, substr(replace(regexp_replace(regexp_replace(regexp_replace(trim(url || '&token=s3cret Bearer ab.c-9 forbearer kept xy-known-1 mongodb://u:p4ss@h/x'),
  '(?i)([?&](?:api[_-]?key|key|token|secret|password|auth|bearer)=)[^&\s]+', '\1[REDACTED]', 'g'), '(?i)(^|[^\p{L}\p{N}_])(bearer\s+)[a-zA-Z0-9_\-.]+', '\1\2[REDACTED]', 'g'),
  '(?i)(mongodb(?:\+srv)?://[^\s:]+:)([^@\s]+)(@[^\s]+)', '\1[REDACTED]\3', 'g'), 'xy-known-1', '[REDACTED]'), 1, 200) AS message FROM pages""",
    "source_host": "SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
    "recall_at_k": f"WITH {_BOTH},{_FOUND},{_recalls('found')} SELECT query_id, k, found_n, gold_n, round(recall, 6) AS recall, reason FROM recalls",
    "macro_micro": f"WITH {_BOTH},{_FOUND},{_recalls('found')} SELECT k, {_MACRO}, count(recall) AS n_defined, count(*) - count(recall) AS n_undefined FROM recalls GROUP BY k",
    "null_reasons": f"WITH {_BOTH},{_FOUND},{_recalls('found')} SELECT k, reason, count(*) AS n FROM recalls WHERE reason IS NOT NULL GROUP BY ALL",
    "mrr": f"WITH {_BOTH},{_FOUND} SELECT query_id, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS rr FROM found GROUP BY query_id",
    "ndcg10": f"""WITH {_BOTH},{_FOUND}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS place FROM found)
SELECT query_id, round(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN place <= 10 THEN 1 / log2(place + 1) ELSE 0 END), 6) AS ndcg FROM p GROUP BY query_id""",
    "multihop_coverage": f"WITH {_BOTH},{_FOUND} SELECT query_id, bool_and(rank IS NOT NULL) AS all_found, round(avg((rank IS NOT NULL)::INT), 6) AS share FROM found GROUP BY query_id",
    "first_loss": f"WITH {_BOTH},{_FOUND} SELECT query_id, doc_id, CASE WHEN rank IS NULL THEN 'lexical' WHEN rank > 10 THEN 'top_10' WHEN rank > 3 THEN 'top_3' END AS stage FROM found",
    "candidate_distribution": f"""WITH {LEXICAL_SQL}, c AS (SELECT query_id, count(*) AS n FROM lexical GROUP BY 1)
SELECT count(*) AS n, min(n) AS least, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, max(n) AS most FROM c""",
    "reranker_delta": f"""WITH {_BOTH},{_FUSED},{_FOUND}, ffound AS (SELECT query_id, doc_id, fused.rank FROM gold LEFT JOIN fused USING (query_id, doc_id)),{_recalls('found', 'r1', '1, 3')},{_recalls('ffound', 'r2', '1, 3')}
SELECT *, round("after" - "before", 6) AS delta FROM (SELECT k, round(avg(recall), 6) AS "before" FROM r1 GROUP BY k) JOIN (SELECT k, round(avg(recall), 6) AS "after" FROM r2 GROUP BY k) USING (k)""",
    "winner_by_recall": f"""WITH {_BOTH},{_FUSED},{_FOUND}, ffound AS (SELECT query_id, doc_id, fused.rank FROM gold LEFT JOIN fused USING (query_id, doc_id)),{_recalls('found', 'r1', '3, 10')},{_recalls('ffound', 'r2', '3, 10')},
a AS (SELECT 'lexical' AS profile, k, round(avg(recall), 6) AS recall FROM r1 GROUP BY k UNION ALL SELECT 'fused', k, round(avg(recall), 6) FROM r2 GROUP BY k),
t AS (SELECT * FROM a WHERE recall IS NOT NULL AND k = (SELECT max(k) FROM a WHERE recall IS NOT NULL))
SELECT k, max(recall) AS best, CASE WHEN count(*) FILTER (recall = (SELECT max(recall) FROM t)) = 1 AND max(recall) > 0 THEN arg_max(profile, recall) END AS winner FROM t GROUP BY k""",
    "threshold_gate": """WITH v AS (SELECT count(*) FILTER (event_type = 'error') / count(*) AS e, avg(value) AS m, count(*) FILTER (event_type = 'absent')::DOUBLE AS a FROM events)
SELECT 'error_rate' AS metric, round(e, 6) AS value, CASE WHEN e <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM v
UNION ALL SELECT 'mean_value', round(m, 6), CASE WHEN m IS NULL THEN 'UNSUPPORTED' WHEN m >= 1e9 THEN 'PASS' ELSE 'FAIL' END FROM v
UNION ALL SELECT 'absent', round(a, 6), CASE WHEN a = 0 THEN 'PASS' ELSE 'FAIL' END FROM v""",
    "token_f1": f"WITH {PAIRS_SQL},{_F1.replace('SOURCE', 'pairs')} SELECT conv_id, turn, f1 FROM f1s",
    "char3_f1": f"""WITH {PAIRS_SQL},
texts AS (SELECT conv_id, turn, {METRIC_SQL.format(c='answer')} AS p, {METRIC_SQL.format(c='reference')} AS r FROM pairs),
ga AS (SELECT conv_id, turn, substr(p, i, 3) AS g, count(*) AS k FROM texts, unnest(range(1, length(p) - 1)) AS s(i) GROUP BY ALL),
gb AS (SELECT conv_id, turn, substr(r, i, 3) AS g, count(*) AS k FROM texts, unnest(range(1, length(r) - 1)) AS s(i) GROUP BY ALL),
c AS (SELECT conv_id, turn, sum(least(ga.k, gb.k)) AS c FROM ga JOIN gb USING (conv_id, turn, g) GROUP BY ALL)
SELECT conv_id, turn, CASE WHEN p = '' OR r = '' THEN (p = r)::INT::DOUBLE WHEN coalesce(c, 0) = 0 THEN 0.0 ELSE round(2.0::DOUBLE * c / (length(p) - 2 + length(r) - 2), 4) END AS f1
FROM texts LEFT JOIN c USING (conv_id, turn)""",
    "chrf": _chrf(),
    "refusal_classify": f"WITH {PAIRS_SQL},{REFUSED_SQL} SELECT conv_id, turn, category FROM refused",
    "entity_extract": r"""SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:[.,][0-9]+)?'), '|') AS numbers,
  array_to_string(regexp_extract_all(coalesce(text, ''), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}'), '|') AS dates,
  array_to_string(list_filter(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*'), lambda x: length(x) > 3), '|') AS names FROM documents""",
    "answer_aggregate": f"WITH {PAIRS_SQL},{REFUSED_SQL},{_F1.replace('SOURCE', 'refused')} SELECT category, count(*) AS n, round(avg(f1), 6) AS mean_f1, round(avg((f1 >= 0.1)::INT), 6) AS pass_rate FROM f1s GROUP BY category",
    "bounded_context": f"""WITH t AS (SELECT conv_id, sum(len({_spaced()})) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations)
SELECT conv_id, least(60, max(s))::INTEGER AS tokens, (count(*) FILTER (s <= 60))::INTEGER AS whole_turns FROM t GROUP BY conv_id""",
    "session_export": "SELECT conv_id, sha256(string_agg('**' || coalesce(role, '') || '**: ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS sha FROM conversations GROUP BY conv_id",
    "session_title": f"SELECT conv_id, array_to_string(w[1:5], ' ') || CASE WHEN len(w) > 5 THEN '...' ELSE '' END AS title FROM (SELECT conv_id, {_spaced()} AS w FROM conversations WHERE turn = 0)",
    "title_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'g') ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 5",
    "admin_facet": "SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors, round(100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*), 2) AS error_rate, count(DISTINCT user_id) AS users, round(avg(coalesce(value, 0)), 4) AS mean_value FROM events",
    "online_rollup": f"SELECT event_type, count(*) AS n, {_SUMMARY.format(c='value')}, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type",
    "latency_summary": f"SELECT stage, count(ms) AS n, {_SUMMARY.format(c='ms')} FROM (SELECT 'total' AS stage, value AS ms FROM events UNION ALL SELECT 'half', value / 2 FROM events) GROUP BY stage",
    "nearest_rank_p95": """SELECT event_type, value AS at_rank FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
WHERE k = greatest(ceil(0.95::DOUBLE * n), 1)""",
    "daily_quota": """WITH a AS (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE, user_id ORDER BY ts, event_id)::INTEGER AS turn FROM events)
SELECT event_id, user_id, turn, place FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id)::INTEGER AS place FROM a WHERE turn <= 2) WHERE place <= 40""",
    "rate_limit_windows": "SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1",
    "latest_state": "SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type, arg_max(value, {'t': ts, 'e': event_id}) AS value, count(*) AS n FROM events GROUP BY user_id",
    "resume_pending": "SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 5) GROUP BY 1",
    "hash_bucket_sample": "SELECT doc_id FROM documents WHERE ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.1",
    "stratified_round_robin": """SELECT doc_id, lang, source, turn FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('seed-1' || chr(0) || doc_id), doc_id) AS turn FROM documents)
ORDER BY turn, lang NULLS FIRST, source NULLS FIRST LIMIT 50""",
    "quantile_strata": "SELECT doc_id, lang, least(3, (k - 1) * 4 // n)::INTEGER AS bucket FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)",
    "evenly_spaced": "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id FROM o WHERE k IN (SELECT DISTINCT i * (n - 1) // 16 FROM range(17) AS r(i), (SELECT count(*) AS n FROM documents))",
    "systematic_sample": "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) SELECT doc_id FROM o WHERE k IN (SELECT i * n // 13 FROM range(13) AS r(i), (SELECT count(*) AS n FROM documents))",
    "representative_min_hash": "SELECT source, arg_min(doc_id, {'h': sha256(doc_id::VARCHAR), 'd': doc_id}) AS doc_id FROM documents GROUP BY source",
}
