"""The queries of this subpackage, and the DuckDB SQL that checks them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import contamination as op4
from quern.llm import conversations as chat
from quern.llm import minhash, packing, passages, pii, repair, rules, shards, token_files, toxicity, url_rules, whitening
from quern.llm.tokens import encoder
from quern.sources.scratch import written
from quern.sources.tables import table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)),
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *rules.MEASURES, "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", (toxicity.fold_of(F.col("doc_id")) == toxicity.HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op4.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.col("n_hit")
    return found.withColumn("n_hit", op4.hit_words(F.col("hits"))).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"),
        op4.is_contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = []
            for whole in batch.column(1).to_pylist():
                turns = chat.read_back(whole)
                loss = "".join(text for _, text, low, high in turns if high > low)
                rows.append((len(turns), sha("".join(f"{role}\n{text}\n" for role, text, _, _ in turns)), len(loss), sha(loss), len(whole)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    made = chat.format_branches(chat.linear_trees(turns), trees=True)
    return made.select(F.col("conv").alias("conv_id"), "conversation").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("word_bpe_49k.json")
    width, size = encoder(path).dtype.itemsize, encoder(path).size
    tokens = written(token_files.token_table(table(spark, sf_dir, "documents"), path, end_id=1), "tokens")
    ranks = token_files.id_ranks(tokens, size, width)
    read = token_files.read_blocks(token_files.write_blocks(tokens, ranks, width), ranks)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, end_id=1, window=2048, with_ids=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), most=8).withColumn("deviation", F.col("deviation").cast("long"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.summaries(repair.repaired_pieces(repair.damaged(turns)))


#: Two regions of three racks of four shards.
SHARDS = shards.even_tree(2, 3, 4)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shards(table(spark, sf_dir, "documents"), SHARDS, shards.grown(SHARDS)).withColumn("law", F.lit("key"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_minhash": op5_minhash,
    "op6_chat_format": op6_chat_format,
    "op7_token_ids": op7_token_ids,
    "op8_packing": op8_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_whitening": op11_whitening,
    "op12_structure_repair": op12_structure_repair,
    "op13_sharding": op13_sharding,
}

#: The checksum of a text in SQL: its bytes through a table of the 256 remainders of the reversed polynomial.
CRC32_SQL = r"""crc_table AS (
  SELECT list(c ORDER BY i) AS remainders FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(0, 256) AS t(i)))"""


def crc32_sql(text: str) -> str:
    """SQL for the checksum of an expression, where ``crc_table`` is joined."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, remainders[xor(c, b) % 256 + 1]), 4294967295), 4294967295)"




def _way(state: str, cost: str, audit: str, body: str) -> str:
    """SQL for a state's price, audit and text with what one more step adds."""
    return f"{{'c': {state}.c + {cost}, 't': {state}.t || {audit}, 'b': {state}.b || {body}}}"


def _least(role: str, word: str, free: tuple[str, ...], paid: tuple[str, ...], insert: str) -> str:
    """SQL for the best of the ways to end in a role: this row deleted, or kept or reroled after each role before."""
    text = "chr(10) || word || ':' || text"
    ways = [_way(role, "3", "'D'", "''")]
    for states, inserted, more, made in ((free, "0", "''", "''"), (paid, "2", "'I'", f"chr(10) || '{insert}:'")):
        for state in states:
            ways.append(f"CASE WHEN stays AND initial = '{role}' THEN {_way(state, f'{inserted} + extra', f'{more} || {chr(39)}K{chr(39)}', f'{made} || ' + text.replace('word', 'role'))} END")
            if word:
                ways.append(f"CASE WHEN stays THEN {_way(state, f'{inserted} + 2 + extra', f'{more} || {chr(39)}R{chr(39)}', f'{made} || ' + text.replace('word', chr(39) + word + chr(39)))} END")
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


ORACLE_SQL = {
    "op12_structure_repair": rf"""
WITH RECURSIVE {CRC32_SQL},
kind AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations, crc_table),
hurt AS (
  SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kind, unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS twice(k)),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial, NOT regexp_matches(text, '[^ 	-
]') AS blank,
    row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut,
    lag(substr(role, 1, 1)) OVER (PARTITION BY g ORDER BY i) AS before
  FROM placed),
steps AS (SELECT g, i, role, text, initial, NOT (blank OR again) AS stays, CASE WHEN cut THEN 1 ELSE 0 END AS extra FROM judged),
faults AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY g),
state AS (
  SELECT DISTINCT g, 0::BIGINT AS i, {{'c': 0::BIGINT, 't': '', 'b': ''}} AS e, {{'c': 1000000000::BIGINT, 't': '', 'b': ''}} AS s,
    {{'c': 1000000000::BIGINT, 't': '', 'b': ''}} AS u, {{'c': 1000000000::BIGINT, 't': '', 'b': ''}} AS a FROM kind
  UNION ALL
  SELECT g, i + 1, {_way("e", "3", "'D'", "''")}, {_least("s", "", ("e",), (), "")}, {_least("u", "user", ("e", "s", "a"), ("u",), "assistant")},
    {_least("a", "assistant", ("u",), ("e", "s", "a"), "user")}
  FROM (SELECT state.*, role, text, initial, stays, extra FROM state JOIN steps ON steps.g = state.g AND steps.i = state.i + 1)),
best AS (
  SELECT g, list_sort([e, a, {_way("u", "2", "'I'", "chr(10) || 'assistant:'")}, {_way("s", "4", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'")}])[1] AS best
  FROM state QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c AS cost, best.t AS audit, sha256(substr(best.b, 2)) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM kind) JOIN best USING (g) LEFT JOIN faults USING (g)
""",
    "op2_quality_rules": r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
    coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
grams AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM doc, unnest(range(1, len(w) - 3)) AS s(i)),
twice AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM grams JOIN twice USING (r, g), unnest(range(i, i + 5)) AS s(p) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM doc),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM doc LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.25 * n_words AS failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS k FROM f GROUP BY source),
fit AS (SELECT avg(k / n) AS m, greatest(var_pop(k / n) - avg(k / n * (1 - k / n) / n), 1e-6) AS spread FROM h),
prior AS (SELECT m, least(greatest(m * (1 - m) / spread - 1, 1.0), 1e4) AS strength FROM fit),
bad AS (SELECT source FROM h, prior WHERE (k + m * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source IS NOT DISTINCT FROM f.source) AS kept
FROM f
""",
    "op5_minhash": r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM doc, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh AS a JOIN sh AS b USING (g) GROUP BY ALL),
link AS (
  SELECT a, b FROM common AS both_sets JOIN size AS x ON x.doc_id = a JOIN size AS y ON y.doc_id = b WHERE 100 * both_sets.n >= 85 * (x.n + y.n - both_sets.n)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN comp USING (doc_id)
""",
    "op6_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' THEN 8 ELSE 14 END + length(role) +
    length(regexp_replace(text, '(</?|\[/?)(\\*)(s>|INST\])', '\1\\\2\3', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
""",
    "op9_substring_dedup": r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM doc, unnest(range(1, len(w) - 33)) AS s(i)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, p FROM win JOIN twice USING (g), unnest(range(i, i + 35)) AS s(p)),
word AS (SELECT r, p, w[p] AS x FROM doc, unnest(range(1, len(w) + 1)) AS s(p)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
""",
    "op13_sharding": rf"""
WITH {CRC32_SQL},
tree AS (
  SELECT r, k, s, 'region' || r AS region, 'region' || r || '/rack' || k AS rack, 'region' || r || '/rack' || k || '/shard' || s AS leaf, 12 * r + 4 * k + s AS shard
  FROM range(0, 2) AS a(r), range(0, 3) AS b(k), range(0, 4) AS c(s)),
doc AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(doc_id::VARCHAR, '') AS key, strlen(coalesce(text, '')) + 8 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32
  FROM documents, crc_table),
region AS (
  SELECT id, name, weight, -ln((('0x' || substr(md5(key || '/' || name), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / weight AS draw
  FROM doc, (VALUES ('region0', 12.0::DOUBLE), ('region1', 12.0), ('grown2', 1.0)) AS v(name, weight)),
won AS (
  SELECT id, arg_min(name, draw) FILTER (name != 'grown2') AS region, arg_min(name, draw) = 'grown2' AS moved,
    arg_min(name, draw) AS grown_region FROM region GROUP BY id),
rack AS (
  SELECT id, arg_min(rack, -ln((('0x' || substr(md5(key || '/' || rack), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)) AS rack
  FROM doc JOIN won USING (id) JOIN (SELECT DISTINCT region, rack FROM tree) USING (region) GROUP BY id),
leaf AS (
  SELECT id, arg_min(shard, -ln((('0x' || substr(md5(key || '/' || leaf), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)) AS shard
  FROM doc JOIN rack USING (id) JOIN tree USING (rack) GROUP BY id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CASE WHEN moved THEN 24 ELSE shard END::INT AS grown_shard
FROM doc JOIN leaf USING (id) JOIN won USING (id)
""",
    "op10_url_filters": r"""
WITH url AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
part AS (
  SELECT r, page_id, translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM url),
rules(verdict, rule, rhost, rpath) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
fit AS (
  SELECT r, rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC, verdict DESC, rule DESC) AS k
  FROM part JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict,
  CASE WHEN regexp_matches(host || path, '(?s)(^([^/]*\.)?|/)(casino|porn|viagra|xxx)([^A-Za-z0-9-]|$)')
    OR regexp_matches(host || path, '(?s)^([^/]*\.)?[^/]*\.example\.[^/]*/ads/') OR regexp_matches(host || path, '(?s)^([^/]*\.)?tracker[^/]*\.[^/]*([^A-Za-z0-9-]|$)')
    OR regexp_matches(host || path, '(?s)/login[^/]*\.php$') OR regexp_matches(host || path, '(?s)/out([^A-Za-z0-9-]|$).*url')
    OR regexp_matches(host || path, '(?s)^([^/]*\.)?free-[^/]*-download\.[^/]*([^A-Za-z0-9-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM part LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (r)
""",
    "op4_decontamination": r"""
WITH bench AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM bench, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
grams AS (
  SELECT r, i, l, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM doc, (SELECT DISTINCT l FROM win) AS ls, unnest(range(1, len(w) - l + 2)) AS t(i)),
found AS (SELECT r, i, grams.l, item_id FROM grams JOIN win ON grams.l = win.l AND grams.g = win.g),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + l)) AS t(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
""",
}
