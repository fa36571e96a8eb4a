"""Ranked lists as one long table: query_id, lane, rank, doc_id, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources.scratch import written

RRF_K = 60
#: Bytes of rows, written out as JSON, in one broadcast; more are joined in parts or by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Pairs of a query and a document that one task of a lexical lane scores, if each shares a term with each.
TASK_PAIRS = 1 << 19


def size_in_bytes(table: DataFrame) -> int:
    """Bytes of a table's rows written out as JSON, which is more than they take in memory but for small numbers."""
    return table.agg(F.sum(F.octet_length(F.to_json(F.struct(*table.columns))).cast("long"))).first()[0] or 0


def blocks(table: DataFrame, most: int | None = None) -> list[DataFrame]:
    """``table``, written, as broadcasts of ``most`` bytes or so, for joins that no key narrows: never a product of two large tables."""
    held = written(table, "blocks")
    parts = -(-max(size_in_bytes(held), 1) // (most or BROADCAST_BYTES))
    if parts == 1:
        return [F.broadcast(held)]
    split = written(held.withColumn("_block", F.pmod(F.xxhash64(*table.columns), F.lit(parts))), "blocks")
    return [F.broadcast(split.where(F.col("_block") == k).drop("_block")) for k in range(parts)]


def together(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def bounded(table: DataFrame, most: int | None = None) -> DataFrame:
    """``table``, written, to be broadcast where it has ``most`` bytes at most."""
    held = written(table, "bounded")
    return F.broadcast(held) if size_in_bytes(held) <= (most or BROADCAST_BYTES) else held


def ranked(scored: DataFrame, top: int, *order: Column, by: str = "query_id") -> DataFrame:
    """Rows of each query by ``order``, with rank, the first ``top``."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= top)


def lexical_lane(queries: DataFrame, docs: DataFrame, top: int = 24, phrase_bonus: float = 0.0, within: DataFrame | None = None) -> DataFrame:
    """Sum of 1 + ln(tf) over all distinct terms of a query, and ``phrase_bonus`` where the text holds the whole query; joined by term, so that only sharing pairs meet.

    ``within`` (query_id, doc_id): only these are ranked. Null and empty texts share nothing; ties go to the smaller doc_id.
    """
    wanted = queries.select("query_id", F.explode(T.query_terms(F.col("text"))).alias("term"))
    vocabulary = bounded(wanted.select("term").distinct())
    tokens = docs.select("doc_id", F.explode(T.terms(F.col("text"))).alias("term")).join(vocabulary, "term", "left_semi").select("doc_id", "term", F.lit(None).cast(queries.schema["query_id"].dataType).alias("asked"))
    if phrase_bonus:
        hits = containment(queries, docs, windows=False)
        tokens = tokens.unionByName(hits.select("doc_id", F.lit(None).cast("string").alias("term"), F.col("query_id").alias("asked")))
    # dealt by doc_id alone, so that counts and scores of a document are made where its tokens are; no task gets many more pairs than the bound
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.repartition(max(least, -(-docs.count() * queries.count() // TASK_PAIRS)), "doc_id")
    postings = dealt.groupBy("doc_id", "term", "asked").agg(F.count(F.lit(1)).alias("tf"))
    met = postings.join(bounded(wanted), "term", "left").withColumn("query_id", F.coalesce("query_id", "asked"))
    summed = F.round(F.sum(F.when(F.col("term").isNotNull(), 1 + F.log("tf"))), 6)
    whole = F.max(F.when(F.col("term").isNull(), F.lit(phrase_bonus)))
    score = F.round(F.coalesce(summed, F.lit(0.0)) + F.coalesce(whole, F.lit(0.0)), 6) if phrase_bonus else summed
    scored = met.groupBy("query_id", "doc_id").agg(score.alias("score"))
    if within is not None:
        scored = scored.join(bounded(within.select("query_id", "doc_id").distinct()), ["query_id", "doc_id"], "left_semi")
    return ranked(scored, top, F.desc("score"), F.asc("doc_id"))


WINDOW_WORDS, LEAST_WORDS = 12, 20


def needles(queries: DataFrame) -> DataFrame:
    """query_id, part and needle: each cleaned, lower-case anchor (0) and, from ``LEAST_WORDS`` words on, its first, middle and last windows (1 to 3)."""
    asked = queries.select("query_id", F.lower(T.clean(F.col("text"))).alias("anchor")).where(F.col("anchor") != "").withColumn("words", F.split("anchor", " "))
    n = F.size("words")
    window = lambda start: F.array_join(F.slice("words", start, F.lit(WINDOW_WORDS)), " ")
    half = WINDOW_WORDS // 2
    cut = F.array(window(F.lit(1)), window(F.floor(n / 2).cast("int") - half + 1), window(n - WINDOW_WORDS + 1))
    parts = F.concat(F.array("anchor"), F.when(n >= LEAST_WORDS, cut).otherwise(F.array().cast("array<string>")))
    return asked.select("query_id", F.posexplode(parts).alias("part", "needle"))


def containment(queries: DataFrame, docs: DataFrame, windows: bool = True) -> DataFrame:
    """query_id and doc_id where the cleaned, lower-case text holds the query's, or (with ``windows``) two of its three windows, as substrings.

    The tokens within a needle, without its first and last, must be whole tokens of the text. The longest of them (ties:
    the smaller) is joined by equality with the distinct tokens of texts; texts are fetched for pairs that meet there.
    Needles of under three tokens have no such token and are compared with all texts, in blocks. Null and empty queries
    are contained in nothing; repeated rows count once.
    """
    words = F.split("needle", " ")
    inner = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda x: F.struct((-F.length(x)).alias("n"), x.alias("token")))
    parts = needles(queries) if windows else needles(queries).where("part = 0")
    asked = written(parts.withColumn("key", F.array_min(inner)["token"]), "needles")
    body = docs.select("doc_id", F.lower(T.clean(F.col("text"))).alias("body"))
    keyed = asked.where(F.col("key").isNotNull())
    tokens = body.select("doc_id", F.explode(F.array_distinct(F.split("body", " "))).alias("key"))
    pairs = written(tokens.join(bounded(keyed), "key").select("doc_id", "query_id", "part", "needle").distinct(), "pairs")
    found = pairs.join(body, "doc_id").where(F.contains("body", "needle")).select("query_id", "doc_id", "part")
    short = [body.join(part, F.contains("body", "needle")).select("query_id", "doc_id", "part") for part in blocks(asked.where(F.col("key").isNull()))]
    parts = together([found, *short]).groupBy("query_id", "doc_id").agg(F.collect_set("part").alias("parts"))
    return parts.where(F.array_contains("parts", 0) | (F.size("parts") >= 2)).select("query_id", "doc_id")


def fused(lanes: DataFrame, k: int = RRF_K, first_lane: str = "exact") -> DataFrame:
    """Reciprocal-rank fusion of query_id, lane, rank, doc_id: score and rank.

    Ties go to items that ``first_lane`` has, then to its smaller rank, then to the smaller doc_id. Sums are taken in the
    order of ranks, so equal ranks make equal sums. A repeated item counts at its first rank.
    """
    first = lanes.groupBy("query_id", "lane", "doc_id").agg(F.min("rank").alias("rank"))
    scored = first.groupBy("query_id", "doc_id").agg(
        F.aggregate(F.array_sort(F.collect_list("rank")), F.lit(0.0), lambda s, r: s + 1.0 / (k + r)).alias("sum"),
        F.count(F.lit(1)).alias("n_lanes"),
        F.min(F.when(F.col("lane") == first_lane, F.col("rank"))).alias("own"),
    )
    order = (F.desc("sum"), F.asc_nulls_last("own"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).select("query_id", "doc_id", F.round("sum", 9).alias("score"), "n_lanes", "rank")


def merged_lanes(lanes: DataFrame, payload: str) -> DataFrame:
    """A row for each query and item with its rank in every lane, and conflict where lanes disagree on its ``payload``."""
    return lanes.groupBy("query_id", "doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("lane", "rank")))).alias("ranks"), (F.count_distinct(payload) > 1).alias("conflict")
    )


def capped(hits: DataFrame, group: str, cap: int, top: int) -> DataFrame:
    """The first ``cap`` of each group in rank order, then the first ``top`` of those."""
    kept = hits.withColumn("turn", F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))).where(F.col("turn") <= cap)
    return kept.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("final_rank") <= top).drop("turn")


def interleaved(first: DataFrame, second: DataFrame, top: int) -> DataFrame:
    """A1, B1, A2, B2 and so on; an item stays where it comes first."""
    both = first.select("query_id", "doc_id", "rank", F.lit(0).alias("lane")).unionByName(second.select("query_id", "doc_id", "rank", F.lit(1).alias("lane")))
    return _merged(both, "rank", "lane", top)


def merged(first: DataFrame, second: DataFrame, top: int) -> DataFrame:
    """All of the first list, then the second's others."""
    both = first.select("query_id", "doc_id", "rank", F.lit(0).alias("lane")).unionByName(second.select("query_id", "doc_id", "rank", F.lit(1).alias("lane")))
    return _merged(both, "lane", "rank", top)


def _merged(both: DataFrame, one: str, two: str, top: int) -> DataFrame:
    places = both.groupBy("query_id", "doc_id").agg(F.min(F.struct(one, two)).alias("place"))
    return places.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("rank") <= top).select("query_id", "doc_id", "rank")


def neighbours(seeds: DataFrame, rows: DataFrame, doc: str, number: str) -> DataFrame:
    """Rows of the same document numbered one less, the same or one more than a seed, once, at the first seed's place."""
    near = seeds.select("seed_rank", F.col(doc).alias("d"), F.explode(F.array(F.col(number) - 1, F.col(number), F.col(number) + 1)).alias("n")).where(F.col("n") >= 1)
    return near.groupBy("d", "n").agg(F.min("seed_rank").alias("seed_rank")).join(rows, (F.col("d") == F.col(doc)) & (F.col("n") == F.col(number))).select("seed_rank", doc, number)


def within_budget(items: Column, budget: int, least: float, cap: int, most: int) -> Column:
    """Choice from sorted structs (score, group, tokens, id): those too weak or not finite, over their group's cap or over what is left of the budget are passed over, until ``most`` are held."""
    none = F.array().cast("array<struct<group:string,id:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("used"), none.alias("held"))

    def step(state: Column, x: Column) -> Column:
        same = F.size(F.filter(state["held"], lambda h: h["group"] == x["group"]))
        fits = (x["score"] >= least) & ~F.isnan(x["score"]) & (x["score"] < float("inf")) & (same < cap) & (state["used"] + x["tokens"] <= budget) & (F.size(state["held"]) < most)
        taken = F.struct((state["used"] + x["tokens"]).alias("used"), F.concat(state["held"], F.array(F.struct(x["group"].alias("group"), x["id"].alias("id")))).alias("held"))
        return F.when(fits, taken).otherwise(state)

    return F.aggregate(items, start, step)


def postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, tf and len (words of the title); null and empty texts have none."""
    words = docs.select("doc_id", T.words(F.col("text")).alias("terms")).withColumn("len", F.size("terms"))
    return words.select("doc_id", "len", F.explode("terms").alias("term")).groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row: n_docs and n_terms, documents without terms counted."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.size(T.words(F.col("text")))), F.lit(0)).cast("long").alias("n_terms"))


def title_queries(queries: DataFrame) -> DataFrame:
    """query_id and term of what a title index is asked for."""
    return queries.select("query_id", F.explode(T.title_terms(F.col("text"))).alias("term"))


def bm25(queries: DataFrame, docs: DataFrame, top: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Okapi BM25 over terms, inverse frequency ln((N - df + 0.5) / (df + 0.5)) of at least 0.000001."""
    asked = title_queries(queries)
    wanted = postings(docs).join(bounded(asked.select("term").distinct()), "term", "left_semi")
    return bm25_over(asked, wanted, corpus_size(docs), top, k1, b)


def bm25_over(asked: DataFrame, wanted: DataFrame, size: DataFrame, top: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of ``asked`` (query_id, term) over all postings of its terms and the corpus size. Ties go to the smaller doc_id.

    Documents with the same postings score alike, and so do queries with the same terms: only one of each class is scored,
    and a class gives its ``top`` smallest doc_ids. The first ``top`` classes of a query, by score and smallest doc_id, hold
    its first ``top`` documents.
    """
    entry = F.struct("term", "tf", "len")
    documents = written(wanted.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("profile")), "profiles")
    classes = written(documents.groupBy("profile").agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("n")), "classes")
    first = ranked(documents, top, F.asc("doc_id"), by="profile")
    members = written(first.select("doc_id", F.min("doc_id").over(Window.partitionBy("profile")).alias("class")), "members")
    # dealt by class alone: its scores are made where its entries are
    entries = classes.repartition("class").select("class", "n", F.inline("profile"))
    df = written(entries.groupBy("term").agg(F.sum("n").alias("df")), "df")
    alike = written(asked.join(bounded(df.select("term")), "term").groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("terms")), "asked")
    kinds = alike.groupBy("terms").agg(F.min("query_id").alias("kind"))
    stats = size.select("n_docs", F.try_divide("n_terms", "n_docs").alias("avg_len"))
    hits = entries.join(bounded(kinds.select("kind", F.explode("terms").alias("term"))), "term").join(bounded(df), "term").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scores = hits.groupBy("class", "kind").agg(F.round(F.sum(weight), 6).alias("score"))
    best = ranked(scores, top, F.desc("score"), F.asc("class"), by="kind").drop("rank")
    found = written(ranked(best.join(members, "class"), top, F.desc("score"), F.asc("doc_id"), by="kind"), "found")
    of_kind = alike.join(kinds, "terms").select("query_id", "kind")
    return of_kind.join(bounded(found), "kind").select("query_id", "doc_id", "score", "rank")


def numbers_first(queries: DataFrame, docs: DataFrame, titles: DataFrame, top: int) -> DataFrame:
    """Documents whose number a query names, by place of the number and doc_id, then title hits; each once, ``top`` in all.

    ``docs``: doc_id, number. ``titles``: query_id, doc_id, rank of the first 2 * ``top``.
    """
    named = queries.select("query_id", F.posexplode(T.document_numbers(F.col("text"))).alias("place", "number"))
    exact = docs.select("doc_id", T.document_number(F.col("number")).alias("number")).join(bounded(named), "number")
    both = exact.select("query_id", "doc_id", F.struct(F.lit(0).alias("tier"), F.col("place").cast("long").alias("a"), F.col("doc_id").cast("long").alias("b")).alias("order"))
    hits = titles.where(F.col("rank") <= 2 * top).select("query_id", "doc_id", F.struct(F.lit(1).alias("tier"), F.col("rank").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("order"))
    places = both.unionByName(hits).groupBy("query_id", "doc_id").agg(F.min("order").alias("order"))
    return ranked(places, top, F.asc("order")).select("query_id", "doc_id", "rank", (F.col("order.tier") == 0).alias("by_number"))


def intent_score(query: Column, text: Column, intents: dict[str, tuple[tuple[str, ...], tuple[str, ...]]], bonus: float = 4.0) -> Column:
    """``bonus`` for each intent with a keyword in the query and one in the text."""
    has = lambda c, words: F.greatest(*(F.contains(c, F.lit(w)) for w in words), F.lit(False))
    q, t = F.lower(query), F.lower(T.clean(text))
    return sum((F.when(has(q, asked) & has(t, told), bonus).otherwise(0.0) for asked, told in intents.values()), F.lit(0.0))


def passage_score(query: Column, text: Column, intents: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] | None = None) -> Column:
    """1 + ln of how often a passage holds each distinct term of the query as a substring, 8 for the whole query, 4 for each intent of both; six digits."""
    phrase, body = F.lower(T.clean(query)), F.lower(T.clean(text))
    wanted = F.array_distinct(F.transform(T.query_terms(query), lambda x: F.replace(x, F.lit("_"), F.lit(" "))))
    times = lambda t, x: (F.length(t) - F.length(F.replace(t, x, F.lit("")))) / F.length(x)
    counted = T.bound(body, lambda t: F.aggregate(F.transform(wanted, lambda x: times(t, x)), F.lit(0.0), lambda s, n: s + F.when(n > 0, 1 + F.log(n)).otherwise(0.0)))
    whole = F.when((phrase != "") & F.contains(body, phrase), 8.0).otherwise(0.0)
    return F.round(counted + whole + intent_score(query, text, intents or INTENTS), 6)


#: Keywords of the query and of the text by intent.
INTENTS = {
    "definition": (("định nghĩa", "là gì", "hiểu như thế nào", "khái niệm"), ("là", "được hiểu là", "gồm", "nghĩa là")),
    "penalty": (("xử phạt", "phạt tiền", "tội", "mức phạt", "phạt bao nhiêu", "bồi thường"), ("phạt", "tội", "tước", "phạt tiền", "bồi thường", "bị phạt")),
    "deadline": (("thời hạn", "thời hiệu", "bao lâu", "ngày", "tháng", "khi nào"), ("thời hạn", "ngày", "tháng", "năm", "thời hiệu", "thời gian")),
    "authority": (("cơ quan", "thẩm quyền", "ai có quyền", "bộ", "ủy ban", "đơn vị"), ("thẩm quyền", "cơ quan", "bộ", "ủy ban", "thủ tướng", "chủ tịch")),
    "responsibility": (("trách nhiệm", "nghĩa vụ", "bắt buộc", "phải"), ("trách nhiệm", "nghĩa vụ", "bắt buộc", "phải", "có nghĩa vụ")),
    "condition": (("điều kiện", "đối tượng", "được phép", "tiêu chuẩn", "quy chuẩn"), ("điều kiện", "đối tượng", "tiêu chuẩn", "quy chuẩn", "yêu cầu")),
    "exception": (("trừ trường hợp", "ngoại lệ", "không áp dụng", "loại trừ"), ("trừ", "ngoại lệ", "không áp dụng", "loại trừ")),
}


def saturation_weights(docs: DataFrame, average: float, most: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``most`` heaviest terms of each document under BM25 saturation without inverse frequency."""
    words = docs.select("doc_id", T.terms(F.col("text")).alias("terms")).withColumn("len", F.greatest(F.size("terms"), F.lit(1)))
    tf = words.select("doc_id", "len", F.explode("terms").alias("term")).groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / max(1.0, average)))
    return ranked(tf.select("doc_id", "term", F.round(weight, 6).alias("weight")), most, F.desc("weight"), F.asc("term"), by="doc_id").drop("rank")
