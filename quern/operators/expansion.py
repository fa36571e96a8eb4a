"""Lanes fused under one payload a record, and their records widened by neighbouring articles.

A query whose lanes disagree on a record's payload, or whose neighbours are more than may be read, fails as a whole: it gets
one row that tells why, and no records. Null articles have no neighbours. Repeated rows of a lane count at their first rank.
Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import ranking

#: Fixed value: the word before an article's number.
ARTICLE = "Điều"


def checked_fusion(lanes: DataFrame, payload: str) -> DataFrame:
    """query_id, record_id, score, rank and verdict of ``lanes`` (query_id, lane, rank, record_id and a payload column).

    ``conflict``: the query has a record with two payloads; its one row has no record.
    """
    records = lanes.groupBy("query_id", "record_id").agg((F.min(payload).eqNullSafe(F.max(payload)) & (F.count(payload).isin(0) | (F.count(payload) == F.count(F.lit(1))))).alias("same"))
    verdicts = records.groupBy("query_id").agg(F.when(F.bool_and("same"), "ok").otherwise("conflict").alias("verdict"))
    fused = ranking.fused(lanes.select("query_id", "lane", "rank", F.col("record_id").alias("doc_id"))).withColumnRenamed("doc_id", "record_id")
    rows = verdicts.join(fused, "query_id").where(F.col("verdict") == "ok").select("query_id", "record_id", "score", "rank", "verdict")
    return rows.unionByName(_failed(verdicts, rows))


def _failed(verdicts: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each query that failed, null but for its verdict."""
    held = verdicts.where(F.col("verdict") != "ok")
    return held.select(*(F.col(f.name) if f.name in ("query_id", "verdict") else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields))


def near_articles(article: Column, word: str = ARTICLE) -> Column:
    """An article, the one numbered before it (from 2 on) and the one after; only itself where it isn't ``word`` and a number."""
    n = F.regexp_extract(F.trim(article), rf"(?iu)^{word}\s+([0-9]+)(?![\p{{L}}\p{{N}}_])", 1)
    number = F.when(n != "", n.cast("long"))
    named = lambda k: F.concat(F.lit(f"{word} "), k.cast("string"))
    return F.array_distinct(F.array_compact(F.array(article, F.when(number > 1, named(number - 1)), named(number + 1))))


def expanded(seeds: DataFrame, records: DataFrame, limit: int, word: str = ARTICLE) -> DataFrame:
    """query_id, record_id, place and verdict: each seed, then the records of its article and those beside it, once each.

    ``seeds``: query_id, rank, record_id, document_id, article. ``records``: record_id, document_id, article, seq. After a
    seed its articles come in the order of their text, and the records of an article by seq, then id; a record stays at
    its first place in the whole list. ``overflow``: the records to read for all seeds of the query are more than ``limit``.
    """
    wanted = seeds.where(F.col("article").isNotNull()).select("query_id", "rank", "document_id", F.explode(near_articles(F.col("article"), word)).alias("article"))
    needed = wanted.select("query_id", "document_id", "article").distinct()
    sizes = records.groupBy("document_id", "article").agg(F.count_distinct("record_id").alias("n"))
    reads = needed.join(sizes, ["document_id", "article"]).groupBy("query_id").agg(F.sum("n").alias("reads"))
    verdicts = seeds.select("query_id").distinct().join(reads, "query_id", "left").select("query_id", F.when(F.col("reads") > limit, "overflow").otherwise("ok").alias("verdict"))
    fine = verdicts.where(F.col("verdict") == "ok")
    found = wanted.join(fine, "query_id", "left_semi").join(records, ["document_id", "article"])
    at = lambda *parts: F.struct(*(p.alias(n) for p, n in zip(parts, ("rank", "kind", "article", "seq"), strict=True))).alias("at")
    near = found.select("query_id", "record_id", at(F.col("rank"), F.lit(1), F.col("article"), F.col("seq").cast("long")))
    own = seeds.join(fine, "query_id", "left_semi").select("query_id", "record_id", at(F.col("rank"), F.lit(0), F.lit(""), F.lit(0).cast("long")))
    first = own.unionByName(near).groupBy("query_id", "record_id").agg(F.min("at").alias("at"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "record_id")))
    rows = placed.select("query_id", "record_id", "place", F.lit("ok").alias("verdict"))
    return rows.unionByName(_failed(verdicts, rows))
