"""Corpus checks: flags, integrity, duplicates, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources.scratch import written

#: The vocabulary of flags.
FLAGS = ("abnormal_length", "duplicate_content_hash", "empty_content", "encoding_damage", "invalid_issuance_date", "missing_document_number", "missing_source_url", "missing_title")
SHORT, LONG = 20, 20_000_000


def content_hash(c: Column) -> Column:
    return F.sha2(T.normalized(c), 256)


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, content_sha256 and quality_flags (sorted, distinct) of each document.

    Copies are found by a count for each hash that is joined back, so that no copy group meets in one task.
    """
    body = T.normalized(F.col("text"))
    base = docs.select("doc_id", "source", F.length(body).alias("size"), F.sha2(body, 256).alias("content_sha256"), body.rlike(T.MOJIBAKE).alias("damaged"))
    base = written(base, "hashed")  # hashed once for the count and for what it is joined to
    copies = base.groupBy("content_sha256").agg((F.count(F.lit(1)) > 1).alias("copied"))
    flag = lambda when, name: F.when(when, F.lit(name))
    flags = F.array(
        flag((F.col("size") > 0) & ((F.col("size") < SHORT) | (F.col("size") > LONG)), "abnormal_length"),
        flag(F.col("copied"), "duplicate_content_hash"),
        flag(F.col("size") == 0, "empty_content"),
        flag(F.col("damaged"), "encoding_damage"),
        flag(F.coalesce(F.trim("source"), F.lit("")) == "", "missing_source_url"),
    )
    return base.join(copies, "content_sha256").select("doc_id", "content_sha256", "size", F.array_sort(F.array_compact(flags)).alias("quality_flags"))


def flag_histogram(flags: DataFrame) -> DataFrame:
    """flag and n for every flag of the vocabulary, 0 where none has it."""
    counts = flags.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("k"))
    vocabulary = flags.sparkSession.createDataFrame([(x,) for x in FLAGS], "flag string")
    return vocabulary.join(counts, "flag", "left").select("flag", F.coalesce("k", F.lit(0)).alias("n"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """content_sha256, n and first_doc_id of contents that occur twice or more."""
    return docs.groupBy(content_hash(F.col("text")).alias("content_sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc_id")).where("n > 1")


def build_report(docs: DataFrame, stride: int = 128) -> DataFrame:
    """Counts, bytes and mean terms over a systematic calibration sample, in one pass."""
    body = T.normalized(F.col("text"))
    sampled = F.when(F.col("doc_id") % stride == 0, F.size(T.terms(F.col("text"))))
    return docs.select("doc_id", F.octet_length(body).alias("bytes"), F.length(body).alias("size"), sampled.alias("k")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("bytes").alias("content_bytes"),
        F.count_if(F.col("size") == 0).alias("n_empty"),
        F.round(F.avg("k"), 6).alias("mean_terms"),
    )


def integrity(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """side and key of rows without a partner, both ways."""
    missing = left.select(F.col(key).alias("key")).join(right.select(F.col(other).alias("key")), "key", "left_anti").distinct()
    unused = right.select(F.col(other).alias("key")).join(left.select(F.col(key).alias("key")), "key", "left_anti").distinct()
    return missing.withColumn("side", F.lit("left_only")).unionByName(unused.withColumn("side", F.lit("right_only")))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of keys on either side and on both, by a full outer join."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both_sides")
    )
