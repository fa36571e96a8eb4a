"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet
and read again. All but the last return the columns of documents, and further columns of any name unchanged.

Rows are told apart by doc_id and text, nulls included. Null and empty texts fail the quality rules; given to a later
stage alone they stay as they are, and packing gives them the end id. Of rows that repeat doc_id and text the
near-duplicate stage keeps one where they have words. Ties go to the smallest doc_id. Very long texts are worked on
whole. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import contamination, minhash, packing, pii, rules
from quern.llm.queries import tokenizer
from quern.sources.scratch import written
from quern.sources.tables import table

#: Rows of keys in one broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows of those doc_ids and hashes of texts."""
    keys = written(keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "dropped")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return _matching(docs, keys, "left_anti")


def _matching(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to ``_id`` and ``_hash`` of ``keys``; held as one column, so that no names can clash."""
    held = docs.select(F.struct("*").alias("_doc"))
    return held.join(keys, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_doc.text") == F.col("_hash")), how).select("_doc.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: runs of five words, similarity of 0.8 or more.

    Rows that repeat a kept row wholly are dropped too.
    """
    found = written(minhash.near_duplicates(docs, shingle=5, percent=80), "near")
    gone = found.where(~F.col("kept")).select("doc_id", "text_hash")
    stays = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    kept = _without(docs, gone.join(stays, same, "left_anti"))
    twice = written(stays.join(gone, same, "left_semi").distinct(), "repeated")
    n = twice.count()
    if not n:
        return kept
    twice = F.broadcast(twice) if n <= BROADCAST_KEYS else twice
    return _matching(kept, twice, "left_anti").unionByName(_matching(kept, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are in windows of the benchmark."""
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    found = contamination.contamination(keyed, table(spark, sf_dir, "benchmark"), keep=("doc_id", "text_hash"))
    bad = found.where(contamination.is_contaminated(contamination.hit_words(F.col("hits")), F.col("n_words")))
    return _without(docs, bad)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    found = pii.personal_data(docs.select(F.struct("*").alias("_doc"), "text"), keep=("_doc",))
    masked = pii.redacted(F.col("_doc.text"), F.col("spans"))
    doc = F.col("_doc").withField("text", masked)
    counted = F.when(F.size("spans") > 0, F.length(masked).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_doc.n_chars"))
    return found.select(doc.withField("n_chars", counted).alias("_doc")).select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences in windows of 2048."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=1, window=2048, with_ids=False)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("packing", pack)]

#: Packing and discovered contexts are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
