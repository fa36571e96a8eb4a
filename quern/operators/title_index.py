"""A title index kept as postings in a folder, built in runs that a later session can resume.

Each run covers a range of doc_ids and is written once; a build that broke off goes on with the runs that have not ended.
Then all runs are spread by ranges of (bucket, term, doc_id), so that a frequent term is split, and published as a
version in folders of buckets: a search opens those of its own terms alone. Readers keep the old version meanwhile.

A revision names one state of the documents. Rows without a doc_id are not indexed. Null and empty titles count as
documents without terms; very long ones are indexed whole; repeated doc_ids count each time. An empty table publishes
an empty index. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import ranking
from quern.sources import publication, records

#: Buckets at least and at most, and words of titles for each between them.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_WORDS = 64, 4_096, 4_000_000
#: Doc_ids in the range of a run, and runs at most: where ids are spread more widely, ranges are widened fourfold until they fit.
WIDTH, MOST_RUNS = 10_000_000, 10_000
POSTINGS = "term string, doc_id long, tf long, len int"
SIZE = "n_docs long, n_terms long"


def bucket(term: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(term), buckets).cast("int")


def build(docs: DataFrame, folder: str, revision: str, width: int = WIDTH) -> int:
    """Indexes ``docs`` (doc_id, text) and publishes the index as ``revision``; gives the number of runs written by this call."""
    spark, made = docs.sparkSession, 0
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    while True:
        floor = F.expr(f"cast((doc_id - pmod(doc_id, {width})) div {width} as long)")
        ranges = sorted(r[0] for r in rows.select(floor).distinct().limit(MOST_RUNS + 1).collect())
        if len(ranges) <= MOST_RUNS:
            break
        width *= 4
    runs = [f"{folder}/building={revision}/run={k}" for k in ranges]
    for k, run in zip(ranges, runs, strict=True):
        part = rows.where(F.col("doc_id").between(k * width, (k + 1) * width - 1))
        for name, found in (("postings", ranking.postings(part).select("term", "doc_id", "tf", "len")), ("size", ranking.corpus_size(part))):
            if not records.complete(spark, f"{run}/{name}"):
                found.write.mode("overwrite").parquet(f"{run}/{name}")
                made += name == "size"
    if publication.published(spark, folder, revision):
        publication.point(spark, folder, revision)
        return made
    read = lambda name, schema: spark.read.schema(schema).parquet(*(f"{r}/{name}" for r in runs)) if runs else spark.createDataFrame([], schema)
    total = read("size", SIZE).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_terms")))
    words = total.first().n_terms
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (words // BUCKET_WORDS).bit_length()))
    total.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{folder}/size={revision}")
    whole = read("postings", POSTINGS).withColumn("bucket", bucket(F.col("term"), F.lit(buckets)))
    spread = whole.repartitionByRange("bucket", "term", "doc_id").sortWithinPartitions("bucket", "term", "doc_id")
    publication.publish(spread, folder, revision, by=("bucket",))
    return made


def search(spark: SparkSession, folder: str, queries: DataFrame, top: int) -> DataFrame:
    """BM25 of ``queries`` (query_id, text) over the published index: query_id, doc_id, score, rank."""
    revision = publication.current_version(spark, folder)
    index = spark.read.schema(f"{POSTINGS}, bucket int").parquet(publication.current_path(spark, folder))
    size = spark.read.schema(f"{SIZE}, buckets int").parquet(f"{folder}/size={revision}")
    asked = ranking.title_queries(queries)
    terms = ranking.bounded(asked.select("term", bucket(F.col("term"), F.lit(size.first().buckets)).alias("bucket")).distinct())
    wanted = index.join(terms, ["bucket", "term"], "left_semi").select("term", "doc_id", "tf", "len")
    return ranking.bm25_over(asked, wanted, size.drop("buckets"), top)
