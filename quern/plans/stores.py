"""Queries over what the engine stores: published versions, the batch sink, the vector index, corpus identities."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import vector_index
from quern.plans.evaluation import query
from quern.plans.oracles import VECTORS
from quern.sources import batch_sink, publication, records
from quern.sources.scratch import shared_dir, written
from quern.sources.tables import table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"


@query("""SELECT count(*) AS n, sum(doc_id)::BIGINT AS ids, 'created' AS first, 'reused' AS again, 'created' AS second, 'artifact_collision' AS other,
'1' AS current_version, 'created' AS artifact, 'reused' AS artifact_again, 'artifact_collision' AS artifact_other FROM documents""")
def published_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents' records published, again, in part as a second version, with other rows as the first; then back to the first."""
    folder, docs = _folder(spark, "published"), table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")

    def status(rows: DataFrame, version: str) -> str:
        try:
            return publication.publish(rows, folder, version, by=("lang",))
        except publication.Collision as error:
            return error.status

    first, again = status(docs, "1"), status(docs.repartition(3), "1")
    second, other = status(docs.where("doc_id % 2 = 0"), "2"), status(docs.where("doc_id % 2 = 0"), "1")
    publication.point(spark, folder, "1")
    held = publication.current(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))

    def artifact(data: object) -> str:
        try:
            return publication.write_artifact(spark, f"{folder}-report/manifest.json", data)
        except publication.Collision as error:
            return error.status

    counts = held.first().asDict()
    states = {"first": first, "again": again, "second": second, "other": other, "current_version": publication.current_version(spark, folder)}
    states |= {"artifact": artifact(counts), "artifact_again": artifact(dict(reversed(counts.items()))), "artifact_other": artifact(counts | {"n": -1})}
    return held.select("n", "ids", *(F.lit(v).alias(k) for k, v in states.items()))


@query("""SELECT vec_id::VARCHAR AS id, len(embedding)::INT AS dimension, CASE WHEN label % 2 = 0 THEN 'second' ELSE 'first' END AS batch, '' AS faults FROM embeddings""")
def batch_sink_records(spark: SparkSession, d: str) -> DataFrame:
    """Vector records committed as a batch, the same batch again, and a batch that replaces those of even labels."""
    path = _folder(spark, "sink")
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", "label", F.array(F.col("label").cast("long")).alias("term_ids"), F.array(F.lit(1.0)).alias("weights"))
    made = lambda name, r: records.vector_records(r.withColumn("batch", F.lit(name)), "vec_id", 64)
    batch_sink.upsert(made("first", rows), path, "1")
    batch_sink.upsert(made("first", rows.repartition(2)), path, "1")
    second = made("second", rows.where("label % 2 = 0"))
    batch_sink.upsert(second, path, "2")
    kept = batch_sink.stored(spark, path, second.schema)
    faults = records.sink_faults(kept, table(spark, d, "embeddings").count(), 64)
    return kept.select("id", F.size("values").alias("dimension"), F.col("metadata")["batch"].alias("batch"), F.lit("; ".join(faults)).alias("faults"))


def _index(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    folder, rows = _folder(spark, "vectors"), table(spark, d, "embeddings")
    vector_index.build(rows, folder, "1")
    return folder, rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")


@query(f"WITH {VECTORS} SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10")
def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The index with every cell asked, which is the exact result."""
    folder, asked = _index(spark, d)
    return vector_index.search(spark, folder, asked, 10, vector_index.ALL)


@query("SELECT count(*) AS queries, 10 AS k, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the probed index finds at least nine tenths of the exact ten nearest rows, over all queries together."""
    folder, asked = _index(spark, d)
    exact = written(vector_index.search(spark, folder, asked, 10, vector_index.ALL), "exact")
    found = vector_index.search(spark, folder, asked, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    recall = F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))
    return exact.join(found, ["query_id", "vec_id"], "left").agg(F.count_distinct("query_id").alias("queries"), F.lit(10).alias("k"), (recall >= 0.9).alias("reached"))
