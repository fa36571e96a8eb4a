"""Resumable ingestion and rate limits over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, files_per_batch: int = 4, after: Callable[[int], None] = lambda number: None) -> StreamingQuery:
    """Appends new files below ``source`` to the Parquet table ``target``, each key once.

    A batch that was replayed writes its own folder again, so a restart neither loses nor doubles rows. Keys are held with
    a hash of their row in folders by bucket of the key, and a batch reads the buckets that it has keys of; a key that
    comes again with another row raises, as does one that a batch has twice with different rows. Null keys are one key.
    ``after`` is called with a batch's number when its rows are written and before the stream knows of it.
    """
    buckets = 64
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def commit(batch: DataFrame, number: int) -> None:
        digest = F.sha2(F.to_json(F.struct(*sorted(batch.columns)), {"ignoreNullFields": "false"}), 256)
        rows = batch.select("*", digest.alias("_digest"), bucket.alias("_bucket")).dropDuplicates([key, "_digest"]).persist()
        known = rows.select(key, "_digest", "_bucket")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/keys")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most the number of buckets
            held = spark.read.schema(known.schema.add("batch", "long")).parquet(f"{target}/keys").where(F.col("_bucket").isin(touched) & (F.col("batch") != number))
            held = held.select(F.col(key).alias("_key"), F.col("_digest").alias("_held"))
            seen = rows.join(held, F.col(key).eqNullSafe(F.col("_key")), "left")
            clash = seen.where(F.col("_held").isNotNull() & (F.col("_held") != F.col("_digest")))
            if not clash.isEmpty():
                raise ValueError(f"batch {number} has a key that was committed with another row")
            rows_new = seen.where(F.col("_held").isNull()).drop("_key", "_held")
        else:
            rows_new = rows
        if not rows.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"batch {number} has a key with different rows")
        rows_new.select(key, "_digest", F.lit(number).cast("long").alias("batch"), "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "batch").parquet(f"{target}/keys")
        rows_new.drop("_digest", "_bucket").write.mode("overwrite").parquet(f"{target}/batch={number}")
        rows.unpersist()
        after(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """All rows that ``ingest`` has written below ``target``."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{target}/batch=*")


def rate_limited(events: DataFrame, width: str, most: int, late: str = "10 minutes") -> DataFrame:
    """Windows in which a user of the stream has more than ``most`` events; closed once ``late`` has passed."""
    counts = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > most).select("user_id", F.col("w.start").alias("start"), "n")
