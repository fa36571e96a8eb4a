"""Records of a corpus: checked reads, JSON tables and manifests.

Null values are kept apart from empty ones unless said otherwise; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T


def issued(c: Column) -> tuple[Column, Column]:
    """A date written day first or year first, and whether a text that is not empty is neither."""
    raw = T.clean(c)
    date = F.coalesce(F.try_to_date(raw, "dd/MM/yyyy"), F.try_to_date(raw, "yyyy-MM-dd"))
    return date, (raw != "") & date.isNull()


def metadata_flags(number: Column, title: Column, url: Column, date: Column) -> Column:
    """Sorted flags of what a metadata row lacks."""
    lacks = lambda c, name: F.when(T.clean(c) == "", name)
    return F.array_sort(F.array_compact(F.array(lacks(number, "missing_document_number"), lacks(title, "missing_title"), lacks(url, "missing_source_url"), F.when(issued(date)[1], "invalid_issuance_date"))))


def flag_union(a: Column, b: Column) -> Column:
    """Sorted, distinct flags of both arrays."""
    return F.array_sort(F.array_union(a, b))


def sharded(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with the shard (file name) and row position they come from."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("position"))


def single_shard(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet rows under a schema; raises where the folder has not exactly one file."""
    rows = spark.read.schema(schema).parquet(path)
    files = rows.inputFiles()
    if len(files) != 1:
        raise ValueError(f"one shard is expected, there are {len(files)}")
    return rows


def fetched(rows: DataFrame, keys: DataFrame, key: str, body: str, digest: str) -> DataFrame:
    """Rows of the asked keys, with intact: whether the body has the hash that was stored with it."""
    found = rows.join(keys.select(key).distinct(), key, "left_semi")
    return found.withColumn("intact", F.sha2(F.coalesce(F.col(body), F.lit("")), 256) == F.col(digest))


def cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects, in one file or several, under a schema; broken files raise."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def sidecar(spark: SparkSession, path: str, label: str, version: int) -> DataFrame:
    """The labels of a sidecar document (schema_version, total_evidence_items, labels); raises where it breaks its contract.

    The contract: this version, as many labels as announced, an id for each and none twice. ``label`` is the schema of one.
    """
    schema = f"schema_version int, total_cases int, total_evidence_items int, labels array<struct<{label}>>"
    labels = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    head = labels.select("schema_version", "total_cases", "total_evidence_items", F.size("labels").alias("n")).collect()  # one document
    if len(head) != 1 or head[0].schema_version != version:
        raise ValueError("unknown version of the sidecar")
    rows = labels.select(F.inline("labels"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("evidence_id").alias("ids"), F.count_distinct("case_id").alias("cases")).first()
    if not seen.n == seen.ids == head[0].total_evidence_items or seen.cases != head[0].total_cases:
        raise ValueError("the sidecar's labels are not those it announces")
    return rows


def log_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a log; broken lines and missing fields are null rather than failures."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def canonical(*columns: str) -> Column:
    """A row's JSON with sorted keys and explicit nulls, so that equal rows have equal text."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def manifest(docs: DataFrame, group: str, body: str) -> DataFrame:
    """Counts and bytes by group."""
    return docs.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce(F.col(body), F.lit("")))).alias("bytes"))


def vector_records(rows: DataFrame, key: str, dimension: int) -> DataFrame:
    """id, values, sparse and metadata of records without nulls in metadata; ``fits`` says whether the vector has its dimension.

    ``rows``: the key, embedding, term_ids, weights and further columns, which become metadata.
    """
    others = [c for c in rows.columns if c not in (key, "embedding", "term_ids", "weights")]
    metadata = F.map_filter(F.create_map(*(x for c in others for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull())
    return rows.select(
        F.col(key).cast("string").alias("id"), F.col("embedding").alias("values"), F.struct("term_ids", "weights").alias("sparse"), metadata.alias("metadata"), (F.size("embedding") == dimension).alias("fits")
    )


def sink_faults(made: DataFrame, expected: int, dimension: int) -> list[str]:
    """What keeps a written table of records from being ready."""
    seen = made.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.coalesce(F.size("values"), F.lit(-1)) != dimension).alias("odd")).first()
    checks = {f"{seen.n} rows, {expected} are expected": seen.n != expected, "repeated ids": seen.ids != seen.n, f"{seen.odd} vectors of another dimension": seen.odd > 0}
    return [what for what, bad in checks.items() if bad]


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)
