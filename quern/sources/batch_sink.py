"""A batch sink for records with ids: a store of Parquet files that grows by whole batches, each written once.

Every task writes its own new file and reports it; the driver then commits all of them by one manifest, named by the batch's
key and a digest of its rows. Files that no manifest names (of tasks or jobs that died, of repeated batches) are never read.
A batch that comes again with equal rows changes nothing, one with other rows under the same key raises. Readers get the
latest batch's row of each id. The store may be on any file system that pyarrow opens (file, hdfs, s3).

Null ids are refused, as are ids that a batch has twice; empty batches are committed as such.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quern.operators.ranking import together

FORMAT = "quern_batches"
DIGEST = "_digest"


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if ":" in path else (arrow_fs.LocalFileSystem(), path)


@dataclass
class Wrote(WriterCommitMessage):
    """What one task has written."""

    file: str
    n: int
    total: int


class BatchSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"], self.options["key"])


class BatchWriter(DataSourceArrowWriter):
    """Writes one file a task; rows carry a digest that is summed and not stored."""

    def __init__(self, path: str, key: str):
        self.path, self.key = path.rstrip("/"), quote(key, safe="")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        files, root = opened(self.path)
        name, n, total, out = f"data/{self.key}-{uuid.uuid4().hex}.parquet", 0, 0, None
        for batch in iterator:
            at = batch.schema.get_field_index(DIGEST)
            total += sum(int(d[:15], 16) for d in batch.column(at).to_pylist())
            n += batch.num_rows
            rows = pa.Table.from_batches([batch]).remove_column(at)
            if out is None:
                files.create_dir(f"{root}/data")
                out = pq.ParquetWriter(f"{root}/{name}", rows.schema, filesystem=files, compression="zstd")
            out.write_table(rows)
        if out is not None:
            out.close()
        return Wrote(name if n else "", n, total)

    def commit(self, messages: list[Wrote]) -> None:
        files, root = opened(self.path)
        wrote = [m for m in messages if m is not None and m.file]
        n, total = sum(m.n for m in wrote), sum(m.total for m in wrote)
        digest = f"{n:x}.{total:x}"
        held = [m for m in manifests(self.path) if m["key"] == self.key]
        if held:
            self.abort(messages)
            if held[0]["digest"] != digest:
                raise ValueError(f"batch {self.key} is committed with other rows")
            return
        number = max((m["number"] for m in manifests(self.path)), default=-1) + 1
        files.create_dir(f"{root}/batches")
        made, final = f"{root}/batches/_{uuid.uuid4().hex}", f"{root}/batches/{self.key}~{digest}.json"
        with files.open_output_stream(made) as out:
            out.write(json.dumps({"key": self.key, "digest": digest, "number": number, "n": n, "files": sorted(m.file for m in wrote)}).encode())
        files.move(made, final)

    def abort(self, messages: list[Wrote]) -> None:
        files, root = opened(self.path)
        for m in messages:
            if m is not None and m.file:
                files.delete_file(f"{root}/{m.file}")


def manifests(path: str) -> list[dict]:
    """Committed batches, oldest first."""
    files, root = opened(path.rstrip("/"))
    found = []
    for info in files.get_file_info(arrow_fs.FileSelector(f"{root}/batches", allow_not_found=True)):
        if info.base_name.endswith(".json"):
            with files.open_input_stream(info.path) as held:
                found.append(json.loads(held.readall()))
    return sorted(found, key=lambda m: (m["number"], m["key"]))


def upsert(rows: DataFrame, path: str, key: str, id_column: str = "id") -> None:
    """Commits ``rows`` as the batch ``key``; may be called again with the same rows after any failure."""
    spark = rows.sparkSession
    odd = rows.groupBy(id_column).count().where(F.col(id_column).isNull() | (F.col("count") > 1))
    if not odd.isEmpty():
        raise ValueError(f"batch {key} has ids that are null or repeated")
    spark.dataSource.register(BatchSink)
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    rows.withColumn(DIGEST, digest).write.format(FORMAT).option("path", path).option("key", key).mode("append").save()


def stored(spark: SparkSession, path: str, schema: StructType, id_column: str = "id") -> DataFrame:
    """The latest row of each id, under the schema of the rows that were written."""
    parts = [
        spark.read.schema(schema).parquet(*(f"{path.rstrip('/')}/{f}" for f in m["files"])).withColumn("_number", F.lit(m["number"]))
        for m in manifests(path)
        if m["files"]
    ]
    if not parts:
        return spark.createDataFrame([], schema)
    newest = together(parts).groupBy(F.col(id_column).alias("_id")).agg(F.max_by(F.struct(*schema.names), "_number").alias("_row"))
    return newest.select("_row.*")
