"""Tables and small artifacts that are published whole and never changed.

A table's files lie in a folder named by a digest of its rows. A version is a claim on one digest, and the current version
is the last of a row of empty pointer files whose names hold everything: a name is there or not, so a reader that opens the
last one always finds a complete table, whatever writer dies at whatever step. Files staged by a writer that died are never
read. Publishing equal rows again under the same version is ``reused``; other rows raise ``Collision`` and change nothing.

Any file system of Spark. The digest doesn't depend on the order of rows or on partitions; repeated rows and nulls count.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Collision(FileExistsError):
    """Other content is published under this name."""

    status = "artifact_collision"


class Files:
    """The file operations that publication needs, on whatever file system a path is of."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.options = spark.sparkContext._gateway.new_array
        place = self.path(path)
        self.fs = place.getFileSystem(self.conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else self.fs.getUri(), self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def write(self, name: str, content: bytes = b"") -> None:
        out = self.fs.create(self.path(name), True)
        out.write(bytearray(content))
        out.close()

    def read(self, name: str) -> bytes:
        held = self.fs.open(self.path(name))
        try:
            return bytes(held.readAllBytes())
        finally:
            held.close()

    def move(self, source: str, target: str, over: bool = False) -> None:
        """Moves in one step; raises FileExistsError where the target is there, unless ``over`` replaces it."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.options(kind, int(over))
        if over:
            options[0] = kind.OVERWRITE
        try:
            self.context.rename(self.path(source), self.path(target), options)
        except Exception as error:
            if not over and self.exists(target):
                raise FileExistsError(target) from error
            raise


def content_digest(df: DataFrame) -> str:
    """A digest of the rows as a multiset: sums of parts of each row's SHA-256, with the count and the columns."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    lanes = [F.conv(F.substring("row", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)").alias(f"lane{k}") for k in range(4)]
    sums = df.select(row.alias("row")).select(*lanes).agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"lane{k}").alias(f"s{k}") for k in range(4))).first()
    columns = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in sorted(df.schema.fields, key=lambda f: f.name))
    return hashlib.sha256("|".join([columns, *map(str, sums)]).encode()).hexdigest()


def publish(df: DataFrame, folder: str, version: str, by: tuple[str, ...] = (), after: Callable[[str], None] = lambda step: None) -> str:
    """Publishes ``df``, in folders of the columns ``by``, as a version and makes it the current one: ``created`` or ``reused``.

    ``after`` is called when each step has ended: staged, stored, claimed, pointed.
    """
    spark = df.sparkSession
    files = Files(spark, folder)
    staged = f"{folder}/_staging/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(staged)
    after("staged")
    digest = content_digest(spark.read.schema(df.schema).parquet(staged))
    try:
        files.move(staged, f"{folder}/data={digest}")
    except FileExistsError:
        files.delete(staged)
    after("stored")
    status = _claimed(files, folder, version, digest)
    after("claimed")
    point(spark, folder, version)
    after("pointed")
    return status


def _claimed(files: Files, folder: str, version: str, digest: str) -> str:
    claims = f"{folder}/_versions/{quote(version, safe='')}"
    held = files.names(claims)
    if held == [digest]:
        return "reused"
    if not held:
        files.write(f"{claims}/{digest}")
        if files.names(claims) == [digest]:
            return "created"
        files.delete(f"{claims}/{digest}")  # another writer claims it at this moment; neither gets it
    raise Collision(f"version {version} of {folder} is published with other rows")


def published(spark: SparkSession, folder: str, version: str) -> bool:
    """Whether a version has been claimed, and so is complete."""
    return bool(Files(spark, folder).names(f"{folder}/_versions/{quote(version, safe='')}"))


def point(spark: SparkSession, folder: str, version: str) -> None:
    """Makes a published version the current one, in one step."""
    files = Files(spark, folder)
    [digest] = files.names(f"{folder}/_versions/{quote(version, safe='')}")
    pointers = files.names(f"{folder}/_pointers")
    name = f"{quote(version, safe='')}~{digest}"
    if not pointers or pointers[-1].split("~", 1)[1] != name:
        files.write(f"{folder}/_pointers/{int(pointers[-1].split('~')[0]) + 1 if pointers else 0:012d}~{name}")


def version_path(spark: SparkSession, folder: str, version: str) -> str:
    """Where a published version's files lie."""
    [digest] = Files(spark, folder).names(f"{folder}/_versions/{quote(version, safe='')}")
    return f"{folder}/data={digest}"


def current_version(spark: SparkSession, folder: str) -> str:
    return unquote(_last(spark, folder)[1])


def current_path(spark: SparkSession, folder: str) -> str:
    return f"{folder}/data={_last(spark, folder)[2]}"


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The published version of a table."""
    return spark.read.parquet(current_path(spark, folder))


def _last(spark: SparkSession, folder: str) -> list[str]:
    pointers = Files(spark, folder).names(f"{folder}/_pointers")
    if not pointers:
        raise FileNotFoundError(f"{folder} has no published version")
    return pointers[-1].split("~")


def canonical_json(data: object) -> bytes:
    """JSON with sorted keys, two spaces of indentation and a last line feed."""
    return (json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode("utf-8")


def write_artifact(spark: SparkSession, path: str, data: object) -> str:
    """Writes an immutable JSON file: ``created``, or ``reused`` where it is there with equal bytes; else ``Collision``.

    The file appears with all its bytes or not at all.
    """
    files, payload = Files(spark, path), canonical_json(data)
    if not files.exists(path):
        made = f"{path}._{uuid.uuid4().hex}"
        try:
            files.write(made, payload)
            files.move(made, path)
            return "created"
        except FileExistsError:
            pass
        finally:
            files.delete(made)
    if files.read(path) == payload:
        return "reused"
    raise Collision(f"{path} is there with other bytes")


def replace_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a file, over an older one if there is one; readers see either whole."""
    files = Files(spark, path)
    made = f"{path}._{uuid.uuid4().hex}"
    try:
        files.write(made, content)
        files.move(made, path, over=True)
    finally:
        files.delete(made)
