"""Tables that a job writes for itself, in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where unset, as in tests, a new temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if app not in _made:
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="quern-")
            spark.sparkContext.setCheckpointDir(base)
        _made[app] = f"{base.rstrip('/')}/quern-{os.getpid()}-{uuid.uuid4().hex[:8]}"
        atexit.register(removed, spark, _made[app])
    return _made[app]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on any file system of Spark, where the session still runs."""
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    Cuts the lineage, survives lost executors and gives later joins the real size of the table.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
