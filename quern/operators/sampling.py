"""Deterministic samples and strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.places import placed
from quern.sources.scratch import written


def hash_bucket(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Rows whose SHA-256 of the key, its first 8 digits read as a share, is below ``share``."""
    place = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    return rows.where(place < share)


def round_robin(rows: DataFrame, strata: tuple[str, ...], key: str, n: int, seed: str) -> DataFrame:
    """The first of every stratum, then the second, and so on, ``n`` in all; strata are shuffled by hash."""
    order = F.sha2(F.concat_ws("\0", F.lit(seed), F.col(key).cast("string")), 256)
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(order, key))
    return rows.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", *strata).limit(n)


def quartiles(rows: DataFrame, group: str, key: str) -> DataFrame:
    """bucket = least(3, 4 * index / count) of rows in order of key within their group."""
    return placed(rows, group, key).select(*rows.columns, F.least(F.lit(3), F.floor(F.col("_before") * 4 / F.col("_total"))).cast("int").alias("bucket"))


def systematic(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows at places i * count / n in order of key; places are those of a total order."""
    total = rows.count()
    if not total:
        return rows
    wanted = sorted({i * total // n for i in range(min(n, total))})
    return _at(rows, key, wanted)


def evenly_spaced(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows at places i * (count - 1) / (n - 1), first and last included."""
    total = rows.count()
    if not total:
        return rows
    return _at(rows, key, sorted({i * (total - 1) // max(n - 1, 1) for i in range(n)}))


def _at(rows: DataFrame, key: str, places: list[int]) -> DataFrame:
    """Rows at those places by key; ties of key may fall either way.

    Rows are written with their range partition and place there, so that counts and rows come from one partitioning: its
    bounds are sampled anew each time it is computed. No task sorts all rows, and a row for each partition reaches the driver.
    """
    parts = rows.repartitionByRange(F.col(key)).select("*", F.spark_partition_id().alias("_part"))
    placed = written(parts.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1), "placed")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen, base = [], 0
    for part in sorted(sizes):
        chosen += [F.struct(F.lit(part).alias("_part"), F.lit(p - base).alias("_place")) for p in places if base <= p < base + sizes[part]]
        base += sizes[part]
    wanted = rows.sparkSession.range(1).select(F.inline(F.array(*chosen)))
    return placed.join(F.broadcast(wanted), ["_part", "_place"]).drop("_part", "_place")


def representatives(rows: DataFrame, group: str, key: str) -> DataFrame:
    """For each group the key of least SHA-256."""
    digest = F.sha2(F.col(key).cast("string"), 256)
    return rows.groupBy(group).agg(F.min(F.struct(digest.alias("h"), F.col(key).alias("k"))).alias("x")).select(group, F.col("x.k").alias(key))
