"""Places of rows in the order of a key within their group, for groups of any size.

Rows are spread by ranges of (group, key) and each range adds what its group has in the ranges before it, so that no task
orders a whole group or holds its values. Null groups are one group. Ties of key may fall either way. Empty tables give
no rows. Columns ``_before``, ``_total``, ``_n``, ``_part`` and ``_end`` must not be in the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import written


def placed(rows: DataFrame, group: str, key: str, weight: str | None = None) -> DataFrame:
    """``rows`` with ``_before``, the rows of their group before them by key, and ``_total``, those it has; a row counts ``weight`` times.

    They are written with their range, as its bounds are sampled anew each time it is computed.
    """
    n = F.lit(1) if weight is None else F.col(weight)
    ranged = rows.repartitionByRange(F.col(group), F.col(key)).select("*", n.cast("long").alias("_n"), F.spark_partition_id().alias("_part"))
    so_far = Window.partitionBy("_part", group).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = written(ranged.withColumn("_end", F.sum("_n").over(so_far)), "placed")
    sizes = held.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_range")).agg(F.sum("_n").alias("_size"))
    every = Window.partitionBy("_group")
    bases = sizes.select("_group", "_range", (F.sum("_size").over(every.orderBy("_range")) - F.col("_size")).alias("_base"), F.sum("_size").over(every).alias("_total"))
    joined = held.join(bases, (F.col("_part") == F.col("_range")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*rows.columns, (F.col("_base") + F.col("_end") - F.col("_n")).alias("_before"), "_total")


def counted(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, ``_k`` (rows that have it), ``_before`` and ``_total``; equal values are counted before they are ordered, nulls left out."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_k"))
    return placed(counts, group, value, "_k")


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group and, by name, the exact value at each share, interpolated between its neighbours."""
    found = []
    for name, share in shares.items():
        place = share * (F.col("_total") - 1)
        at = lambda p: F.max(F.when((F.col("_before") <= p) & (p < F.col("_before") + F.col("_k")), F.col(value)))
        low, high = at(F.floor(place)), at(F.ceil(place))
        found.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return counted(rows, group, value).groupBy(group).agg(*found)


def nearest_rank(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """group and value at place ceil(share * n), the first at least."""
    place = F.greatest(F.ceil(share * F.col("_total")), F.lit(1))
    return counted(rows, group, value).where((F.col("_before") < place) & (place <= F.col("_before") + F.col("_k"))).select(group, value)
