"""The identity of a corpus: counts, bytes, tokens and a digest of its ids in order, with no task that hashes all of them.

Ids are placed in the order of a key by ranges. Each run of ``LEAF`` places gives the SHA-256 of its ids, comma-joined; runs
of ``LEAF`` digests give one each; those of the last level give the identity. Runs are fixed by place, so partitions and
their number don't matter, and any two ids that change places change it.

Repeated (key, id) pairs count once in the digest and ``records`` tells them apart from ``ids``. Null keys come first; a null
id is an empty one. Empty tables have no records and the digest of an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import places

LEAF = 256


def _joined(rows: DataFrame, place: str, value: str, group: Column) -> DataFrame:
    """group and digest: SHA-256 of a group's values in the order of their places; a group has ``LEAF`` at most, but the last level's."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(value).alias("v"))))
    return rows.groupBy(group.alias("g")).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["v"]), ","), 256).alias("digest"))


def ordered_digest(rows: DataFrame, id_column: str, *order: str) -> DataFrame:
    """ids and ordered_ids_sha256 of ids by ``order``, then id."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    distinct = rows.select(F.lit(0).alias("all"), F.struct(*order, F.col(id_column).alias("_id")).alias("key"), text.alias("id")).distinct()
    placed = places.placed(distinct, "all", "key")
    leaves = _joined(placed, "_before", "id", F.floor(F.col("_before") / LEAF))
    upper = _joined(leaves, "g", "digest", F.floor(F.col("g") / LEAF))
    root = _joined(upper, "g", "digest", F.lit(0)).agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("ordered_ids_sha256"))
    return placed.agg(F.count(F.lit(1)).alias("ids")).join(root)


def corpus_identity(docs: DataFrame, id_column: str, order: tuple[str, ...], group: str, text: str) -> DataFrame:
    """One row: records, ids, groups (``name:count`` sorted, comma-joined), bytes, tokens (between white space), ordered_ids_sha256."""
    counted = docs.groupBy(F.coalesce(F.col(group), F.lit("")).alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.coalesce(F.col(text), F.lit("")))).alias("bytes"), F.sum(F.size(T.spaced(F.col(text)))).alias("tokens")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    sums = counted.agg(
        total("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", F.col("n").cast("string")))), ",").alias("groups"), total("bytes"), total("tokens")
    )
    return sums.withColumnRenamed("n", "records").join(ordered_digest(docs, id_column, *order))
