"""Rows dealt to shards by a weighted hash tree of regions, racks and shards.

A row descends from the root: at each level every child draws a number from the row's key and the child's own name,
``-ln(u) / weight`` of a ``u`` in (0, 1), and the least draw wins, so a child gets rows in proportion to its weight. A
node's weight is the sum of its shards' weights. A draw depends on the key and on that child alone; when weights change,
rows move only into children whose weight has risen or out of those whose weight has fallen, and below nodes whose weights
are the same nothing moves.

A shard added within a rack raises the weights of its rack and region, and rows that come into the region may land on any
shard of it. A shard that comes as a region of its own changes no other weight, so it takes rows only into itself:
``grown`` adds shards like that, which makes the shards of n + 1 those of n but for rows in the new one.

Keys are compared as text. A null key draws as an empty text, and rows of equal keys, null ones included, share a shard;
so do repeated rows, which keep a slot each. Null texts count as empty: size 8, checksum 0. Texts are measured whole.
Empty tables give no rows. Further columns are not read, so no name can clash. Weights must be positive numbers, names of
siblings distinct, and no name holds a slash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import written

#: Names of regions, in them of racks, in them of shards with their weights. Shards are numbered in this order.
Tree = Mapping[str, Mapping[str, Mapping[str, float]]]

#: Bytes of a row besides its text.
ROW_BYTES = 8
#: Partitions and shards in one broadcast, 40 bytes each; more are joined by a shuffle.
BROADCAST_STARTS = 200_000


def even_tree(regions: int, racks: int, shards: int) -> Tree:
    """A tree of so many regions, racks in each and shards in each rack, all of one weight."""
    return {f"region{r}": {f"rack{k}": {f"shard{s}": 1.0 for s in range(shards)} for k in range(racks)} for r in range(regions)}


def grown(tree: Tree, n: int = 1) -> Tree:
    """The tree with ``n`` more shards of weight 1, each in a region of its own."""
    more = {f"grown{len(tree) + k}": {"rack0": {"shard0": 1.0}} for k in range(n)}
    if clash := more.keys() & tree.keys():
        raise ValueError(f"regions of these names are there already: {sorted(clash)}")
    return dict(tree) | more


def checked(tree: Tree) -> Tree:
    weights = [(f"{g}/{k}/{s}", w) for g, racks in tree.items() for k, shards in racks.items() for s, w in shards.items()]
    if not weights or any(not shards for racks in tree.values() for shards in racks.values()) or not all(tree.values()):
        raise ValueError("every region needs a rack and every rack a shard")
    if bad := [name for name, w in weights if not 0 < w < float("inf") or name.count("/") != 2]:
        raise ValueError(f"weights must be positive and names without slashes: {bad}")
    return tree


def draw(key: Column, name: str, weight: float) -> Column:
    """The draw of a node for a key: exponential with the weight as its rate. Its 52 bits come from an MD5 digest."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def descended(key: Column, tree: Tree) -> Column:
    """The number of the shard that a key descends to; ``key`` is a text."""
    numbers = iter(range(1 << 30))
    regions = {}
    for g, racks in checked(tree).items():
        below = {k: _chosen(key, {s: (f"{g}/{k}/{s}", w, F.lit(next(numbers))) for s, w in shards.items()}) for k, shards in racks.items()}
        regions[g] = (g, sum(w for shards in racks.values() for w in shards.values()), _chosen(key, {k: (f"{g}/{k}", sum(racks[k].values()), below[k]) for k in racks}))
    return _chosen(key, regions)


def _chosen(key: Column, children: dict[str, tuple[str, float, Column]]) -> Column:
    """What lies below the child of the least draw; the first of equal draws."""
    if len(children) == 1:
        return next(iter(children.values()))[2]
    draws = F.array(*(draw(key, name, weight) for name, weight, _ in children.values()))
    below = [column for _, _, column in children.values()]

    def choose(drawn: Column) -> Column:
        at = F.array_position(drawn, F.array_min(drawn))
        found = F.when(at == 1, below[0])
        for k, column in enumerate(below[1:], 2):
            found = found.when(at == k, column)
        return found

    # One element, so that the draws are made once and not once for each child that may win.
    return F.transform(F.array(draws), choose)[0]


def shards(docs: DataFrame, tree: Tree, more: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's key, size, text_crc32, shard, slot in that shard, and shard in the tree ``more`` (null without one).

    Slots number a shard's rows without gaps in the order of key (null first), size and checksum. The rows, without their
    texts, are sorted by ranges that also part equal rows; each range numbers its own and adds the counts of those before.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    named = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + F.lit(ROW_BYTES).cast("long")).alias("size"), F.crc32(body).alias("text_crc32"), named.alias("_key"))
    second = descended(F.col("_key"), more) if more else F.lit(None).cast("int")
    dealt = written(rows.select("doc_id", "size", "text_crc32", descended(F.col("_key"), tree).alias("shard"), second.alias("grown_shard")), "dealt")
    order = ["shard", "doc_id", "size", "text_crc32", "_row"]
    ranges = dealt.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    placed = written(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "placed")
    runs = placed.groupBy(F.col("_part").alias("_p"), F.col("shard").alias("_s")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(runs.select("_p", "_s", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), "starts")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_STARTS else starts
    met = placed.join(starts, (F.col("_part") == F.col("_p")) & (F.col("shard") == F.col("_s")))
    return met.select("doc_id", "size", "text_crc32", "shard", (F.col("_at") + F.col("_shift")).alias("slot"), "grown_shard")
