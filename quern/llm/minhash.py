"""Near duplicates by b-bit MinHash, with links confirmed on whole shingle sets.

A text's set is its distinct runs of ``shingle`` words (A-Z lower-cased; of fewer words, the whole text; without
words, empty and linked with nothing). Rows with equal sets form a class; classes are compared by one row each.
Minima under ``rows * bands`` hash functions are cut into bands; two bits of each minimum are kept, packed. The
number of bands is such that a pair at the threshold shares none with a probability of ``MISS`` at most.

Within a band's bucket not all pairs are formed. The member whose buckets are fullest is the centre; every other is
paired with it. Pairs whose similarity, estimated from equal bits and corrected for chance, is near enough the
threshold are confirmed on their sets. Members whose component differs from their centre's are then paired with all
members of the bucket in other components, again behind sizes and the estimate, and behind a bound from what both
share with the centre, so that no link between components is lost to the choice of centres.

Null texts have an empty set. Rows of equal doc_id are separate. The smallest doc_id of a component names it; null
is larger than any. Of rows with that doc_id the first read stays. Columns not named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.hashing import mixed, shingles, stream, word_hashes
from quern.sources.scratch import written

ROWS = 6
MISS = 1e-6
BITS = 2
#: Standard errors of the estimate by which a pair may fall short before it is put aside.
MARGIN = 6.0
#: Shingles hashed at once.
BLOCK = 1024
#: 64-bit words of the bitmap of what a set has beside its centre's.
OWN_WORDS = 8
#: Rows of 24 bytes in one broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def band_count(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def minima(items: np.ndarray, n: int) -> np.ndarray:
    """The least of each of ``n`` hash functions (32 bits) over the items."""
    low = (mixed(items) >> np.uint64(32)).astype(np.uint32)
    a = stream(3, n).astype(np.uint32) | np.uint32(1)
    b = (stream(4, n) >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), BLOCK):
        values = low[i : i + BLOCK, None] * a
        values += b
        values ^= values >> np.uint32(15)
        np.minimum(least, values.min(axis=0), out=least)
    return least


def packed_bits(least: np.ndarray) -> np.ndarray:
    """The low bits of mixed minima, 32 to a 64-bit word."""
    bits = (mixed(least.astype(np.uint64)) & np.uint64(3)).astype(np.uint8)
    padded = np.zeros(-(-len(bits) // 32) * 32, np.uint8)
    padded[: len(bits)] = bits
    quads = padded.reshape(-1, 4)
    return (quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6).astype(np.uint8).view("<i8")


def signatures(docs: DataFrame, shingle: int, bands: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash (16 bytes), sig (longs) and keys (a long for each band) of each row."""
    n = bands * ROWS
    source = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = stream(5, bands)
        weights = stream(6, ROWS)
        for batch in batches:
            sizes, sets, sigs, keys = [], [], [], []
            for words in word_hashes(batch.column(2), fold=True):
                low = 0
                for high in words.ends.tolist():
                    items = shingles(words.hashes[low:high], shingle)
                    low = high
                    sizes.append(len(items))
                    if not len(items):
                        sets.append(None)
                        sigs.append(None)
                        keys.append(None)
                        continue
                    total = np.array([items.sum(dtype=np.uint64), mixed(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
                    sets.append(total.tobytes())
                    least = minima(items, n)
                    sigs.append(packed_bits(least))
                    keys.append(mixed((least.reshape(bands, ROWS).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64) + salts).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(sets, pa.binary()),
                    pa.array(sigs, pa.list_(pa.int64())),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "n_shingles", "set_hash", "sig", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = source.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, set_hash binary, sig array<long>, keys array<long>")
    return made.withColumn("row", F.monotonically_increasing_id())


def estimate(a: Column, b: Column, n: int) -> Column:
    """Similarity from ``n`` pairs of bits: the share of equal ones, less those equal by chance."""
    mask = 0x5555555555555555
    unequal = F.lit(0)
    for k in range(-(-n // 32)):
        x = F.get(a, k).bitwiseXOR(F.get(b, k))
        unequal = unequal + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(mask)))
    chance = 1 / 2**BITS
    return ((1 - unequal / F.lit(float(n))) - chance) / (1 - chance)


def least_estimate(threshold: float, n: int) -> float:
    chance = 1 / 2**BITS
    share = chance + (1 - chance) * threshold
    return threshold - MARGIN * math.sqrt(share * (1 - share) / n) / (1 - chance)


def measured(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """Each of ``pairs`` (a, b: rows of ``nodes``) with n_a, n_b, both (sizes of the sets and of what they share) and own (bits of what only a has).

    Texts come from ``docs`` by doc_id and hash of the text.
    """
    wanted = written(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct().join(nodes.select("row", "doc_id", "text_hash"), "row"), "wanted")
    few = wanted.count()
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    side = F.broadcast(wanted) if few <= BROADCAST_ROWS else wanted
    found = written(texts.join(side, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("row", "text"), "texts")
    if found.count() > few:  # docs has repeated rows
        found = written(found.dropDuplicates(["row"]), "texts")
    left = found.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    right = found.select(F.col("row").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, own = [], []
            sides = [[s for w in word_hashes(batch.column(k), fold=True) for s in _sets(w, shingle)] for k in (2, 3)]
            for x, y in zip(*sides, strict=True):
                alone = np.setdiff1d(x, y, assume_unique=True)
                bits = np.zeros(OWN_WORDS * 64, np.uint8)
                bits[alone & np.uint64(OWN_WORDS * 64 - 1)] = 1
                sizes.append((len(x), len(y), len(x) - len(alone)))
                own.append(np.packbits(bits, bitorder="little").view("<i8"))
            columns = list(zip(*sizes, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns), pa.array(own, pa.list_(pa.int64()))], names=["a", "b", "n_a", "n_b", "both", "own"]
            )

    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long, n_a long, n_b long, both long, own array<long>")


def _sets(words, shingle: int) -> list[np.ndarray]:
    return [shingles(words.hashes[a:b], shingle) for a, b in zip(words.starts().tolist(), words.ends.tolist(), strict=True)]


def similar(both: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return (both > 0) & (100 * both >= percent * (n_a + n_b - both))


def most_shared(x: Column, y: Column) -> Column:
    """A bound on what two sets share that are both measured against one centre (size, both, own).

    Of the centre they share no more than either has of it; beside it, no more than either has, nor than their
    bits have in common and bits that stand for more than one could add.
    """
    common, ones_x, ones_y = F.lit(0), F.lit(0), F.lit(0)
    for k in range(OWN_WORDS):
        p, q = F.get(x["own"], k), F.get(y["own"], k)
        common, ones_x, ones_y = common + F.bit_count(p.bitwiseAND(q)), ones_x + F.bit_count(p), ones_y + F.bit_count(q)
    own_x, own_y = x["size"] - x["both"], y["size"] - y["both"]
    return F.least(x["both"], y["both"]) + F.least(own_x, own_y, common + F.least(own_x - ones_x, own_y - ones_y))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and kept for every row of ``docs``."""
    threshold = percent / 100
    bands = band_count(threshold)
    n = bands * ROWS
    rows = written(signatures(docs, shingle, bands), "signatures")
    grouped = written(rows.where(F.col("set_hash").isNotNull()).groupBy("set_hash").agg(F.min("row").alias("row")), "classes")
    nodes = written(rows.join(grouped.select("row"), "row", "left_semi").select("row", "doc_id", "text_hash", "n_shingles", "sig", "keys"), "nodes")
    members = nodes.select("row", F.explode("keys").alias("key"))
    full = written(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "buckets")
    shared = written(members.join(full, "key"), "members")
    weight = written(shared.groupBy("row").agg(F.sum("n").alias("weight")), "weights")
    centres = written(
        shared.join(weight, "row").groupBy("key").agg(F.max(F.struct("weight", (-F.col("row")).alias("minus"))).alias("best")).select("key", (-F.col("best.minus")).alias("centre")),
        "centres",
    )
    starred = written(shared.select("key", "row").join(centres, "key").where(F.col("row") != F.col("centre")), "stars")
    sig = nodes.select("row", "sig", F.col("n_shingles").alias("size"))
    near = lambda x, y: (100 * F.least(x["size"], y["size"]) >= percent * F.greatest(x["size"], y["size"])) & (estimate(x["sig"], y["sig"], n) >= least_estimate(threshold, n))
    one, two = (sig.select(F.col("row").alias(k), F.struct("sig", "size").alias(f"s{k}")) for k in "ab")
    stars = starred.select(F.col("row").alias("a"), F.col("centre").alias("b")).distinct()
    first = written(stars.join(one, "a").join(two, "b").where(near(F.col("sa"), F.col("sb"))).select("a", "b"), "candidates")
    held = written(measured(docs, nodes, first, shingle), "measured")
    linked = similar(F.col("both"), F.col("n_a"), F.col("n_b"), percent)
    links = written(held.where(linked).select("a", "b"), "links")
    parts = components(links)
    # whoever is still apart from its centre meets the rest of the bucket
    home = lambda k: parts.select(F.col("node").alias(k), F.col("component").alias(f"{k}_part"))
    placed = written(
        starred.join(home("row"), "row", "left").join(home("centre"), "centre", "left").select(
            "key", "row", "centre", F.coalesce("row_part", "row").alias("part"), F.coalesce("centre_part", "centre").alias("other")
        ),
        "placed",
    )
    open_keys = written(placed.where(F.col("part") != F.col("other")).select("key").distinct(), "open")
    about = held.select(F.col("a").alias("row"), F.col("b").alias("centre"), "both", "own")
    rest = written(
        placed.join(open_keys, "key", "left_semi")
        .join(about, ["row", "centre"], "left")
        .join(sig, "row")
        .select("key", "row", "part", (F.col("part") != F.col("other")).alias("apart"), F.struct("sig", "size", "both", "own").alias("s")),
        "members",
    )
    x, y = F.col("sa"), F.col("sb")
    shared_most = most_shared(x, y)
    possible = x["both"].isNull() | y["both"].isNull() | similar(shared_most, x["size"], y["size"], percent)
    pairs = (
        rest.where("apart").select("key", F.col("row").alias("a"), F.col("part").alias("part_a"), F.col("s").alias("sa"))
        .join(rest.select("key", F.col("row").alias("b"), F.col("part").alias("part_b"), F.col("apart").alias("apart_b"), F.col("s").alias("sb")), "key")
        .where((F.col("part_a") != F.col("part_b")) & (~F.col("apart_b") | (F.col("a") < F.col("b"))) & possible & near(x, y))
        .select("a", "b")
        .distinct()
    )
    second = written(pairs, "more-candidates")
    if not second.isEmpty():
        more = measured(docs, nodes, second, shingle).where(linked).select("a", "b")
        links = links.unionByName(written(more, "more-links"))
        parts = components(links)
    classes = grouped.join(parts, F.col("row") == F.col("node"), "left").select("set_hash", F.coalesce("component", "row").alias("component"))
    sized = rows.groupBy("set_hash").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    named = written(
        written(classes, "parts").join(sized, "set_hash").groupBy("component").agg(F.min("least").alias("component_id"), F.min("first").alias("first")), "names"
    )
    whole = written(classes.join(named, "component").select("set_hash", "component_id", F.col("first.row").alias("kept_row")), "labels")
    return rows.join(whole, "set_hash", "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("set_hash").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("set_hash").isNull() | (F.col("row") == F.col("kept_row"))).alias("kept"),
    )
