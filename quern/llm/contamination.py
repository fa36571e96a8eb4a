"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words: A-Z lower-cased, runs of ASCII letters and digits and of any character beyond ASCII. A window is
``width`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.

All words of a window must occur for the window to occur, so the necessary prefix of a window is its rarest
word: words are ordered by how often the whole corpus has them. Corpus words join the prefix words; the
word's place in the window and the text's length bound where the window can start; the words there are
then compared with the window's own.

Null or empty texts have no words, and so no hits. Repeated rows give a row each. Repeated items count once
by id; an item whose id is null marks words but is not listed. Ties of rarity go to the smaller word, then to
its first place. Columns beyond those named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import written

#: Between words, before lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of prefix rows in one broadcast; beyond it the rows are joined in several passes.
BROADCAST_BYTES = 16 << 20
#: A word that no text has, as separators are never within words; it ends every text and brings its row.
END = "\x00"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """The words of a text in order, in their own case."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1)
    first = (F.element_at(parts, 1) == "").cast("int")
    last = (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """A row for each distinct window: words, length and the ids of its items."""
    n = F.size("words")
    return (
        benchmark.select("item_id", split_words(ascii_lower(F.col("text"))).alias("words"))
        .where(n > 0)
        .select(
            "item_id",
            F.explode(
                F.when(
                    n >= width,
                    F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.slice("words", i, width)),
                ).otherwise(F.array("words"))
            ).alias("window"),
        )
        .groupBy("window")
        .agg(F.collect_set("item_id").alias("items"))
    )


def _blocks(table: DataFrame, size: Column) -> int:
    """How many broadcasts of bounded size hold ``table``."""
    return max(1, math.ceil((table.agg(F.sum(size)).first()[0] or 0) / BROADCAST_BYTES))


def prefix_table(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """Each window under its rarest word: key, place of the key, number of words, text, items.

    Windows with a word that the corpus lacks cannot occur and are left out.
    """
    windows = written(
        benchmark_windows(benchmark, width).select(
            F.concat_ws(" ", "window").alias("window_text"), F.size("window").alias("len"), "window", "items"
        ),
        "windows",
    )
    placed = windows.select("window_text", F.posexplode("window").alias("place", "word")).withColumn("key", F.lower("word"))
    vocabulary = written(placed.select("key").distinct(), "vocabulary")
    blocks = _blocks(vocabulary, F.octet_length("key") + 40)
    tokens = docs.select(F.explode(split_words(F.col("text"))).alias("word")).select(F.lower("word").alias("key"))
    counts = None
    for k in range(blocks):
        part = vocabulary.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k) if blocks > 1 else vocabulary
        found = tokens.join(F.broadcast(part), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        counts = found if counts is None else counts.unionByName(found)
    counts = written(counts, "rarity")
    rarest = (
        placed.join(counts, "key", "left")
        .groupBy("window_text")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "place")).alias("rarest"))
        .where(F.col("rarest.n") > 0)
    )
    return windows.join(rarest, "window_text").select(
        F.col("rarest.key").alias("key"), F.col("rarest.place").alias("place"), "len", "window_text", "items"
    )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of ``docs``: its ``keep`` columns, n_words, hits (start, len: windows that occur), items (ids)."""
    prefixes = written(prefix_table(docs, benchmark, width), "prefixes")
    blocks = _blocks(prefixes, F.octet_length("key") + F.octet_length("window_text") + 16 * F.size("items") + 80)
    end = prefixes.sparkSession.range(1).select(
        F.lit(END).alias("key"), F.lit(0).alias("place"), F.lit(0).alias("len"), F.lit(None).cast("string").alias("window_text"), F.lit(None).cast(prefixes.schema["items"].dataType).alias("items")
    )
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept"), split_words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    tokens = texts.select("row", "kept", "words", "n_words", F.posexplode(F.concat("words", F.array(F.lit(END)))).alias("at", "word"))
    start = F.col("at") - F.col("place")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    there = ascii_lower(F.concat_ws(" ", F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("len"))))
    found = None
    for k in range(blocks):
        part = prefixes.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k) if blocks > 1 else prefixes
        hit = (
            tokens.join(F.broadcast(part.unionByName(end)), F.lower("word") == F.col("key"))
            .where(F.col("window_text").isNull() | F.when(fits, there == F.col("window_text")).otherwise(F.lit(False)))
            .select("row", "kept", "n_words", F.when(F.col("window_text").isNotNull(), F.struct(start.alias("start"), F.col("len"))).alias("hit"), "items")
        )
        found = hit if found is None else found.unionByName(hit)
    return (
        found.groupBy("row", "kept", "n_words")
        .agg(F.array_sort(F.collect_set("hit")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        .select("kept.*", F.col("n_words").cast("long").alias("n_words"), "hits", "items")
    )


def hit_words(hits: Column) -> Column:
    """How many words the sorted spans cover."""
    return F.aggregate(
        hits,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["start"] + x["len"]).alias("end"),
            (s["n"] + F.greatest(x["start"] + x["len"] - F.greatest(s["end"], x["start"]), F.lit(0))).alias("n"),
        ),
        lambda s: s["n"],
    )


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
