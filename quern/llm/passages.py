"""Repeated passages by a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words (runs of characters other than ASCII white space, unchanged). Its
fingerprint is the least hash of the ``GRAM``-word runs in it, the leftmost on a tie; equal windows have equal
fingerprints, and neighbours mostly share theirs. Windows of one text that share a fingerprint at one place form a
stretch, which also has a hash of all its words.

Batches of documents add immutable runs, in buckets sorted by fingerprint, of (fingerprint, stretch, count). Each new run
is merge-joined with the older ones to find fingerprints that occurred before; when there are ``FANOUT`` runs they are
compacted to one. An index in a folder of its own is found again by later sessions, which add their batches. Fingerprints seen twice are then verified: stretches that occur twice are repeated as a whole;
where one fingerprint has different stretches, as at the edges of copies, their windows are compared one by one by
96 bits of hashes of all words. Windows that occur twice anywhere, in one document or several, mark their words.

Null and empty texts have no words. Very long texts are read whole; a row is held by one task. Texts shorter than a window repeat nothing. Repeated rows repeat each other. An
empty table adds no run. Rows are known by a number written with the fingerprints. Columns not named are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.hashing import gram_hashes, mixed, word_hashes
from quern.sources.scratch import removed, shared_dir, written

WINDOW, GRAM = 35, 8
BATCHES, FANOUT = 3, 3
#: Rows of a bucket that an index is laid out for, and how many buckets it has.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 16, 20_000
#: Windows whose least run is sought at once.
BLOCK = 1 << 15
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WHOLE, SINGLE, MODEL = 1, 2, 3


class Sums:
    """Hashes of any run of words of one text."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        steps = np.full(n, _BASE, np.uint64)
        steps[:1] = 1
        powers = np.cumprod(steps)
        back = np.full(n + 1, _BASE_INVERSE, np.uint64)
        back[:1] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers)])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mixed((self.sums[high] - self.sums[low]) * self.back[low] + (high - low).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def stretches(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fingerprint, first window and number of windows of each stretch of one text."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = gram_hashes(hashes, GRAM)
    span = WINDOW - GRAM + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    places = np.concatenate([view[i : i + BLOCK].argmin(axis=1) for i in range(0, n, BLOCK)]) + np.arange(n)
    first = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1])
    return grams[places[first]], first, np.diff(np.append(first, n))


def stretch_hashes(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return Sums(hashes).of(first, first + count + WINDOW - 1)


def texts_of(words) -> Iterator[np.ndarray]:
    low = 0
    for high in words.ends.tolist():
        yield words.hashes[low:high]
        low = high


def joined_sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def fingerprints(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, n_words, whole_sha256 (of all words) and prints (fingerprint, stretch, n: distinct) of each row."""
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            sizes, shas, ends, parts = [], [], [0], []
            for words in word_hashes(texts):
                for hashes in texts_of(words):
                    body = (texts[len(sizes)].as_py() or "").encode("utf-8", "surrogatepass").split()
                    sizes.append(len(body))
                    shas.append(joined_sha(body))
                    prints, first, count = stretches(hashes)
                    if len(prints):
                        pairs = np.stack([prints, stretch_hashes(hashes, first, count)], axis=1)
                        pairs, n = np.unique(pairs, axis=0, return_counts=True)
                        parts.append((pairs[:, 0], pairs[:, 1], n))
                        ends.append(ends[-1] + len(n))
                    else:
                        ends.append(ends[-1])
            flat = [np.concatenate([p[k] for p in parts]).view(np.int64) if parts else np.empty(0, np.int64) for k in range(3)]
            items = pa.StructArray.from_arrays([pa.array(x) for x in flat], names=["print", "stretch", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)],
                names=["doc_id", "text_hash", "n_words", "whole_sha256", "prints"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = source.mapInArrow(run, f"doc_id {kind}, text_hash long, n_words long, whole_sha256 string, prints array<struct<print:long,stretch:long,n:long>>")
    return made.withColumn("row", F.monotonically_increasing_id())


class FingerprintIndex:
    """Immutable runs of (print, stretch, n) in a folder, each in buckets of the print and sorted by it there.

    A run is a bucketed table over its own folder, so joins with older runs read their buckets as they are: the history is
    never shuffled again. A manifest lists the runs that count; it is written after the runs are, so a job that fails
    leaves the index as it was. ``open_index`` finds an index that an earlier session left.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = LEAST_BUCKETS, runs: tuple[str, ...] = (), version: int = 0):
        """Without a ``folder`` the index lives in the job's own and ends with it."""
        self.own = folder is None
        folder = folder or f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:8]}"
        self.spark, self.folder, self.buckets, self.names, self.version = spark, folder, buckets, list(runs), version
        self.tables = {name: self._registered(name) for name in self.names}

    @property
    def runs(self) -> list[DataFrame]:
        return [self.tables[name] for name in self.names]

    def _registered(self, name: str) -> DataFrame:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (print BIGINT, stretch BIGINT, n BIGINT) USING parquet "
            f"CLUSTERED BY (print) SORTED BY (print, stretch) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'"
        )
        return self.spark.table(name)

    def _written(self, dealt: DataFrame) -> str:
        """Writes counts that are already dealt by print to the index's buckets."""
        name = f"quern_run_{uuid.uuid4().hex}"
        dealt.write.bucketBy(self.buckets, "print").sortBy("print", "stretch").option("path", f"{self.folder}/{name}").option("compression", "zstd").saveAsTable(name)
        self.tables[name] = self.spark.table(name)
        return name

    def _commit(self, names: list[str]) -> None:
        self.version += 1
        listed = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
        self.spark.range(1).select(F.lit(self.buckets).alias("buckets"), listed.alias("runs")).coalesce(1).write.parquet(f"{self.folder}/manifest/version={self.version}")
        self.names = names

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds the prints of a batch (from fingerprints); returns those prints that have now occurred more than once."""
        counted = batch.select(F.explode("prints").alias("p")).groupBy("p.print", "p.stretch").agg(F.sum("p.n").alias("n"))
        name = self._written(counted.repartition(self.buckets, "print"))  # copies are counted before, so no print is hot here
        run = self.tables[name]
        seen = run.groupBy("print").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("print")
        for old in self.runs:
            seen = seen.union(run.select("print").hint("merge").join(old.select("print"), "print", "left_semi"))
        found = written(seen.distinct(), "seen")
        self._commit([*self.names, name])
        if len(self.names) >= FANOUT:
            self.compact()
        return found

    def compact(self) -> None:
        """Replaces all runs by one. Old ones stay, as others may read them, but where the index is the job's own."""
        old = self.names
        self._commit([self._written(self.entries())])
        for name in old if self.own else ():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            removed(self.spark, f"{self.folder}/{name}")
            del self.tables[name]

    def entries(self) -> DataFrame:
        """Every (print, stretch) once, with its count, dealt by print: runs have each once already, so one shuffle does."""
        if len(self.names) == 1:
            return self.runs[0]
        whole = self.runs[0]
        for run in self.runs[1:]:
            whole = whole.unionByName(run)
        return whole.repartition(self.buckets, "print").groupBy("print", "stretch").agg(F.sum("n").alias("n"))


def open_index(spark: SparkSession, folder: str) -> FingerprintIndex:
    """The index that an earlier session left in ``folder``, by the last version of its manifest."""
    last = spark.read.parquet(f"{folder}/manifest").orderBy(F.desc("version")).first()
    return FingerprintIndex(spark, folder, last["buckets"], tuple(last["runs"]), last["version"])


def buckets_for(prints: DataFrame) -> int:
    """Buckets of an index that such a batch begins: its runs keep that number for good."""
    n = prints.agg(F.sum(F.size("prints"))).first()[0] or 0
    return int(min(max(n // BUCKET_ROWS, LEAST_BUCKETS), MOST_BUCKETS))


def marked_prints(index: FingerprintIndex, seen: DataFrame) -> DataFrame:
    """print, stretch, whole (the stretch repeats) and edge (its print has other stretches) of entries that may repeat."""
    entries = written(index.entries().join(seen, "print", "left_semi"), "entries")
    kinds = written(entries.groupBy("print").agg(F.count(F.lit(1)).alias("kinds")), "kinds")
    return entries.join(kinds, "print").select("print", "stretch", (F.col("n") > 1).alias("whole"), (F.col("kinds") > 1).alias("edge"))


def _runs_to_check(texts: pa.Array, marks: list[list[dict]]) -> Iterator[tuple[int, np.ndarray, dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Each text's number, hashes, kinds by (print, stretch), and its stretches that are marked: hash pair index, first, count."""
    at = 0
    for words in word_hashes(texts):
        for hashes in texts_of(words):
            kinds = {(m["print"], m["stretch"]): m["kind"] for m in marks[at]}
            prints, first, count = stretches(hashes)
            whole = stretch_hashes(hashes, first, count).view(np.int64).tolist()
            found = [kinds.get(k, 0) for k in zip(prints.view(np.int64).tolist(), whole, strict=True)]
            yield at, hashes, kinds, np.array(found, np.int64), first, count
            at += 1


def window_rows(marked: DataFrame) -> DataFrame:
    """h, c (hashes), row, start and wanted of the windows of stretches that must be compared one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for at, hashes, _, kinds, first, count in _runs_to_check(batch.column(1), batch.column(2).to_pylist()):
                chosen = np.flatnonzero(kinds >= SINGLE)
                if not len(chosen):
                    continue
                starts = np.concatenate([np.arange(first[k], first[k] + count[k]) for k in chosen])
                wanted = np.repeat(kinds[chosen] == SINGLE, count[chosen])
                h = Sums(hashes).of(starts, starts + WINDOW).view(np.int64)
                c = (Sums(mixed(hashes ^ np.uint64(0xA0761D6478BD642F))).of(starts, starts + WINDOW) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(c), pa.array(np.full(len(h), rows[at], np.int64)), pa.array(starts, pa.int32()), pa.array(wanted)], names=["h", "c", "row", "start", "wanted"]
                )

    return marked.select("row", "text", "marks").where(F.exists("marks", lambda m: m["kind"] >= SINGLE)).mapInArrow(run, "h long, c int, row long, start int, wanted boolean")


def removed_text(marked: DataFrame) -> DataFrame:
    """row, n_removed and kept_sha256 (and kept text) of marked rows with starts of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, shas, kept = [], [], []
            starts = batch.column(3).to_pylist()
            texts = batch.column(1)
            for at, hashes, _, kinds, first, count in _runs_to_check(texts, batch.column(2).to_pylist()):
                change = np.zeros(len(hashes) + 1, np.int64)
                whole = (kinds == WHOLE) | (kinds == MODEL)
                np.add.at(change, first[whole], 1)
                np.add.at(change, first[whole] + count[whole] + WINDOW - 1, -1)
                one = np.array(starts[at] or [], np.int64)
                np.add.at(change, one, 1)
                np.add.at(change, one + WINDOW, -1)
                keep = np.cumsum(change[:-1]) == 0
                words = (texts[at].as_py() or "").encode("utf-8", "surrogatepass").split()
                left = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
                shas.append(joined_sha(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())], names=["row", "n_removed", "kept_sha256", "kept_text"])

    return marked.select("row", "text", "marks", "starts").mapInArrow(run, "row long, n_removed long, kept_sha256 string, kept_text string")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text (null: the text as it is) of every row of ``docs``."""
    prints = written(fingerprints(docs), "prints")
    index = FingerprintIndex(docs.sparkSession, buckets=buckets_for(prints))
    seen = None
    for k in range(BATCHES):
        found = index.add(prints.where(F.pmod(F.xxhash64("row"), F.lit(BATCHES)) == k))
        seen = found if seen is None else seen.union(found)
    marks = written(marked_prints(index, written(seen.distinct(), "seen")), "marks")
    held = prints.select("row", F.explode("prints").alias("p")).select("row", "p.print", "p.stretch")
    hits = written(held.join(marks, ["print", "stretch"]).where(F.col("whole") | F.col("edge")), "hits")
    models = hits.where(F.col("whole") & F.col("edge")).groupBy("print", "stretch").agg(F.min("row").alias("model"))
    kinds = hits.join(written(models, "models"), ["print", "stretch"], "left").select(
        "row", "print", "stretch", F.when(~F.col("whole"), SINGLE).when(F.col("row") == F.col("model"), MODEL).otherwise(WHOLE).alias("kind")
    )
    by_row = kinds.groupBy("row").agg(F.collect_list(F.struct("print", "stretch", "kind")).alias("marks"))
    wanted = written(by_row.join(prints.select("row", "doc_id", "text_hash"), "row"), "wanted")
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    marked = written(wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("row", "text", "marks"), "marked")
    if marked.count() > wanted.count():  # docs has repeated rows
        marked = written(marked.dropDuplicates(["row"]), "marked")
    windows = written(window_rows(marked), "windows")
    twice = written(windows.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("h", "c"), "twice")
    starts = windows.where("wanted").join(twice, ["h", "c"], "left_semi").groupBy("row").agg(F.collect_set("start").alias("starts"))
    removed = removed_text(marked.join(written(starts, "starts"), "row", "left"))
    return prints.select("row", "doc_id", "n_words", "whole_sha256").join(removed, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept_text"
    )
