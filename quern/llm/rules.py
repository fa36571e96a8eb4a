"""Quality rules judged by text and by host.

Every text is measured and held against document rules. Failures are counted by host (``source``); each
host's rate is shrunk towards an empirical beta prior, fitted to all hosts by moments, so that hosts of a few
documents are not judged by chance. Hosts whose shrunk rate passes ``MAX_HOST_RATE`` are rejected, and that
verdict is joined back to their documents.

Null or empty texts have no words and fail. Documents without a source form one host, null. Repeated rows
count and return a row each. An empty table gives no hosts and no rows. No order is involved, so there are no
ties. Very long texts are measured whole, in arrays of some 50 bytes a word; repeated windows are told apart by 64-bit
hashes. Columns beyond those named are ignored, or carried where listed in ``keep``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.hashing import gram_hashes, word_hashes
from quern.sources.scratch import written

MIN_WORDS = 10
#: Per cent of words in repeated windows.
MAX_REPEATED = 20
WINDOW = 5
#: Rates that count against the host, though they alone don't fail a document.
MAX_SYMBOLS_PER_WORD = 0.5
MAX_DUP_LINES_PER_WORD = 0.25
#: A host is rejected where more than this share of its documents fails, after shrinking.
MAX_HOST_RATE = 0.5
#: Hosts whose verdicts are broadcast, some 64 bytes each; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
#: Keys of rejected rows in one broadcast, some 50 bytes each; more are joined by a shuffle.
BROADCAST_KEYS = 200_000

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words covered by windows that the list has twice or more."""
    found = [w.hashes for w in word_hashes(pa.array([" ".join(words)]))]
    return _repeated(found[0], window) if found else 0


def _repeated(hashes: np.ndarray, window: int = WINDOW) -> int:
    grams = gram_hashes(hashes, window)
    if len(grams) < 2:
        return 0
    _, place, counts = np.unique(grams, return_inverse=True, return_counts=True)
    change = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(counts[place] > 1)
    change[starts] += 1
    change[starts + window] -= 1
    return int(np.count_nonzero(np.cumsum(change)))


def measure_texts(texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    """The measures of each text, in their order."""
    found, at = [], 0
    for words in word_hashes(texts):
        low = 0
        for high in words.ends.tolist():
            text = texts[at].as_py() or ""
            lines = [line for line in text.split("\n") if line.strip(SPACES)]
            found.append(
                (
                    high - low,
                    len(text) - sum(map(text.count, SPACES)),
                    sum(map(text.count, SYMBOLS)),
                    len(lines) - len(set(lines)),
                    _repeated(words.hashes[low:high]),
                )
            )
            low, at = high, at + 1
    return found


def measure_text(text: str | None) -> tuple[int, int, int, int, int]:
    """The measures of one text."""
    return measure_texts(pa.array([text], pa.string()))[0]


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The ``keep`` columns and the measures of every row."""
    source = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure_texts(batch.column(1))
            columns = list(zip(*found, strict=True)) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["kept", *MEASURES]
            )

    kept = source.schema["kept"].dataType.simpleString()
    return source.mapInArrow(run, f"kept {kept}, " + ", ".join(f"{m} long" for m in MEASURES)).select("kept.*", *MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def soft_failed() -> Column:
    return (
        base_failed()
        | (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"))
        | (F.col("n_dup_lines") > MAX_DUP_LINES_PER_WORD * F.col("n_words"))
    )


def host_verdicts(measures: DataFrame) -> DataFrame:
    """A row for each host: host, n_docs, n_failed, rate (shrunk), host_rejected."""
    hosts = written(
        measures.groupBy(F.col("source").alias("host")).agg(
            F.count(F.lit(1)).alias("n_docs"), F.count_if(soft_failed()).alias("n_failed")
        ),
        "hosts",
    )
    p = F.col("n_failed") / F.col("n_docs")
    fit = hosts.agg(F.avg(p).alias("m"), F.var_pop(p).alias("v"), F.avg(p * (1 - p) / F.col("n_docs")).alias("noise")).first()
    mean = fit["m"] or 0.0
    spread = max((fit["v"] or 0.0) - (fit["noise"] or 0.0), 1e-6)
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4)
    rate = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    return hosts.withColumn("rate", rate).withColumn("host_rejected", F.col("rate") > MAX_HOST_RATE)


def judged(measures: DataFrame, hosts: DataFrame) -> DataFrame:
    """``measures`` with base_failed, rate and kept."""
    verdicts = hosts.select("host", "rate", "host_rejected")
    if hosts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    return (
        measures.withColumn("base_failed", base_failed())
        .join(verdicts, F.col("source").eqNullSafe(F.col("host")), "left")
        .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))
        .drop("host", "host_rejected")
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, source, measures, base_failed, rate and kept for every row of ``docs``."""
    measures = written(measured(docs), "measures")
    return judged(measures, host_verdicts(measures))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, in all their columns; texts are measured once."""
    keyed = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash"))
    measures = written(measured(keyed, keep=("doc_id", "source", "text_hash")), "measures")
    keys = ("doc_id", "source", "text_hash")
    gone = judged(measures, host_verdicts(measures)).where(~F.col("kept")).select(*(F.col(k).alias(f"gone_{k}") for k in keys)).distinct()
    gone = written(gone, "rejected")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    same = F.col("doc.doc_id").eqNullSafe(F.col("gone_doc_id")) & F.col("doc.source").eqNullSafe(F.col("gone_source")) & (F.xxhash64("doc.text") == F.col("gone_text_hash"))
    return docs.select(F.struct("*").alias("doc")).join(gone, same, "left_anti").select("doc.*")
