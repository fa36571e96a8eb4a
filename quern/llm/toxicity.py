"""Toxicity by class-conditional Kneser-Ney models of words.

Words are runs of ASCII letters and digits and of characters beyond ASCII; A-Z lower-cased. Each class has a bigram
model: counts of a word after the word before it, less a discount, back off to the class's continuation counts (in how
many different left contexts it has the word), and these, less a discount, to continuation counts that both classes
share. A pair or word that a class has once gives its whole count to the backoff; the discounts of the others follow
from the counts of counts. Likelihoods of single words are divided by what the class gives to the shared counts, so that
unseen words weigh nothing for either class.

A text is compared by length-normalised log-likelihoods under both classes: of the bigram models over the whole text
and over its most toxic runs of words, and of their lower order alone, once for words of ``RARE`` contexts or more and
once for rarer ones. A logistic function of these, fitted to a bounded sample of at most ``FIT_ROWS`` (expected)
labelled rows that the counts leave out, gives the score.

Counts cover all training rows but the sample, at every size. Where the models have more than ``MODEL_ROWS`` words and
pairs, the most frequent ones are broadcast, and texts' others are joined to the table of the rest. Rows of the
held-out fold are left out before anything is counted. Labels of one doc_id are joined by the greatest. Null and empty
texts have no words and get the score of no evidence. Very long texts are scored whole; a row is held by one task.
Without labelled rows of both classes, as in empty tables, all scores are 0. Repeated rows count and give a row each.
No order is involved but that of words, so there are no ties. Columns not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.hashing import word_hashes
from quern.sources.scratch import written

#: Words of the runs that are sought.
RUNS = (1, 4, 8)
#: Words of fewer left contexts have features of their own, so that the logistic function learns what they are worth.
RARE = 5
#: Words and pairs in one broadcast, 17 bytes each.
MODEL_ROWS = 1 << 22
#: Weights of rarer expressions of texts in one broadcast; more are joined by a shuffle.
BROADCAST_WEIGHTS = 500_000
FIT_ROWS = 20_000
#: Labels in one broadcast, 16 bytes each; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Fold (crc32 of doc_id mod 5) that is never learnt from, and the one of which the logistic function's sample is drawn.
HELD_OUT, FIT_FOLD = 0, 4
#: The word before the first one.
START = 0x9E3779B97F4A7C15
CLASSES = ("toxic", "ordinary")
FEATURES = 3 * (1 + len(RUNS))

_SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def fold_of(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(-1))


def _texts(array: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of the words, text by text."""
    for words in word_hashes(array, fold=True, separators=_SEPARATORS):
        low = 0
        for high in words.ends.tolist():
            yield words.hashes[low:high]
            low = high


def _before(hashes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.full(1, START, np.uint64), hashes[:-1]])


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Keys of each word with the one before it."""
    before = _before(hashes)
    return (before << np.uint64(1) | before >> np.uint64(63)) ^ hashes


def pair_key(first: Column, second: Column) -> Column:
    """The same keys as columns."""
    return F.shiftleft(first, 1).bitwiseOR(F.shiftrightunsigned(first, 63)).bitwiseXOR(second)


def pair_counts(labelled: DataFrame) -> DataFrame:
    """first, second (hashes) and how often texts of either class have them as neighbours, of text, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy()
            texts = [(h, label) for h, label in zip(_texts(batch.column(0)), labels, strict=True) if len(h)]
            if not texts:
                continue
            keys, firsts, seconds = (np.concatenate([f(h) for h, _ in texts]) for f in (_pairs, _before, lambda h: h))
            kind = np.concatenate([np.full(len(h), label, np.int64) for h, label in texts])
            order = np.argsort(keys)
            keys, kind = keys[order], kind[order]
            at = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(firsts[order][at].view(np.int64)),
                    pa.array(seconds[order][at].view(np.int64)),
                    pa.array(np.add.reduceat(kind, at)),
                    pa.array(np.add.reduceat(1 - kind, at)),
                ],
                names=["first", "second", *CLASSES],
            )

    found = labelled.select("text", F.col("label").cast("long").alias("label")).mapInArrow(run, "first long, second long, toxic long, ordinary long")
    return found.groupBy("first", "second").agg(*(F.sum(c).alias(c) for c in CLASSES))


WORD_SUMS = [f"{s}_{c}" for s in ("n", "types", "once", "left") for c in CLASSES] + ["left"]


def statistics(pairs: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Of pair_counts: words with their ``WORD_SUMS``, pairs that a class has twice or more, and the discounts of pairs.

    n, types, once: counts, different followers and those seen once of a word as context; left: its different left
    contexts. All come from one pass over the counts, which are not written whole.
    """
    zero = F.lit(0).cast("long")
    one = lambda c: c.cast("long")
    as_first = [F.col(c) for c in CLASSES] + [one(F.col(c) > 0) for c in CLASSES] + [one(F.col(c) == 1) for c in CLASSES] + [zero] * 3
    as_second = [zero] * 6 + [one(F.col(c) > 0) for c in CLASSES] + [F.lit(1).cast("long")]
    row = lambda word, sums: F.struct(word.alias("word"), *(v.alias(k) for k, v in zip(WORD_SUMS, sums, strict=True)))
    words = pairs.select(F.inline(F.array(row(F.col("first"), as_first), row(F.col("second"), as_second)))).groupBy("word").agg(*(F.sum(k).alias(k) for k in WORD_SUMS))
    kinds = words.select(F.lit(0).alias("kind"), F.col("word").alias("first"), zero.alias("second"), F.array(*WORD_SUMS).alias("sums"))
    twice = pairs.where(F.greatest(*CLASSES) > 1).select(F.lit(1).alias("kind"), "first", "second", F.array(*CLASSES).alias("sums"))
    seen = pairs.agg(F.array(*(F.count_if(F.col(c) == k) for c in CLASSES for k in (1, 2, 3))).alias("sums")).select(F.lit(2).alias("kind"), zero.alias("first"), zero.alias("second"), "sums")
    made = written(kinds.unionByName(twice).unionByName(seen), "statistics")
    counts = made.where("kind = 2").first()["sums"]
    words = made.where("kind = 0").select(F.col("first").alias("word"), *(F.col("sums")[i].alias(k) for i, k in enumerate(WORD_SUMS)))
    again = made.where("kind = 1").select("first", "second", *(F.col("sums")[i].alias(c) for i, c in enumerate(CLASSES)))
    return words, again, {c: discount(*counts[3 * i : 3 * i + 3]) for i, c in enumerate(CLASSES)}


def discount(once: int, twice: int, thrice: int) -> float:
    """What is taken from counts of two or more."""
    if not once or not twice:
        return 1.0
    return min(1.5, max(0.5, 2 - 3 * once / (once + 2 * twice) * thrice / twice))


def _less(n: Column, d: float) -> Column:
    """A count less its discount; one seen once gives all."""
    return F.when(n > 1, n - F.lit(d)).otherwise(0.0)


def weights(words: DataFrame, pairs: DataFrame, of_pairs: dict[str, float]) -> DataFrame:
    """key, x, y, rare and n of words and pairs that weigh for a class.

    A word's x is its log ratio under the lower order, y that of the backoffs of pairs that begin with it; a pair's x is
    what its own counts add to these.
    """
    sums = words.agg(
        F.sum("left").alias("left"),
        *(F.sum(f"left_{c}").alias(c) for c in CLASSES),
        *(F.count_if(F.col(f"left_{c}") == k).alias(f"{c}_{k}") for c in CLASSES for k in (1, 2, 3)),
        *(F.count_if(F.col(f"left_{c}") > 1).alias(f"{c}_more") for c in CLASSES),
    ).first()
    share = F.greatest(F.col("left"), F.lit(1)) / F.lit(float(max(sums["left"] or 0, 1)))
    own, given, shrunk = {}, {}, {}
    for c in CLASSES:
        d, total = discount(*(sums[f"{c}_{k}"] for k in (1, 2, 3))), max(sums[c] or 0, 1)
        given[c] = max(sums[f"{c}_1"] + d * sums[f"{c}_more"], 1.0) / total
        own[c] = _less(F.col(f"left_{c}"), d) / total
        kept = F.col(f"once_{c}") + of_pairs[c] * (F.col(f"types_{c}") - F.col(f"once_{c}"))
        shrunk[c] = F.when(F.col(f"n_{c}") > 0, kept / F.col(f"n_{c}")).otherwise(1.0)
    relative = [own[c] / given[c] + share for c in CLASSES]
    stats = written(
        words.select(
            "word",
            F.log(relative[0] / relative[1]).alias("x"),
            F.log(shrunk["toxic"] / shrunk["ordinary"]).alias("y"),
            "left",
            *(F.col(f"n_{c}") for c in CLASSES),
            *(shrunk[c].alias(f"back_{c}") for c in CLASSES),
            *((own[c] + given[c] * share).alias(f"lower_{c}") for c in CLASSES),
        ),
        "words",
    )
    context = stats.select(F.col("word").alias("first"), *(f"n_{c}" for c in CLASSES), *(f"back_{c}" for c in CLASSES))
    lower = stats.select(F.col("word").alias("second"), *(f"lower_{c}" for c in CLASSES))
    whole = {c: _less(F.col(c), of_pairs[c]) / F.greatest(F.col(f"n_{c}"), F.lit(1)) / F.col(f"back_{c}") + F.col(f"lower_{c}") for c in CLASSES}
    gain = F.log(whole["toxic"] / whole["ordinary"]) - F.log(F.col("lower_toxic") / F.col("lower_ordinary"))
    joined = pairs.join(context, "first").join(lower, "second")
    found = joined.select(pair_key(F.col("first"), F.col("second")).alias("key"), gain.cast("float").alias("x"), F.lit(0).cast("float").alias("y"), F.lit(False).alias("rare"), (F.col("toxic") + F.col("ordinary")).alias("n"))
    single = stats.where((F.abs("x") > 1e-9) | (F.abs("y") > 1e-9)).select(
        F.col("word").alias("key"), F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), (F.col("left") < RARE).alias("rare"), F.greatest(F.col("n_toxic") + F.col("n_ordinary"), F.col("left")).alias("n")
    )
    return single.unionByName(found)


class Model:
    """Sorted keys of the most frequent words and pairs with their weights, and the weights of the logistic function.

    ``rest`` has key, x, y, rare and n of all others; None where there are none.
    """

    def __init__(self, *columns: np.ndarray):
        self.table = _sorted(*columns)
        self.mean, self.scale, self.weights = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1)
        self.rest: DataFrame | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}

    def lacks(self, hashes: np.ndarray) -> np.ndarray:
        """Those distinct words and pairs of a text that are not among the keys."""
        asked = np.unique(np.concatenate([np.full(1, START, np.uint64), hashes, _pairs(hashes)]))
        return asked[_places(self.table, asked)[1]]

    def features(self, hashes: np.ndarray, others: tuple[np.ndarray, ...] | None = None) -> list[float]:
        """Of one text; ``others`` are sorted keys and weights of its words and pairs that are in ``rest``."""
        if not len(hashes):
            return [0.0] * FEATURES
        asked = np.concatenate([np.full(1, START, np.uint64), hashes, _pairs(hashes)])
        x, y, rare = _looked_up(self.table, asked)
        if others is not None:
            more = _looked_up(others, asked)
            x, y, rare = x + more[0], y + more[1], rare | more[2]
        n = len(hashes)
        lower, low = x[1 : n + 1], rare[1 : n + 1]
        found: list[float] = []
        for values in (np.where(low, 0, lower), np.where(low, lower, 0), y[:n] + lower + x[n + 1 :]):
            sums = np.concatenate([[0.0], np.cumsum(values)])
            found.append(sums[-1] / n)
            for run in (min(run, n) for run in RUNS):
                found.append((sums[run:] - sums[:-run]).max() / run)
        return found

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge-penalised logistic regression by Newton steps."""
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        penalty = np.diag([1.0] * FEATURES + [1e-3])
        w = np.zeros(FEATURES + 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sorted(keys: np.ndarray, x: np.ndarray, y: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    return keys[order], x[order], y[order], rare[order]


def _places(table: tuple[np.ndarray, ...], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sorted keys have ``asked``, and which of these are missing."""
    keys = table[0]
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.ones(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] != asked


def _looked_up(table: tuple[np.ndarray, ...], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and rare by sorted keys; 0 where there is none."""
    at, missing = _places(table, asked)
    if not len(table[0]):
        return np.zeros(len(asked)), np.zeros(len(asked)), np.zeros(len(asked), bool)
    x, y = (np.where(missing, 0.0, c[at]).astype(np.float64) for c in table[1:3])
    return x, y, table[3][at] & ~missing


def _model(weighed: DataFrame) -> Model | None:
    """The model of all weights."""
    weighed = written(weighed, "weights").withColumn("size", F.floor(F.log2("n")))
    sizes = {r["size"]: r["count"] for r in weighed.groupBy("size").count().collect()}
    if not sizes:
        return None
    least, rows = max(sizes) + 1, 0
    while least > 0 and rows + sizes.get(least - 1, 0) <= MODEL_ROWS:
        least -= 1
        rows += sizes.get(least, 0)
    table = weighed.where(F.col("size") >= least).select("key", "x", "y", "rare").toArrow()
    model = Model(table["key"].to_numpy().view(np.uint64), *(table[c].to_numpy() for c in ("x", "y", "rare")))
    if least > 0:
        model.rest = weighed.where(F.col("size") < least).drop("size")
    return model


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label and fold of labelled rows that may be learnt from."""
    known = _known(labels)
    known = F.broadcast(known) if labels.count() <= BROADCAST_LABELS else known
    return docs.select("doc_id", "text").join(known, "doc_id")


def _known(labels: DataFrame) -> DataFrame:
    """doc_id, label and fold of labels that may be learnt from."""
    return (
        labels.select("doc_id", "toxic", fold_of(F.col("doc_id")).alias("fold"))
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.col("fold") != HELD_OUT))
        .groupBy("doc_id", "fold")
        .agg(F.max((F.col("toxic") != 0).cast("int")).alias("label"))
    )


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of ``docs`` (doc_id, text) under ``labels`` (doc_id, toxic); None without both classes."""
    labelled = _labelled(docs, labels)
    sizes = _known(labels).groupBy("label").count().collect()
    if len(sizes) < 2:
        return None
    share = min(1.0, FIT_ROWS * 4 / sum(r["count"] for r in sizes))
    drawn = (F.col("fold") == FIT_FOLD) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    model = _model(weights(*statistics(pair_counts(labelled.where(~drawn).select("text", "label")))))
    if model is None:
        return None
    fit = labelled.where(drawn)
    rows = _featured(fit.select(F.col("label").cast("long").alias("kept"), "text"), model).toArrow()
    x = np.array(rows["features"].to_pylist(), float).reshape(-1, FEATURES)
    y = rows["kept"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    model.fit(x, y)
    return model


def _rare_weights(rows: DataFrame, model: Model) -> DataFrame:
    """hash of the text and its words and pairs, with their weights, that the broadcast leaves out.

    Texts of equal hash get the expressions of all of them, each of its right weight.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [shared.value.lacks(hashes) for hashes in _texts(batch.column(1))]
            if keys:
                hashes = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.concatenate(keys).view(np.int64))], names=["hash", "key"])

    found = rows.select(F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "hash long, key long").join(model.rest, "key")
    parts = ("key", "x", "y", "rare")
    return written(found.groupBy("hash").agg(F.collect_set(F.struct(*parts)).alias("found")).select("hash", *(F.col(f"found.{p}").alias(p) for p in parts)), "rare")


def _featured(rows: DataFrame, model: Model, scored: bool = False) -> DataFrame:
    """kept and features (or the score) of ``rows`` (kept, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = shared.value
            if batch.num_columns == 2:
                found = [model.features(hashes) for hashes in _texts(batch.column(1))]
            else:
                found = []
                for hashes, *others in zip(_texts(batch.column(1)), *batch.columns[2:], strict=True):
                    parts = [c.values.to_numpy(zero_copy_only=False) for c in others if c.is_valid]
                    found.append(model.features(hashes, _sorted(parts[0].view(np.uint64), *parts[1:]) if parts else None))
            made = pa.array(model.scores(np.array(found, float).reshape(-1, FEATURES))) if scored else pa.array(found, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["kept", "score" if scored else "features"])

    if model.rest is not None:
        rare = _rare_weights(rows, model)
        held = rare.agg(F.sum(F.size("key"))).first()[0] or 0
        rare = F.broadcast(rare) if held <= BROADCAST_WEIGHTS else rare
        rows = rows.withColumn("hash", F.xxhash64("text")).join(rare, "hash", "left").select("kept", "text", "key", "x", "y", "rare")
    return rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, {'score double' if scored else 'features array<double>'}")


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and score (0 to 1) of every row of ``docs``."""
    model = learn(docs, labels)
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    source = docs.select(F.struct(*keep).alias("kept"), F.col("text").cast("string").alias("text"))
    return _featured(source, model, scored=True).select("kept.*", "score")
