import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from quern.llm import toxicity
from quern.llm.queries import op3_toxicity


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op3_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in seen) / len(seen) > 0.96
    toxic = [p for p, y in seen if y]
    assert sum(toxic) / len(toxic) > 0.8


def test_held_out_labels_are_not_learnt_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.fold_of(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = (sorted((r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, flipped))
    assert first == second


def test_odd_rows(spark):
    words = "fine good calm warm kind".split()
    texts = [(i, " ".join(words[: i % 5 + 1] * 8) + (" vile wretch" * 3 if i % 3 == 0 else ""), 1) for i in range(300)]
    odd = [(None, "vile wretch", 1), (900, None, 1), (901, "", 1), (902, "x" * 40000, 1), (5, texts[5][1], 1)]
    docs = spark.createDataFrame(texts + odd, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(900, 1), (None, 1), (7, None), (8, 0), (8, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(texts) + len(odd)
    assert all(0 <= r.score <= 1 for r in got)
    right = sum((r.score >= 0.5) == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 300)
    assert right >= 299


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs.limit(0), none).collect() == []


def test_bound_of_the_broadcast_changes_no_score(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    scores = lambda: sorted((r.doc_id, round(r.score, 6)) for r in toxicity.toxicity(docs, labels).collect())
    whole = scores()
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 100)
    assert scores() == whole
    monkeypatch.setattr(toxicity, "BROADCAST_WEIGHTS", 0)
    assert scores() == whole
    monkeypatch.setattr(toxicity, "MODEL_ROWS", 0)
    assert scores() == whole


def test_rare_words_weigh(spark):
    sums = ", ".join(f"{k} long" for k in toxicity.WORD_SUMS)
    rows = [(word, 0, 0, 0, 0, 0, 0, toxic, ordinary, toxic + ordinary) for word, toxic, ordinary in ((1, 99, 101), (2, 2, 0), (3, 0, 2), (4, 50, 5000), (5, 0, 200), (6, 99, 0), (7, 1, 0))]
    words = spark.createDataFrame(rows, "word long, " + sums)
    pairs = spark.createDataFrame([], "first long, second long, toxic long, ordinary long")
    got = {r.key: r.x for r in toxicity.weights(words, pairs, {"toxic": 1.0, "ordinary": 1.0}).collect()}
    assert got[6] > got[2] > 0 > got[3] > got[5] and got[1] > got[4] > got[5] and 7 not in got


def plain_scores(docs, labels):
    """The same models from dictionaries of words."""
    pattern = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")
    words = [(i, pattern.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))) for i, text in docs]
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in labels}
    counts = [Counter(), Counter()]
    for i, w in words:
        if i in labels and fold[i] not in (0, 4):
            counts[labels[i]].update(zip([""] + w, w))
    left, n, followers, once = ([Counter(), Counter()] for _ in range(4))
    shared = Counter(b for a, b in set(counts[0]) | set(counts[1]))
    for y in (0, 1):
        for (a, b), k in counts[y].items():
            left[y][b] += 1
            n[y][a] += k
            followers[y][a] += 1
            once[y][a] += k == 1

    def discount(values):
        k = Counter(values)
        return 1.0 if not k[1] or not k[2] else min(1.5, max(0.5, 2 - 3 * k[1] / (k[1] + 2 * k[2]) * k[3] / k[2]))

    lower_d, pair_d = ([discount(c[y].values()) for y in (0, 1)] for c in (left, counts))
    total = [max(sum(left[y].values()), 1) for y in (0, 1)]
    given = [max(sum(1 if k == 1 else lower_d[y] for k in left[y].values()), 1.0) / total[y] for y in (0, 1)]
    own = lambda y, b: (left[y][b] - lower_d[y]) / total[y] if left[y][b] > 1 else 0.0
    share = lambda b: shared[b] / sum(shared.values())
    back = lambda y, a: (once[y][a] + pair_d[y] * (followers[y][a] - once[y][a])) / n[y][a] if n[y][a] else 1.0

    def lower(b):
        return math.log((own(1, b) / given[1] + share(b)) / (own(0, b) / given[0] + share(b))) if shared[b] else 0.0

    def both(a, b):
        value = math.log(back(1, a) / back(0, a)) + lower(b)
        if max(counts[0][a, b], counts[1][a, b]) > 1:
            p = [own(y, b) + given[y] * share(b) for y in (0, 1)]
            q = [((counts[y][a, b] - pair_d[y]) / n[y][a] / back(y, a) if counts[y][a, b] > 1 else 0.0) + p[y] for y in (0, 1)]
            value += math.log(q[1] / q[0]) - math.log(p[1] / p[0])
        return value

    def features(w):
        if not w:
            return [0.0] * toxicity.FEATURES
        found = []
        for values in (
            [lower(b) if shared[b] >= 5 else 0 for b in w],
            [lower(b) if shared[b] < 5 else 0 for b in w],
            [both(a, b) for a, b in zip([""] + w, w)],
        ):
            found.append(sum(values) / len(w))
            for k in (min(k, len(w)) for k in (1, 4, 8)):
                found.append(max(sum(values[i : i + k]) for i in range(len(w) - k + 1)) / k)
        return found

    model = toxicity.Model(*(np.zeros(0, t) for t in (np.uint64, float, float, bool)))
    sample = [(features(w), labels[i]) for i, w in words if i in labels and fold[i] == 4]
    model.fit(np.array([x for x, _ in sample]), np.array([y for _, y in sample], float))
    return {i: float(model.scores(np.array([features(w)]))[0]) for i, w in words}


def test_scores_equal_those_of_plain_dictionaries(spark):
    random.seed(7)
    bag = "the of and to in is was you are so a it that for on".split() + [f"w{k}" for k in range(40)]
    docs, labels = [], {}
    for i in range(400):
        words = random.choices(bag, k=random.randint(1, 60))
        labels[i] = int(random.random() < 0.3)
        if labels[i]:
            words += random.choices(["vile", "wretch", "you are vile", "Scum"], k=3)
        docs.append((i, " ".join(words)))
    docs += [(1000, None), (1001, ""), (1002, "nothing known here"), (1003, docs[3][1])]
    want = plain_scores(docs, labels)
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    assert {r.doc_id for r in got.collect()} == set(want)
    assert max(abs(r.score - want[r.doc_id]) for r in got.collect()) < 1e-3


def test_counts_cover_all_rows_but_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "fine good calm" + (" vile" if i % 3 == 0 else "")) for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(500)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "FIT_ROWS", 50)
    seen = []
    counts = toxicity.pair_counts
    monkeypatch.setattr(toxicity, "pair_counts", lambda rows: seen.append(rows.count()) or counts(rows))
    model = toxicity.learn(docs, labels)
    assert model is not None
    assert seen[0] + 80 > sum(not held(i) for i in range(500)) > seen[0]
