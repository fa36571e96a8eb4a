import hashlib
import random

from pyspark.sql import functions as F

from quern.llm import passages
from quern.llm.passages import WINDOW, FingerprintIndex, fingerprints


def brute(rows):
    words = [(t or "").encode().split() for _, t in rows]
    seen = {}
    for r, w in enumerate(words):
        for i in range(len(w) - WINDOW + 1):
            seen.setdefault(tuple(w[i : i + WINDOW]), []).append((r, i))
    gone = [set() for _ in rows]
    for at in seen.values():
        if len(at) > 1:
            for r, i in at:
                gone[r].update(range(i, i + WINDOW))
    return [(len(w), len(g), b" ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(words, gone, strict=True)]


def corpus(seed):
    rnd = random.Random(seed)
    new = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    shared = [new(n) for n in (34, 35, 36, 60, 90, 200)]
    texts = [None, "", " ", "a " * 100, "a " * 34, "x y " * 60]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            parts += new(rnd.choice([0, 1, 10, 80]))
            if rnd.random() < 0.6:
                p = rnd.choice(shared)
                low = rnd.randrange(max(1, len(p) - 40))
                parts += p[low : low + rnd.choice([35, 36, 50, 400])]
        texts.append(rnd.choice([" ", "\n", "  "]).join(parts))
    return texts + texts[10:20] + texts[10:12]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = list(enumerate(corpus(seed)))
        docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, print int")
        got = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
        assert len(got) == len(rows)
        for (d, text), (n, gone, kept) in zip(rows, brute(rows), strict=True):
            assert (got[d].n_words, got[d].n_removed) == (n, gone), d
            assert got[d].kept_sha256 == hashlib.sha256(kept).hexdigest()
            if gone:
                assert got[d].kept_text == kept.decode()


def test_repeated_rows_repeat_each_other(spark):
    text = " ".join(f"v{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + " end"), (2, "short")], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in passages.repeated_passages(docs).collect())
    assert got == [(1, 0), (50, 50), (50, 50), (51, 50)]


def test_index_finds_what_history_has(spark):
    same = " ".join(f"h{i}" for i in range(60))
    other = " ".join(f"o{i}" for i in range(60))
    third = " ".join(f"t{i}" for i in range(60))
    index = FingerprintIndex(spark)
    batch = lambda *texts: fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert index.add(batch(same)).count() == 0
    assert index.add(batch(other)).count() == 0
    assert len(index.runs) == 2
    assert index.add(batch(third, same)).count() > 0
    assert len(index.runs) == 1  # compacted
    assert index.add(batch(other)).count() > 0
    assert index.entries().where("n > 2").count() == 0


def test_empty_table(spark):
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_later_sessions_add_to_an_index(spark, tmp_path):
    words = lambda w, n: " ".join(f"{w}{i}" for i in range(n))
    docs = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = lambda *texts: passages.written(passages.fingerprints(docs(*texts)), "prints")
    folder = str(tmp_path / "index")
    first = passages.FingerprintIndex(spark, folder, 4)
    assert first.add(prints(words("a", 60), words("b", 60))).collect() == []
    later = passages.open_index(spark.newSession(), folder)
    assert later.buckets == 4 and len(later.runs) == 1
    shared = later.add(prints(words("a", 60), words("c", 60)))
    assert {r.print for r in shared.collect()} == {p.print for p in prints(words("a", 60)).first().prints}
    again = passages.open_index(spark, folder)
    assert again.add(prints(words("c", 50), words("d", 40))).count() > 0 and len(again.runs) == 1
    total = passages.open_index(spark, folder).entries().agg({"n": "sum"}).first()[0]
    assert total == sum(p.n for w in "abacd" for p in prints(words(w, 60 if w != "d" else 40)).first().prints) + sum(p.n for p in prints(words("c", 50)).first().prints)


def test_history_is_joined_without_shuffling_it(spark, tmp_path):
    index = passages.FingerprintIndex(spark, str(tmp_path / "index"), 4)
    rows = spark.range(200).select(F.array(F.struct(F.col("id").alias("print"), F.col("id").alias("stretch"), F.lit(1).cast("long").alias("n"))).alias("prints"))
    index.add(rows)
    index.add(rows)
    a, b = index.runs
    plan = a.hint("merge").join(b, "print", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
