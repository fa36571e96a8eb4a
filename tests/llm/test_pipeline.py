import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp
from quern.llm import rules
from test_contamination import brute as contaminated_words
from test_minhash import brute as near_groups
from test_pii import brute as base_spans

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = cp.written(cp.quality(spark, docs, SF), "q")
    want = {d: t for d, t in texts(docs).items() if (m := rules.measure_text(t))[0] >= 10 and 100 * m[4] <= 20 * m[0]}
    assert texts(kept) == want and kept.columns == columns
    one = cp.written(cp.near_duplicates(spark, kept, SF), "n")
    groups = near_groups(list(want.items()), 5, 80)
    want = {d: t for d, t in want.items() if groups[d][1] == d}
    assert texts(one) == want and one.columns == columns
    clean = cp.written(cp.decontamination(spark, one, SF), "d")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {d: contaminated_words(t, items, 13) for d, t in want.items()}
    want = {d: t for d, t in want.items() if not (hits[d][1] and 20 * hits[d][1] >= hits[d][0])}
    assert texts(clean) == want and clean.columns == columns
    masked = cp.written(cp.personal_data(spark, clean, SF), "p")
    assert masked.columns == columns and masked.schema == docs.schema
    got = texts(masked)
    assert got.keys() == want.keys()
    for d, t in want.items():
        assert (got[d] == t) or base_spans(t)
        assert not any(t[a:b] in got[d] for a, _, b in base_spans(t))
    pieces = cp.pack(spark, masked, SF).collect()
    assert {p.doc_id for p in pieces} == want.keys()


def test_run_ends_with_pieces(spark):
    rows = cp.run(spark, SF).collect()
    assert rows and all(0 < r.length <= 2048 for r in rows)


def test_odd_rows_pass_through(spark, tmp_path):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, good, "en", "a", 5), (2, good, "en", "a", 5), (None, good + " mail a@b.cd", "en", None, 1), (3, good.replace("w", "v") + " a@b.cd", "en", None, 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, SF), "s")
    got = sorted((r.text for r in docs.collect()), key=len)
    assert len(got) == 2 and any("[EMAIL]" in t for t in got)
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        empty = cp.written(stage(spark, empty, SF), "e")
    assert empty.collect() == []


def test_repeated_rows_without_id_keep_one(spark):
    good, other = (" ".join(f"{w}{i}" for i in range(30)) for w in "wv")
    rows = [(None, good, "en", "a", 1)] * 3 + [(2, other, "en", "a", 1)] * 2 + [(None, other + " end", "en", "a", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, SF).collect()]
    assert len(got) == 2 and (None, good) in got


def test_columns_of_clashing_names_and_repeats(spark):
    words = lambda w: " ".join(f"{w}{i}" for i in range(30))
    base = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, words("a"), "en", "a", 1), (2, words("b") + " x@y.zz", "en", "a", 1), (2, words("b") + " x@y.zz", "en", "a", 1), (3, words("c"), "en", "a", 1)]
    docs = spark.createDataFrame(rows, base)
    names = "spans base cands row kept text_hash hash _id _hash gone_doc_id measures n_words hits items component_id tokens ids".split()
    for k, name in enumerate(names):
        docs = docs.withColumn(name, cp.F.lit(k))
    columns = docs.columns
    for _, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, SF), "s")
        assert docs.columns == columns
    got = docs.collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3]
    assert all(getattr(r, name) == k for r in got for k, name in enumerate(names))
    assert "[EMAIL]" in next(r.text for r in got if r.doc_id == 2)
    assert {r.doc_id for r in cp.pack(spark, docs, SF).collect()} == {1, 2, 3}


def test_null_texts_stay_however_other_rows_repeat(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").schema
    nulls = [(1, None, "en", "a", 1)] * 2
    again = [(2, " ".join(f"w{i}" for i in range(30)), "en", "a", 1)] * 2
    for rows, n in ((nulls, 2), (nulls + again, 3)):
        assert cp.near_duplicates(spark, spark.createDataFrame(rows, base), SF).count() == n
