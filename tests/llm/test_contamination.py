import re

from quern.llm import contamination as c

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))


def brute(text, items, width):
    ws, hit, ids = words(text), set(), set()
    for item, body in items:
        bw = words(body)
        for i in range(max(1, len(bw) - width + 1)) if bw else ():
            win = bw[i : i + width]
            for at in range(len(ws) - len(win) + 1):
                if ws[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    ids.add(item)
    return len(ws), len(hit), sorted(ids)


def test_against_brute_force(spark):
    items = [(1, "The quick brown Fox jumps"), (2, "Été à Paris ÉTÉ"), (3, "ok"), (4, ""), (5, None), (6, "quick brown fox"), (6, "quick brown fox")]
    texts = ["the QUICK, brown fox jumps the quick brown fox", "été à paris Été", "Été à paris ÉTÉ ok", "", None, "...", "ok ok ok", "x" * 50000 + " ok", "ok ok ok"]
    docs = spark.createDataFrame([(i, t, "a", 0) for i, t in enumerate(texts)], "doc_id long, text string, row string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in c.contamination(docs, bench, width=3).withColumn("n_hit", c.hit_words(c.F.col("hits"))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert (got[i].n_words, got[i].n_hit, sorted(got[i]["items"])) == brute(text, items, 3), text


def test_passes_of_bounded_broadcasts_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(str, c.contamination(docs, bench).collect()))
    monkeypatch.setattr(c, "BROADCAST_BYTES", 20_000)
    assert sorted(map(str, c.contamination(docs, bench).collect())) == whole


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert c.contamination(docs, bench).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in c.contamination(one, bench).collect()] == [(1, 2, [], [])]
