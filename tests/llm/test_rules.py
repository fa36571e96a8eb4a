from quern.llm import rules


def test_measures():
    assert rules.measure_text(None) == rules.measure_text("") == (0, 0, 0, 0, 0)
    assert rules.measure_text("a\u00a0b c|#\n\nc|#\nx") == (4, 10, 4, 0, 0)
    assert rules.measure_text("one two\none two\n \n\t\none two ")[3] == 1
    assert rules.repeated_words("a b c d e f a b c d e".split()) == 10
    assert rules.repeated_words(["a"] * 7) == 7


def test_hosts_are_judged_with_shrinkage(spark):
    good = " ".join(f"w{i}" for i in range(20))
    rows = [(i, good, "good") for i in range(60)] + [(100 + i, "bad", "junk") for i in range(60)]
    rows += [(200, good, "junk"), (300, "bad", "small"), (301, good, "small"), (302, good, None), (303, None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, kept int")
    got = {r.doc_id: r for r in rules.quality_rules(docs).collect()}
    assert len(got) == len(rows)
    assert got[0].kept and not got[100].kept
    assert not got[200].base_failed and not got[200].kept
    assert got[302].kept and not got[303].kept
    kept = rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert rules.quality_rules(docs).collect() == []
