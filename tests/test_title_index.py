"""The title index over sessions, and against ranking without one."""

import pytest
from pyspark.sql import functions as F

from quern.operators import ranking, title_index
from quern.sources import publication


def titles(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def found(df):
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in df.collect())


def test_index_ranks_as_the_plain_query_does(spark, tmp_path):
    docs = spark.range(300).select("id", F.concat_ws(" ", F.lit("law"), *(F.concat(F.lit(w), (F.col("id") % m).cast("string")) for w, m in (("a", 3), ("b", 7), ("c", 50)))).alias("text"))
    docs = docs.select(F.col("id").alias("doc_id"), "text").unionByName(titles(spark, (-5, "b6 alone"), (900, None), (901, ""), (None, "a1 b2"), (7, "a1 b0 again")))
    asked = spark.createDataFrame([(1, "a1 b2 c40"), (2, "LAW alone"), (3, "nothing like it"), (4, None)], "query_id long, text string")
    assert title_index.build(docs, str(tmp_path), "r1", width=100) == 5
    got = found(title_index.search(spark, str(tmp_path), asked, 5))
    assert got and got == found(ranking.bm25(asked, docs.where("doc_id is not null"), 5))


def test_a_broken_build_goes_on_and_a_new_revision_takes_over(spark, tmp_path, monkeypatch):
    docs = titles(spark, (1, "red fox"), (11, "red hen"), (21, "blue fox"))
    asked = spark.createDataFrame([(1, "red")], "query_id long, text string")

    def broken(*args, **more):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(publication, "publish", broken)
        with pytest.raises(OSError):
            title_index.build(docs.where("doc_id < 20"), str(tmp_path), "r1", width=10)
    assert title_index.build(docs, str(tmp_path), "r1", width=10) == 1
    assert [r[1] for r in found(title_index.search(spark, str(tmp_path), asked, 5))] == [1, 11]
    assert title_index.build(docs, str(tmp_path), "r1", width=10) == 0
    title_index.build(docs.where("doc_id = 11"), str(tmp_path), "r2", width=10)
    assert [r[1] for r in found(title_index.search(spark, str(tmp_path), asked, 5))] == [11]


def test_empty_tables_and_scattered_ids(spark, tmp_path, monkeypatch):
    asked = spark.createDataFrame([(1, "red")], "query_id long, text string")
    assert title_index.build(titles(spark, (1, "red")).where("false"), str(tmp_path), "r1") == 0
    assert found(title_index.search(spark, str(tmp_path), asked, 5)) == []
    monkeypatch.setattr(title_index, "MOST_RUNS", 2)
    assert title_index.build(titles(spark, (1, "red a"), (11, "b"), (21, "red c"), (-900, "d")), str(tmp_path), "r2", width=10) == 2
    assert [r[1] for r in found(title_index.search(spark, str(tmp_path), asked, 5))] == [1, 21]
