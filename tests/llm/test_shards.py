import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import queries, shards

TREE = shards.even_tree(2, 3, 4)
SF = "/root/testdata/sf0.001"


def placed(spark, keys, tree):
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    return {r.k: r.s for r in rows.select("k", shards.descended(F.col("k"), tree).alias("s")).collect()}


def test_nulls_repeats_empty_and_long_texts(spark):
    rows = [(1, "a"), (1, "a"), (1, None), (None, "b"), (None, "b"), (None, None), (2, ""), (3, "é" * 300_000)]
    docs = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "doc_id long, text string, size long, slot int, _key int").repartition(5)
    got = shards.shards(docs, TREE, shards.grown(TREE)).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for shard in {r.shard for r in got}:
        mine = sorted(((r.slot, (r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32)) for r in got if r.shard == shard))
        assert [s for s, _ in mine] == list(range(len(mine)))
        assert [k for _, k in mine] == sorted(k for _, k in mine)
    assert len({(r.shard, r.grown_shard) for r in got if r.doc_id is None}) == 1
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert shards.shards(docs.limit(0), TREE).collect() == []
    assert {r.grown_shard for r in shards.shards(docs, TREE).collect()} == {None}


def test_slots_of_a_hot_key_over_many_partitions(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text")).repartition(13)
    got = shards.shards(docs, TREE).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()
    assert sum(r.n for r in got) == 3000 and len(got) == 24
    assert all(r.n == r.d == r.high + 1 and r.low == 0 for r in got)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    keys = [str(i) for i in range(4000)]
    for n in (0, 1, 2):
        before, after = placed(spark, keys, shards.grown(TREE, n)), placed(spark, keys, shards.grown(TREE, n + 1))
        moved = [k for k in keys if before[k] != after[k]]
        assert {after[k] for k in moved} == {24 + n}
        assert abs(len(moved) - 4000 / (25 + n)) < 50


def test_weights_hold_and_movement_stays_below_changed_weights(spark):
    keys = [str(i) for i in range(6000)]
    tree = {"a": {"x": {"1": 1.0, "2": 3.0}, "y": {"1": 2.0}}, "b": {"x": {"1": 4.0}}, "c": {"x": {"1": 1.0, "2": 1.0}}}
    share = Counter(placed(spark, keys, tree).values())
    for number, weight in enumerate((1, 3, 2, 4, 1, 1)):
        assert abs(share[number] - 6000 * weight / 12) < 6000 * 0.03
    heavier = tree | {"a": {"x": {"1": 1.0, "2": 5.0}, "y": {"1": 2.0}}}
    before, after = placed(spark, keys, tree), placed(spark, keys, heavier)
    for k in keys:
        if before[k] != after[k]:
            assert after[k] in (0, 1, 2)  # into the region whose weight has risen
            if before[k] in (0, 1, 2):
                assert (before[k], after[k]) in ((0, 1), (2, 0), (2, 1))  # and there into the rack and shard that have


def test_trees_are_checked():
    for bad in ({}, {"a": {}}, {"a": {"b": {}}}, {"a": {"b": {"c": 0.0}}}, {"a/": {"b": {"c": 1.0}}}):
        with pytest.raises(ValueError):
            shards.checked(bad)
    with pytest.raises(ValueError):
        shards.grown({"grown1": {"r": {"s": 1.0}}})


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    result = con.execute(queries.ORACLE_SQL["op13_sharding"])
    names = [c[0] for c in result.description]
    got = queries.QUERIES["op13_sharding"](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(result.fetchall())
