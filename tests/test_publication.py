"""Published tables, artifacts and the batch sink under writers that die."""

import json

import pytest
from pyspark.sql import functions as F

from quern.sources import batch_sink, records
from quern.sources import publication as P

STEPS = ("staged", "stored", "claimed", "pointed")


def ids(spark, folder):
    return sorted(r.id for r in P.current(spark, folder).collect())


@pytest.mark.parametrize("dies", STEPS)
def test_readers_see_whole_versions_whatever_step_the_writer_dies_at(spark, tmp_path, dies):
    folder = str(tmp_path / "t")
    assert P.publish(spark.range(3), folder, "one") == "created"

    def lost(step):
        if step == dies:
            raise OSError(step)

    with pytest.raises(OSError, match=dies):
        P.publish(spark.range(5), folder, "two/2", after=lost)
    assert ids(spark, folder) == list(range(5 if dies == "pointed" else 3))
    assert P.publish(spark.range(5).repartition(4), folder, "two/2") in ("created", "reused")
    assert (P.current_version(spark, folder), ids(spark, folder)) == ("two/2", list(range(5)))


def test_versions_are_never_written_over(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = spark.range(4).select("id", F.lit(None).cast("string").alias("x"), (F.col("id") % 2).alias("half"))
    assert P.publish(rows, folder, "1", by=("half",)) == "created"
    assert P.publish(rows.orderBy(F.desc("id")), folder, "1", by=("half",)) == "reused"
    assert P.publish(rows.where("id > 1"), folder, "2", by=("half",)) == "created"
    with pytest.raises(P.Collision) as caught:
        P.publish(rows.unionByName(rows), folder, "1", by=("half",))
    assert caught.value.status == "artifact_collision"
    assert ids(spark, folder) == [2, 3] and P.published(spark, folder, "1") and not P.published(spark, folder, "3")
    P.point(spark, folder, "1")
    assert ids(spark, folder) == [0, 1, 2, 3]
    assert P.publish(rows.limit(0), folder, "empty", by=("half",)) == "created"
    with pytest.raises(FileNotFoundError):
        P.current(spark, str(tmp_path / "none"))


def test_digests_tell_rows_apart(spark):
    one = spark.createDataFrame([(1, None), (1, None), (2, "")], "a long, b string")
    digest = P.content_digest(one)
    assert digest == P.content_digest(one.repartition(3).select("b", "a"))
    for other in (one.distinct(), one.withColumn("b", F.coalesce("b", F.lit(""))), one.withColumnRenamed("b", "c"), one.limit(0)):
        assert P.content_digest(other) != digest


def test_artifacts(spark, tmp_path):
    path = str(tmp_path / "deep" / "artifact.json")
    assert P.write_artifact(spark, path, {"value": 1, "é": None}) == "created"
    assert P.write_artifact(spark, path, {"é": None, "value": 1}) == "reused"
    with pytest.raises(P.Collision):
        P.write_artifact(spark, path, {"value": 2})
    assert json.load(open(path, encoding="utf-8")) == {"value": 1, "é": None}
    for content in (b"first", b"second"):
        P.replace_file(spark, str(tmp_path / "report.md"), content)
    assert (tmp_path / "report.md").read_bytes() == b"second"
    assert sorted(p.name for p in tmp_path.iterdir() if "._" in p.name) == []


def records_of(spark, low, high, note):
    rows = spark.range(low, high).select(F.col("id").cast("string").alias("id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("values"), F.lit(note).cast("string").alias("note"))
    return rows


def test_batches_are_stored_once(spark, tmp_path):
    store = str(tmp_path / "store")
    first = records_of(spark, 0, 40, "a").repartition(3)
    batch_sink.upsert(first, store, "run/1")
    batch_sink.upsert(first.repartition(5), store, "run/1")
    batch_sink.upsert(records_of(spark, 30, 60, None), store, "run/2")
    batch_sink.upsert(records_of(spark, 0, 0, "x"), store, "empty")
    got = batch_sink.stored(spark, store, first.schema)
    assert records.sink_faults(got, 60, 2) == []
    assert {(r.id, r.note) for r in got.collect()} == {(str(i), "a" if i < 30 else None) for i in range(60)}
    assert [(m["key"], m["n"]) for m in batch_sink.manifests(store)] == [("run%2F1", 40), ("run%2F2", 30), ("empty", 0)]
    with pytest.raises(Exception, match="committed with other rows"):
        batch_sink.upsert(records_of(spark, 0, 40, "b"), store, "run/1")
    for odd in (first.unionByName(first.limit(1)), first.withColumn("id", F.lit(None).cast("string"))):
        with pytest.raises(ValueError, match="null or repeated"):
            batch_sink.upsert(odd, store, "odd")
    assert got.count() == 60


def test_a_batch_that_failed_half_way_leaves_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = records_of(spark, 0, 40, "a").repartition(4)
    broken = rows.withColumn("note", F.when(F.col("id") == "33", F.raise_error(F.lit("lost"))).otherwise(F.col("note")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        batch_sink.upsert(broken.select("id", "values", "note"), store, "1")
    assert batch_sink.manifests(store) == [] and batch_sink.stored(spark, store, rows.schema).count() == 0
    batch_sink.upsert(rows, store, "1")
    assert records.sink_faults(batch_sink.stored(spark, store, rows.schema), 40, 2) == []


def test_shards_and_vector_records(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "shards"))
    assert {r.position for r in records.sharded(spark, str(tmp_path / "shards")).collect()} >= {0}
    rows = spark.createDataFrame([(1, [1.0, 2.0], [1], [0.5], None), (2, [1.0], [1], [0.5], "u")], "id long, embedding array<double>, term_ids array<long>, weights array<double>, url string")
    made = records.vector_records(rows, "id", 2)
    assert records.sink_faults(made, 2, 2) == ["1 vectors of another dimension"]
    assert [r.metadata for r in made.orderBy("id").collect()] == [{}, {"url": "u"}]
