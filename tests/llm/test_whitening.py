import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def table(spark, vectors, partitions=3):
    rows = [(i, v, 0, 0.0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, w double").repartition(partitions)


def by_force(vectors, most):
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), [int(s) for s in x.sum(0)]
    centred = (x - np.array([s // n for s in sums])) - np.array([(s % n) / n for s in sums])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, centred @ v[:, :most] / np.sqrt(e[:most]), e[:most] / e.sum()


def held(rows, vectors, most):
    n, deviation, white, explained = by_force(vectors, most)
    got = np.full((len(vectors), most), np.nan)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-10
        assert r.identity_error < 1e-9
    signs = np.sign((got * white).sum(0))
    assert np.allclose(got, white * signs, atol=1e-8)
    assert len(rows) == len(vectors) * most


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    number = {r.vec_id: k for k, r in enumerate(rows)}
    got = queries.QUERIES["op11_whitening"](spark, SF).withColumn("vec_id", F.create_map(*(F.lit(x) for kv in number.items() for x in kv))[F.col("vec_id")]).collect()
    held(got, [r.embedding for r in rows], 8)


@pytest.mark.parametrize("partitions", [1, 2, 20])
def test_merging_loses_nothing(spark, partitions):
    random = np.random.default_rng(1)
    vectors = (random.normal(size=(300, 6)) * [5, 4, 3, 2, 1, 0.5] + [100, -50, 0, 3, 7, 1e4]).tolist()
    held(whitening.whitened(table(spark, vectors, partitions), most=5).collect(), vectors, 5)


def test_unusable_vectors_and_repeats(spark):
    good = [[0.1, 0.9], [0.1, 0.9], [0.5, 0.2], [-0.3, 0.4]]
    bad = [None, [], [None, 1.0], [float("nan"), 1.0], [1.0, float("inf")], [float("-inf"), 0.0]]
    got = whitening.whitened(table(spark, good + bad)).collect()
    assert sorted({r.vec_id for r in got}) == [0, 1, 2, 3]
    held(got, good, 2)
    assert whitening.whitened(table(spark, bad)).collect() == []
    assert whitening.whitened(table(spark, good).limit(0)).collect() == []


def test_a_hot_vector(spark):
    random = np.random.default_rng(2)
    vectors = [[0.25, 0.5, 0.75]] * 400 + random.normal(size=(200, 3)).tolist()
    held(whitening.whitened(table(spark, vectors, 7), most=3).collect(), vectors, 3)


def test_components_without_variance(spark):
    flat = whitening.whitened(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(flat) == 6
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in flat} == {(0, None, None, None)}
    line = whitening.whitened(table(spark, [[float(i), 2.0 * i, 5.0] for i in range(5)])).collect()
    assert {(r.component, r.whitened is None) for r in line} == {(1, False), (2, True), (3, True)}
    assert all(r.explained == 0.0 for r in line if r.component > 1) and all(r.identity_error < 1e-9 for r in line)


def test_exact_beyond_64_bits():
    x = np.array([[2**40, 0], [0, 2**40]])
    sums = [int(s) for s in x.sum(0)]
    n = 10**6
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, n, sums) == want and max(want) > 2**63


def test_refusals(spark):
    for bad in ([[1.0], [1.0, 2.0]], [[1e300]]):
        with pytest.raises(Exception, match="entries have no common covariance|passes 2"):
            whitening.whitened(table(spark, bad)).collect()
