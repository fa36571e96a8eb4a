"""The clustered vector index against plain cosines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import vector_index as V
from quern.sources import publication


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, cell int").repartition(3)


def plain(asked, rows, top):
    def cosine(a, b):
        norms = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return 0.0 if norms == 0 else math.floor(sum(x * y for x, y in zip(a, b)) / norms * 1e6 + 0.5) / 1e6

    out = {}
    for q, a in asked:
        scores = sorted((-cosine(a, b), i) for i, b in rows if i != q)
        out[q] = [(i, -s) for s, i in scores[:top]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def clustered(n, seed=3):
    pick = random.Random(seed)
    heads = [[pick.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    return [(i, [h + pick.gauss(0, 0.15) for h in heads[i % 12]]) for i in range(n)]


def test_all_cells_are_exact_with_ties_zeros_and_a_hot_vector(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "GROUP_BLOCKS", 1)
    monkeypatch.setattr(V, "BLOCK_ROWS", 16)
    rows = clustered(200) + [(1000 + i, [1.0] * 8) for i in range(100)] + [(2000, [0.0] * 8), (-5, [0.0] * 8)]
    odd = [(3000, None), (3001, []), (3002, [1.0, None] + [0.0] * 6), (3003, [float("nan")] * 8), (3004, [float("inf")] * 8), (None, [1.0] * 8)]
    V.build(table(spark, rows + odd), str(tmp_path / "i"), "1", cells=9)
    asked = [(i, v) for i, v in rows if i % 50 == 0] + [(-5, [0.0] * 8)]
    found = V.search(spark, str(tmp_path / "i"), table(spark, asked).withColumnRenamed("vec_id", "query_id"), 7, V.ALL)
    assert got(found) == plain(asked, rows, 7)


def test_probes_read_their_cells_alone_and_reach_the_recall(spark, tmp_path):
    rows = clustered(600)
    folder = str(tmp_path / "i")
    probes = V.build(table(spark, rows), folder, "1", cells=12)
    assert probes < 6  # clusters are found in a few cells
    asked = table(spark, rows).where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    exact, near = got(V.search(spark, folder, asked, 10, V.ALL)), got(V.search(spark, folder, asked, 10))
    hits = [len({i for i, _ in near[q]} & {i for i, _ in exact[q]}) for q in exact]
    assert sum(hits) >= 0.9 * 10 * len(exact)
    one = V.search(spark, folder, asked.where("query_id = 0"), 10, 1)
    assert [r[0] for r in got(one)[0]] and "cell" in one._jdf.queryExecution().executedPlan().toString()


def test_versions_empty_tables_and_ragged_vectors(spark, tmp_path):
    folder = str(tmp_path / "i")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert V.build(table(spark, []), folder, "empty") == 1
    assert got(V.search(spark, folder, asked, 3)) == {}
    V.build(table(spark, [(1, [0.0, 0.0])]), folder, "zeros")
    assert got(V.search(spark, folder, asked, 3)) == {7: [(1, 0.0)]}
    V.build(table(spark, [(1, [1.0, 0.0]), (2, [0.0, 2.0])]), folder, "two")
    assert publication.current_version(spark, folder) == "two"
    assert got(V.search(spark, folder, asked, 3, V.ALL)) == {7: [(1, 1.0), (2, 0.0)]}
    with pytest.raises(ValueError, match="can't be compared"):
        V.build(table(spark, [(1, [1.0, 0.0]), (2, [2.0])]), folder, "ragged")
    assert V.search(spark, folder, asked.where(F.lit(False)), 3).collect() == []
