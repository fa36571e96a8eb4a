"""Places, quantiles and ranks against plain Python, with one group that holds most rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import logs, places, sampling


def rows(spark):
    rnd = random.Random(3)
    data = [(i, rnd.choice(["hot"] * 8 + ["a", None]), rnd.choice([None, float(rnd.randint(0, 40)), rnd.random()])) for i in range(30_000)]
    return data, spark.createDataFrame(data, "id long, g string, v double").repartition(6)


def values(data):
    out = {}
    for _, g, v in data:
        if v is not None:
            out.setdefault(g, []).append(v)
    return {g: sorted(vs) for g, vs in out.items()}


def test_places_of_rows(spark):
    data, df = rows(spark)
    got = places.placed(df, "g", "id").collect()
    want = {}
    for g in ("hot", "a", None):
        ids = sorted(i for i, x, _ in data if x == g)
        want |= {i: (k, len(ids)) for k, i in enumerate(ids)}
    assert {r.id: (r._before, r._total) for r in got} == want


def test_quantiles_and_nearest_ranks(spark):
    data, df = rows(spark)
    held = values(data)
    got = {r.g: (r.p0, r.p50, r.p95, r.p100) for r in places.quantiles(df, "g", "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    assert got.keys() == held.keys()
    for g, vs in held.items():
        for share, found in zip((0.0, 0.5, 0.95, 1.0), got[g], strict=True):
            at = share * (len(vs) - 1)
            low, high = vs[math.floor(at)], vs[math.ceil(at)]
            assert found == pytest.approx(low + (high - low) * (at - math.floor(at)))
    ranks = {r.g: r.v for r in places.nearest_rank(df, "g", "v", 0.95).collect()}
    assert ranks == {g: vs[math.ceil(0.95 * len(vs)) - 1] for g, vs in held.items()}


def test_groups_without_values_and_empty_tables(spark):
    df = spark.createDataFrame([("x", None), ("y", 2.0), ("y", 4.0)], "g string, v double")
    got = {r.g: (r.n, r.mean, r.p50, r.most) for r in logs.summarised(df, "g", "v", 4, F.count("v")).collect()}
    assert got == {"x": (0, None, None, None), "y": (2, 3.0, 3.0, 4.0)}
    none = df.where("false")
    assert places.quantiles(none, "g", "v", {"p50": 0.5}).collect() == places.nearest_rank(none, "g", "v", 0.5).collect() == places.placed(none, "g", "v").collect() == []
    assert sampling.quartiles(none, "g", "v").collect() == []
