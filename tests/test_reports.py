"""Gates, probes, bounded contexts, searches and scores on small rows with known results."""

import math

from pyspark.sql import functions as F

from quern.operators import answers, gates, logs, measures, ranking, search


def test_gates_and_decisions(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame(
        [("a", 1.0, 4.0, None), ("b", 0.5, 0.0, None), ("c", 0.5, nan, "own"), ("d", None, 2.0, None), ("e", inf, 2.0, None), ("f", 0.2, None, None), ("g", 0.2, 5.0, None)], "metric string, value double, denominator double, reason string"
    )
    asked = (("a", "eq", 1.0), ("b", "gte", 0.1), ("c", "gte", 0.1), ("d", "lte", 0.1), ("e", "gte", 0.1), ("f", "gte", 0.1), ("g", "lte", 0.1), ("h", "lte", 0.1))
    found = gates.measured(rows, asked)
    assert {r.metric: (r.observed, r.verdict, r.reason) for r in found.collect()} == {
        "a": (1.0, "PASS", None), "b": (None, "UNSUPPORTED", "zero_or_non_finite_denominator"), "c": (None, "UNSUPPORTED", "own"), "d": (None, "UNSUPPORTED", "invalid_or_missing_observed_value"),
        "e": (None, "UNSUPPORTED", "non_finite_observed_value"), "f": (None, "UNSUPPORTED", "invalid_or_missing_denominator"), "g": (0.2, "FAIL", None), "h": (None, "UNSUPPORTED", "metric_unavailable"),
    }
    decide = lambda r: gates.acceptance(r, {"BLOCKED_SCOPE": F.count_if(F.col("verdict") == "UNSUPPORTED") > 0}, "PASS_PILOT").first().decision
    assert [decide(found), decide(found.where("metric IN ('a', 'g')")), decide(found.where("metric = 'a'")), decide(found.limit(0))] == ["BLOCKED_SCOPE", "FAIL_QUALITY", "PASS_PILOT", "FAIL_QUALITY"]
    shown = spark.createDataFrame([(0.12345,), (None,)], "v double").select(gates.shown(F.col("v")).alias("a"), gates.shown(F.col("v"), True).alias("b")).collect()
    assert [tuple(r) for r in shown] == [("0.1235", "12.3%"), ("N/A", "N/A")]


def test_probe(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, None), (4, 4)], "query_id long, rank int")
    assert {r.metric: (r.numerator, r.denominator, r.value) for r in measures.probe(ranks).collect()} == {"recall_at_1": (1.0, 4, 0.25), "recall_at_3": (2.0, 4, 0.5), "mrr": (round(1 + 1 / 3 + 1 / 4, 6), 4, round((1 + 1 / 3 + 1 / 4) / 4, 6))}
    assert measures.probe(ranks.limit(0)).collect() == []


def plain_context(texts, most):
    remaining, out = most, []
    for k, text in enumerate(texts, 1):
        label, tokens = f"[Tài liệu tham khảo #{k}]", (text or "").split()
        room = remaining - len(label.split())
        if room <= 0 or not tokens[:room]:
            break
        out.append(f"{label}\n{' '.join(tokens[:room])}")
        remaining -= len(label.split()) + len(tokens[:room])
        if len(tokens) > room:
            break
    return "\n\n".join(out)


def test_bounded_contexts(spark):
    cases = [["a b", "c d e", "f"], ["x " * 100], ["a", "", "b"], ["a", None, "b"], ["a b c"] * 50, ["a b c d e f g"], [None], ["w"] * 3]
    rows = [(k, n, t) for k, texts in enumerate(cases) for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "key int, rank int, text string").repartition(3)
    for most in (5, 6, 12, 17, 40):
        got = {r.key: (r.context, r.tokens) for r in answers.bounded_text(df, most).collect()}
        want = {k: plain_context(t, most) for k, t in enumerate(cases)}
        assert {k: v[0] for k, v in got.items()} == {k: v for k, v in want.items() if v}
        assert all(len(c.split()) == n <= most for c, n in got.values())


def test_cache_keeps_to_its_revision(spark):
    entries = [(1, [1.0, 0.0], "r1", "old"), (2, [1.0, 0.1], "r2", "new"), (3, [0.0, 1.0], "r2", "far"), (4, None, "r2", "none"), (5, [0.0, 0.0], "r2", "zero")]
    held = spark.createDataFrame(entries, "entry_id long, embedding array<double>, revision string, response string")
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 1.0]), (12, None)], "query_id long, embedding array<double>")
    assert [(r.query_id, r.entry_id, r.response) for r in search.cache_lookup(asked, held, "r2").collect()] == [(10, 2, "new")]
    assert search.cache_lookup(asked, held, "r3").collect() == []
    keys = spark.createDataFrame([("What  IS it",), ("what is it ",)], "q string").select(search.cache_key(F.col("q"), "r1").alias("a"), search.cache_key(F.col("q"), "r2").alias("b")).collect()
    assert keys[0] == keys[1] and keys[0].a != keys[0].b


def test_searches(spark):
    rows = spark.createDataFrame([(1, "Tax (new)", "u", "x"), (2, "tax (NEW) law", "u", None), (3, "tax new", "u", "TAX"), (4, "Tax (new)", None, "y")], "id long, title string, owner string, other string")
    assert [r.id for r in logs.search_titles(rows, "title", "(New", ("owner", "u"), ("id",)).collect()] == [2, 1]
    assert [r.id for r in logs.search_any(rows, ("title", "other"), "^tax$|law", ("id",), 0, 9).collect()] == [3, 2]
    assert [r.id for r in logs.search_any(rows, ("title",), "TAX", ("id",), 1, 2).collect()] == [3, 2]


def test_passage_scores(spark):
    rows = spark.createDataFrame([("thuế_suất thời hạn", "Thuế suất và thuế suất; tháng"), ("a b", "x"), (None, "x"), ("thuế", None)], "q string, t string")
    got = [r.s for r in rows.select(ranking.passage_score(F.col("q"), F.col("t")).alias("s")).collect()]
    # "hạn" and "thời" aren't there; the deadline is asked for and named.
    assert got == [round(1 + math.log(2) + 4, 6), 0.0, 0.0, 0.0]
