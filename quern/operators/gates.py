"""Comparisons of runs and gates with thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def winner(rows: DataFrame) -> DataFrame:
    """The profile of greatest recall at the largest defined k; no winner on a tie or where all are 0.

    ``rows``: profile, k, recall.
    """
    defined = rows.where(F.col("recall").isNotNull())
    last = defined.agg(F.max("k").alias("k"))
    best = defined.join(F.broadcast(last), "k").groupBy("k").agg(F.max("recall").alias("best"), F.collect_list(F.struct("recall", "profile")).alias("all"))
    tied = F.filter("all", lambda x: x["recall"] == F.col("best"))
    return best.select("k", F.round("best", 6).alias("best"), F.when((F.size(tied) == 1) & (F.col("best") > 0), F.element_at(tied, 1)["profile"]).alias("winner"))


def verdicts(values: DataFrame, thresholds: tuple[tuple[str, str, float], ...]) -> DataFrame:
    """metric, value and verdict (PASS, FAIL, or UNSUPPORTED where undefined) of each threshold over one row of values."""
    compare = {"eq": lambda v, t: v == t, "gte": lambda v, t: v >= t, "lte": lambda v, t: v <= t}
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), compare[how](F.col(m), F.lit(t)).alias("ok")) for m, how, t in thresholds))
    return values.select(F.explode(rows).alias("x")).select(
        "x.metric", F.round("x.value", 6).alias("value"), F.when(F.col("x.value").isNull(), "UNSUPPORTED").when(F.col("x.ok"), "PASS").otherwise("FAIL").alias("verdict")
    )


def measured(rows: DataFrame, thresholds: tuple[tuple[str, str, float], ...]) -> DataFrame:
    """metric, required, observed, verdict and reason of each threshold (metric, eq, gte or lte, value) over measures.

    ``rows``: metric, value, denominator, reason, one row for each at most. A metric that is missing, or whose denominator
    isn't a finite number above 0, or whose value isn't finite, is UNSUPPORTED under its own reason where it has one.
    """
    spark = rows.sparkSession
    asked = spark.createDataFrame([(m, how, float(t)) for m, how, t in thresholds], "metric string, how string, required double")
    held = F.broadcast(asked).join(rows.select(F.col("metric").alias("_m"), "value", "denominator", "reason"), F.col("metric") == F.col("_m"), "left")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    v, n = F.col("value"), F.col("denominator")
    own = lambda why: F.coalesce("reason", F.lit(why))
    reason = (
        F.when(F.col("_m").isNull(), "metric_unavailable")
        .when(n.isNull(), own("invalid_or_missing_denominator"))
        .when(~finite(n) | (n <= 0), own("zero_or_non_finite_denominator"))
        .when(v.isNull(), own("invalid_or_missing_observed_value"))
        .when(~finite(v), own("non_finite_observed_value"))
    )
    passed = F.when(F.col("how") == "eq", v == F.col("required")).when(F.col("how") == "gte", v >= F.col("required")).otherwise(v <= F.col("required"))
    told = held.withColumn("_why", reason)
    return told.select(
        "metric", "required", F.when(F.col("_why").isNull(), v).alias("observed"), F.when(F.col("_why").isNotNull(), "UNSUPPORTED").when(passed, "PASS").otherwise("FAIL").alias("verdict"), F.col("_why").alias("reason")
    )


def acceptance(verdicts: DataFrame, blocked: dict[str, Column], passes: str, fails: str = "FAIL_QUALITY") -> DataFrame:
    """One row, decision: the first name of ``blocked`` whose condition (an aggregate over the verdicts) holds, else whether all pass."""
    decision = F.lit(None).cast("string")
    for name, when in blocked.items():
        decision = F.coalesce(decision, F.when(when, F.lit(name)))
    return verdicts.agg(F.coalesce(decision, F.when(F.coalesce(F.bool_and(F.col("verdict") == "PASS"), F.lit(False)), passes).otherwise(fails)).alias("decision"))


def shown(value: Column, percent: bool = False, decimals: int = 4) -> Column:
    """A number as reports write it; N/A for null."""
    text = F.format_string("%.1f%%", value * 100) if percent else F.format_string(f"%.{decimals}f", value)
    return F.when(value.isNull(), "N/A").otherwise(text)
