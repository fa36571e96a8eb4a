"""Rollups of interaction logs, quotas and latest states over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import places


def rate(when: Column) -> Column:
    """Per cent of rows, two digits."""
    return F.round(100.0 * F.count_if(when) / F.count(F.lit(1)), 2)


def facet(events: DataFrame) -> DataFrame:
    """Counts and rates of several filters in one pass."""
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        rate(F.col("event_type") == "error").alias("error_rate"),
        F.countDistinct("user_id").alias("users"),
        F.round(F.avg(F.coalesce("value", F.lit(0.0))), 4).alias("mean_value"),
    )


def by_type(events: DataFrame) -> DataFrame:
    """Each type's count, share and value statistics."""
    n = summarised(events, "event_type", "value", 4, F.count(F.lit(1)))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def summarised(rows: DataFrame, group: str, value: str, digits: int, n: Column) -> DataFrame:
    """group, ``n``, mean, exact median and 95th percentile, least and most; null where a group has no values."""
    c = F.col(value)
    plain = rows.groupBy(group).agg(n.alias("n"), *(F.round(x, digits).alias(name) for name, x in (("mean", F.avg(c)), ("least", F.min(c)), ("most", F.max(c)))))
    middle = places.quantiles(rows, group, value, {"p50": 0.5, "p95": 0.95}).select(F.col(group).alias("_of"), *(F.round(p, digits).alias(p) for p in ("p50", "p95")))
    return plain.join(middle, F.col(group).eqNullSafe(F.col("_of")), "left").select(group, "n", "mean", "p50", "p95", "least", "most")


def nearest_rank(events: DataFrame, share: float) -> DataFrame:
    """The value at place ceil(share * n) of each type."""
    return places.nearest_rank(events, "event_type", "value", share).select("event_type", F.col("value").alias("at_rank"))


def daily_quota(events: DataFrame, each: int, all_: int) -> DataFrame:
    """Events that a day's quota admits in order of arrival: ``each`` for a user, ``all_`` in all."""
    day = F.to_date("ts")
    mine = Window.partitionBy("day", "user_id").orderBy("ts", "event_id")
    every = Window.partitionBy("day").orderBy("ts", "event_id")
    kept = events.withColumn("day", day).withColumn("turn", F.row_number().over(mine)).where(F.col("turn") <= each)
    return kept.withColumn("place", F.row_number().over(every)).where(F.col("place") <= all_).select("event_id", "user_id", "turn", "place")


def rate_limited(events: DataFrame, width: str, most: int) -> DataFrame:
    """Windows in which a user has more than ``most`` events."""
    return events.groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("user_id", F.col("w.start").alias("start"), "n")


def latest(events: DataFrame) -> DataFrame:
    """Each user's last event (ties: the greater id)."""
    last = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x"), F.count(F.lit(1)).alias("n"))
    return last.select("user_id", F.col("x.event_id").alias("event_id"), F.col("x.event_type").alias("event_type"), F.col("x.value").alias("value"), "n")


def pending(records: DataFrame, committed: DataFrame, key: str) -> DataFrame:
    """Records not yet committed."""
    return records.join(committed.select(key).distinct(), key, "left_anti")


def histograms(records: DataFrame, columns: dict[str, str]) -> DataFrame:
    """histogram, name, n and share of all records, of several columns in one pass; ``columns`` has the name of nulls for each."""
    rows = F.array(*(F.struct(F.lit(c).alias("histogram"), F.coalesce(F.col(c).cast("string"), F.lit(none)).alias("name")) for c, none in columns.items()))
    counts = records.select(F.inline(rows)).groupBy("histogram", "name").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("histogram")), 6))


def search_any(rows: DataFrame, columns: tuple[str, ...], pattern: str, newest: tuple[str, ...], skip: int, limit: int) -> DataFrame:
    """A page of the rows of which some column matches a pattern in any case, newest first by ``newest``; null matches nothing."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).cast("string").rlike(f"(?iu){pattern}"), F.lit(False))
    return rows.where(found).orderBy(*(F.desc(c) for c in newest)).offset(skip).limit(limit)


def search_titles(rows: DataFrame, title: str, text: str, owner: tuple[str, object], newest: tuple[str, ...], limit: int = 100) -> DataFrame:
    """An owner's newest rows whose title holds the first 100 characters of ``text`` as they are, in any case."""
    held = F.contains(F.lower(title), F.lower(F.lit(text[:100])))
    return rows.where((F.col(owner[0]) == F.lit(owner[1])) & held).orderBy(*(F.desc(c) for c in newest)).limit(limit)
