"""Measures of ranked lists, undefined (null, with a reason) rather than 0 where they have no denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def first_ranks(gold: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, doc_id and rank (null: not found) of every gold item."""
    return gold.join(hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")), ["query_id", "doc_id"], "left")


def recall_at(cases: DataFrame, found: DataFrame, ks: tuple[int, ...], capacity: int) -> DataFrame:
    """query_id, k, found_n, gold_n, recall and reason of every case; k beyond the capacity and cases without gold are undefined."""
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold_n"), *(F.count_if(F.col("rank") <= k).alias(f"at_{k}") for k in ks))
    long = cases.join(counts, "query_id", "left").select(
        "query_id",
        F.coalesce("gold_n", F.lit(0)).alias("gold_n"),
        F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"at_{k}", F.lit(0)).alias("found_n")) for k in ks))).alias("x"),
    )
    over = F.col("x.k") > capacity
    return long.select(
        "query_id", F.col("x.k").alias("k"), F.col("x.found_n").alias("found_n"), "gold_n",
        F.when(~over, ratio(F.col("x.found_n"), F.col("gold_n"))).alias("recall"),
        F.when(over, "k_exceeds_configured_capacity").when(F.col("gold_n") == 0, "no_gold").alias("reason"),
    )


def macro_micro(recalls: DataFrame) -> DataFrame:
    """k, macro (mean of defined values), micro (sums), n_defined and n_undefined."""
    defined = F.col("recall").isNotNull()
    sums = lambda c: F.sum(F.when(defined, F.col(c)))
    return recalls.groupBy("k").agg(
        F.round(F.avg("recall"), 6).alias("macro"), F.round(ratio(sums("found_n"), sums("gold_n")), 6).alias("micro"), F.count_if(defined).alias("n_defined"), F.count_if(~defined).alias("n_undefined")
    )


def null_reasons(recalls: DataFrame) -> DataFrame:
    return recalls.where(F.col("reason").isNotNull()).groupBy("k", "reason").agg(F.count(F.lit(1)).alias("n"))


def reciprocal_rank(found: DataFrame) -> DataFrame:
    """query_id and rr: one over the rank of the first gold item found, else 0."""
    return found.groupBy("query_id").agg(F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("rr"))


def ndcg(found: DataFrame, k: int = 10) -> DataFrame:
    """query_id and ndcg with gain 1 for each gold item, of distinct items as one place serves one of them."""
    placed = found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    gain = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    ideal = F.when(F.col("place") <= k, 1 / F.log2(F.col("place") + 1)).otherwise(0.0)
    return placed.groupBy("query_id").agg(F.round(F.sum(gain) / F.sum(ideal), 6).alias("ndcg"))


def coverage(found: DataFrame) -> DataFrame:
    """query_id, all_found and share of its gold items found."""
    return found.groupBy("query_id").agg(F.bool_and(F.col("rank").isNotNull()).alias("all_found"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("share"))


def first_loss(gold: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """query_id, doc_id and the first stage, in order, without the gold item; null where it survives all."""
    found = gold
    lost = []
    for k, (_, hits) in enumerate(stages):
        found = found.join(hits.select("query_id", "doc_id").distinct().withColumn(f"in_{k}", F.lit(True)), ["query_id", "doc_id"], "left")
        lost.append(F.when(F.col(f"in_{k}").isNull(), F.lit(stages[k][0])))
    return found.select("query_id", "doc_id", F.coalesce(*lost).alias("stage"))


def distribution(sizes: DataFrame, column: str) -> DataFrame:
    """count, least, mean, interpolated median and 95th percentile, and most."""
    c = F.col(column)
    return sizes.agg(
        F.count(c).alias("n"), F.min(c).alias("least"), F.round(F.avg(c), 6).alias("mean"), F.round(F.percentile(c, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(c, F.lit(0.95)), 6).alias("p95"), F.max(c).alias("most")
    )


def probe(ranks: DataFrame, depths: tuple[int, ...] = (1, 3)) -> DataFrame:
    """metric, numerator, denominator and value of recall at each depth and of the mean reciprocal rank.

    ``ranks``: a row for each question with rank, null where nothing was found. No questions give no rows.
    """
    rank, n = F.col("rank"), F.count(F.lit(1))
    metrics = [(f"recall_at_{k}", F.count_if(rank <= k).cast("double")) for k in depths] + [("mrr", F.sum(F.coalesce(1.0 / rank, F.lit(0.0))))]
    sums = ranks.agg(n.alias("n"), *(v.alias(m) for m, v in metrics)).where("n > 0")
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.round(m, 6).alias("numerator"), F.col("n").alias("denominator"), F.round(F.col(m) / F.col("n"), 6).alias("value")) for m, _ in metrics))
    return sums.select(F.inline(rows))
