"""A run of many stages aggregated over its cases, with what must hold of it checked in the same pass.

Every stage has one configured capacity (nulls aside) and the same cases; a run that breaks this fails with the stage's name.
Ratios without a value are counted under their reason and left out of means. An empty run gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import levels
from quern.operators.measures import ratio
from quern.operators.ranking import together
from quern.sources.scratch import written


def cases_of(gold: DataFrame, candidates: DataFrame, cases: DataFrame) -> DataFrame:
    """``levels.cases_of`` with ``configured``, stage and capacity of the case as ``cases`` has them; null where the run hasn't the case."""
    configured = cases.groupBy("case_id").agg(F.collect_list(F.struct("stage", F.col("capacity").cast("int").alias("capacity"))).alias("configured"))
    return levels.listed_gold(gold).join(configured, "case_id", "full").join(levels.listed_candidates(candidates), "case_id", "left")


def _configured(cases: DataFrame) -> DataFrame:
    """known, whether the case has gold, and its stages with capacity, number of candidates, and whether they are repeated."""
    n = lambda c: F.size(F.filter(F.coalesce("candidates", F.array()), lambda x: F.array_contains(x["its"]["stage"], c["stage"])))
    again = lambda c: F.size(F.filter("configured", lambda x: x["stage"] == c["stage"])) > 1
    told = F.transform(F.array_sort("configured"), lambda c: F.named_struct(F.lit("stage"), c["stage"], F.lit("capacity"), c["capacity"], F.lit("n"), n(c), F.lit("faulty"), again(c) | F.col("case_id").isNull()))
    return cases.select("case_id", F.col("configured").isNotNull().alias("known"), F.coalesce(F.size("items") > 0, F.lit(False)).alias("has"), told.alias("told"))


def checked_stages(told: DataFrame) -> dict[str, int | None]:
    """Capacity by stage of ``_configured`` rows, with how often each stands there; raises where the run breaks the rules."""
    every = F.struct(F.lit(None).cast("string").alias("stage"), F.lit(None).cast("int").alias("capacity"), F.lit(0).alias("n"), F.lit(False).alias("faulty"))
    rows = told.where("known").select("times", F.inline(F.concat("told", F.array(every))))
    found = rows.groupBy("stage").agg(F.min("capacity").alias("low"), F.max("capacity").alias("high"), F.sum("times").alias("n"), F.bool_or("faulty").alias("faulty")).collect()
    cases = sum(r.n for r in found if r.stage is None)
    stages = sorted((r for r in found if r.stage is not None), key=lambda r: r.stage)
    for r in stages:
        if r.low != r.high:
            raise ValueError(f"inconsistent configured capacity for {r.stage}")
        if r.faulty or r.n != cases:
            raise ValueError(f"cases are missing, further or repeated in some stage; one of them: {r.stage}")
    return {r.stage: r.high for r in stages}


def _means(rows: DataFrame, *keys: str) -> DataFrame:
    """macro, micro, numerator, denominator, scored_cases, skipped_cases and skip_reasons of ratios (numerator, denominator, value, reason, times)."""
    known, times = F.col("value").isNotNull(), F.col("times")
    by_reason = rows.groupBy(*keys, "reason").agg(
        F.sum("times").alias("n"), F.sum(F.when(known, times).otherwise(0)).alias("scored"), F.sum(F.col("value") * times).alias("sum"),
        F.sum(F.when(known, F.col("numerator") * times)).alias("num"), F.sum(F.when(known, F.col("denominator") * times)).alias("den"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_reason.groupBy(*keys).agg(
        F.round(ratio(F.sum("sum"), F.sum("scored")), 4).alias("macro"),
        F.round(ratio(F.sum("num"), F.sum("den")), 4).alias("micro"),
        F.round(total("num").cast("double"), 6).alias("numerator"),
        F.round(total("den").cast("double"), 6).alias("denominator"),
        F.sum("scored").alias("scored_cases"),
        F.sum(F.col("n") - F.col("scored")).alias("skipped_cases"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat("reason", F.lit(":"), F.col("n").cast("string"))))), ",").alias("skip_reasons"),
    )


def _alike(rows: DataFrame, *but: str) -> DataFrame:
    """Rows that are equal but for some columns, as one with how often it stands there: counts are small numbers, so few are left."""
    return rows.groupBy(*(c for c in rows.columns if c not in but)).agg(F.count(F.lit(1)).alias("times"))


def report(gold: DataFrame, candidates: DataFrame, cases: DataFrame, order: tuple[str, ...], document_only: tuple[str, ...], ranked_stage: str, final: str) -> DataFrame:
    """stage, measure, level, k, capacity and means: recall, reciprocal rank, candidates and first loss of each stage, and the run's own.

    ``cases``: case_id, stage, capacity. ``order``: stages in which a loss may come first. Measures of the whole run have the
    stage ``run``: coverage (cases with gold), ndcg at ``ranked_stage``, multi_hop_all and multi_hop_share at ``final``.
    """
    stages = tuple(r.stage for r in cases.select("stage").distinct().collect())
    return reported(cases_of(gold, candidates, cases), stages, order, document_only, ranked_stage, final)


def reported(cases: DataFrame, stages: tuple[str, ...], order: tuple[str, ...], document_only: tuple[str, ...], ranked_stage: str, final: str) -> DataFrame:
    """``report`` of ``cases_of`` a run with these stages.

    All that is counted of a case and stage is made in one job, and written as the few rows that differ with how often each
    stands there; what must hold of the run and its measures are read off these.
    """
    col = F.col
    held = levels.judged(cases)
    listed = dict.fromkeys((*stages, *order, ranked_stage, final))
    losses = F.transform("items", lambda i: levels.first_loss(i, order, document_only))
    each = levels.by_stage(held.where(F.size("items") > 0).withColumn("losses", losses), listed, document_only)
    found = each.select(
        "stage", "document_only", col("configured").isNotNull().alias("known"), *levels.counts(), F.size(F.filter("here", lambda x: x["met"])).alias("met_n"),
        F.size(F.filter("losses", lambda x: x.eqNullSafe(col("stage")))).alias("lost_n"), F.when(col("stage") == ranked_stage, levels.served_gain(levels.served(ranked_stage))).alias("ndcg"),
    )
    counts = written(_alike(found).unionByName(_alike(_configured(held), "case_id"), allowMissingColumns=True), "counts")
    told = counts.where(col("stage").isNull())
    capacities = checked_stages(told)
    if not capacities:
        kinds = "stage string, measure string, level string, k int, macro double, micro double, numerator double, denominator double, scored_cases long, skipped_cases long, skip_reasons string, capacity int"
        return cases.sparkSession.createDataFrame([], kinds)
    configured = F.coalesce(*(F.when(col("stage") == s, F.lit(c)) for s, c in capacities.items()), F.lit(None)).cast("int")
    each = counts.where(col("stage").isin(*capacities)).withColumn("capacity", configured)
    none = F.lit(None).cast("string")

    def row(measure: str, value: Column, numerator: Column | None = None, denominator: Column | None = None, level: Column = none, k: Column | None = None, reason: Column = none, stage: Column = col("stage")) -> Column:
        return F.struct(
            stage.alias("stage"), F.lit(measure).alias("measure"), level.alias("level"), (F.lit(None) if k is None else k).cast("int").alias("k"), (value if numerator is None else numerator).cast("double").alias("numerator"),
            (F.lit(1) if denominator is None else denominator).cast("double").alias("denominator"), value.cast("double").alias("value"), reason.alias("reason"),
        )

    rows_of = lambda rows, *some: rows.select("times", F.inline(F.filter(F.array(*some), lambda x: x.isNotNull())))
    run, items = F.lit("run"), col("document_n")
    hidden = lambda x: F.lit(x != "document") & col("stage").isin(*document_only)
    reason = lambda x: F.when(hidden(x), "stage_does_not_expose_structural_locators").when(col(f"{x}_n") == 0, "no_applicable_gold")
    rank = lambda x: F.when(reason(x).isNull(), F.coalesce(F.round(1.0 / col(f"{x}_first"), 4), F.lit(0.0)))
    parts = [
        rows_of(levels.counted_recalls(each, "times"), row("recall", col("recall"), col("found_n"), col("gold_n"), col("level"), col("k"), col("reason"))),
        rows_of(
            counts.where(col("stage").isNotNull()),
            *(F.when(col("known") & col("stage").isin(*capacities), row("reciprocal_rank", rank(x), level=F.lit(x), reason=reason(x))) for x in levels.LEVELS),
            F.when(col("stage") == ranked_stage, row("ndcg", col("ndcg"), stage=run)),
            F.when(col("stage") == final, row("multi_hop_all", (col("met_n") == items).cast("int"), stage=run)),
            F.when(col("stage") == final, row("multi_hop_share", F.round(col("met_n") / items, 4), col("met_n"), items, stage=run)),
        ),
        told.where("known").select("times", F.inline(F.concat(F.transform("told", lambda c: row("candidates", c["n"], stage=c["stage"])), F.array(row("coverage", col("has").cast("int"), stage=run))))),
    ]
    lost = [
        counts.where(col("stage").isin(*order)).select("stage", (col("lost_n") * col("times")).alias("n"), (items * col("times")).alias("total")),
        cases.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, order))).alias("stage"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total")),
    ]
    losses = together(lost).groupBy("stage").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select(
        "stage", F.lit("first_loss").alias("measure"), none.alias("level"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("double").alias("macro"), F.round(ratio(col("n"), col("total")), 4).alias("micro"),
        col("n").cast("double").alias("numerator"), col("total").cast("double").alias("denominator"), col("total").alias("scored_cases"), F.lit(0).cast("long").alias("skipped_cases"), F.lit("").alias("skip_reasons"),
    )
    return _means(together(parts), "stage", "measure", "level", "k").unionByName(losses).withColumn("capacity", configured)
