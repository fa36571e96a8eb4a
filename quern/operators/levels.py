"""Evidence matched to candidates by level (document, article, clause) and measured stage by stage.

``gold``: case_id, evidence_id, document_id, document_number, article, clause, required_level. ``candidates``: case_id,
stage, rank and the four locators. Null locators match nothing; a locator that gold lacks is inherited from its parent.
Repeated candidates count at their first rank. Ties of rank go to the smaller evidence_id. Empty tables give no rows. An
evidence_id stands once in a case.

A case with all its gold and candidates is one row, as candidates are bounded by the capacities of stages: measures are made
within it, so nothing is joined back, and rows that lie by case are shuffled no more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.measures import ratio

LOCATORS = ("document_id", "document_number", "article", "clause")
LEVELS = ("document", "article", "clause")
#: Values of k by level.
DEPTHS = {"document": (1, 3, 5, 10, 24), "article": (1, 3, 6), "clause": (1, 3, 6)}


def _same(gold: Column, other: Column) -> Column:
    return F.coalesce((T.locator(gold) != "") & (T.locator(gold) == T.locator(other)), F.lit(False))


def _named(**values: Column) -> Column:
    return F.named_struct(*(x for k, v in values.items() for x in (F.lit(k), v)))


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def as_item(gold: Column) -> Column:
    """Gold, a struct, with its locators as they are compared."""
    return F.struct(gold.alias("gold"), *(T.locator(gold[c]).alias(c) for c in LOCATORS[1:]))


def as_candidate(its: Column) -> Column:
    """A candidate, a struct whose ``stage`` is an array of all stages that have it at its rank, with its locators as they are compared."""
    return F.struct(its.alias("its"), *(T.locator(its[c]).alias(c) for c in LOCATORS[1:]))


def listed_gold(gold: DataFrame) -> DataFrame:
    """case_id and gold: all ``as_item`` of each case."""
    return gold.groupBy("case_id").agg(F.collect_list(as_item(F.struct(*(c for c in gold.columns if c != "case_id")))).alias("gold"))


def listed_candidates(candidates: DataFrame) -> DataFrame:
    """case_id and candidates: all ``as_candidate`` of each case."""
    return candidates.groupBy("case_id").agg(F.collect_list(as_candidate(F.struct(F.array("stage").alias("stage"), "rank", *LOCATORS))).alias("candidates"))


def cases_of(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """case_id, gold and candidates: a row for each case with gold."""
    return listed_gold(gold).join(listed_candidates(candidates), "case_id", "left")


def judged(cases: DataFrame) -> DataFrame:
    """``cases_of`` with ``items`` for gold: each with ``hits``, the candidates that share its document, or all where gold has none.

    A hit has by_document, by_article, by_clause, and by_required, the level that gold asks for.
    """
    no = F.lit(False)
    same = lambda g, c, x: F.coalesce((g[x] != "") & (g[x] == c[x]), no)
    document = lambda g, c: F.coalesce(g["gold"]["document_id"] == c["its"]["document_id"], no) | same(g, c, "document_number")
    loose = lambda g: g["gold"]["document_id"].isNull() & (g["document_number"] == "")
    article = lambda g, h: F.when(g["article"] == "", h["d"]).otherwise(same(g, h["c"], "article"))
    clause = lambda g, h: h["a"] & ((g["clause"] == "") | same(g, h["c"], "clause"))
    asked = lambda g, h: F.when(g["gold"]["required_level"] == "document", h["by_document"]).when(g["gold"]["required_level"] == "article", h["by_article"]).otherwise(h["by_clause"])

    def hits(g: Column) -> Column:
        met = F.filter(F.transform("candidates", lambda c: _named(c=c, d=document(g, c))), lambda h: h["d"] | loose(g))
        told = F.transform(F.transform(met, lambda h: _named(c=h["c"], d=h["d"], a=article(g, h))), lambda h: _named(its=h["c"]["its"], by_document=h["d"], by_article=h["a"], by_clause=clause(g, h)))
        whole = F.transform(told, lambda h: _named(**{k: h[k] for k in ("its", "by_document", "by_article", "by_clause")}, by_required=asked(g, h)))
        return F.coalesce(F.when(F.col("case_id").isNotNull(), whole), F.array())

    item = lambda g: _named(gold=g["gold"], has_document=F.lit(True), has_article=g["article"] != "", has_clause=g["clause"] != "", hits=hits(g))
    return cases.withColumn("items", F.transform("gold", item)).drop("gold")


def matched(cases: DataFrame) -> DataFrame:
    """Gold of ``judged`` cases beside each of its hits, a row for each stage."""
    rows = cases.select("case_id", F.inline("items")).select("case_id", "gold.*", F.inline("hits"))
    its = (F.col(f"its.{c}").alias(f"its_{c}") for c in LOCATORS)
    return rows.select("*", F.explode("its.stage").alias("stage"), F.col("its.rank").alias("rank"), *its).drop("its")


def level_matches(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """Gold with each candidate of its case that shares its document, or all where gold has none: by document, article, clause."""
    return matched(judged(cases_of(gold, candidates)))


def required_match() -> Column:
    """Whether a pair matches at the level that its gold asks for."""
    level = F.col("required_level")
    return F.when(level == "document", F.col("by_document")).when(level == "article", F.col("by_article")).otherwise(F.col("by_clause"))


def exact_reference() -> Column:
    """Whether number, then article, then clause are all named and equal, down to the level that gold asks for."""
    number, article, clause = (_same(F.col(c), F.col(f"its_{c}")) for c in ("document_number", "article", "clause"))
    level = F.col("required_level")
    return number & ((level == "document") | (article & ((level == "article") | clause)))


def applies(level: str) -> Column:
    """Gold that counts at a level: all for documents, that which names the locator else."""
    return F.lit(True) if level == "document" else T.locator(F.col(level)) != ""


def _judged(gold: DataFrame | None, matches: DataFrame) -> DataFrame:
    """Cases as ``judged`` has them, of gold and its matches; without gold, matches are such cases."""
    if gold is None:
        return matches
    its = F.struct(F.array("stage").alias("stage"), "rank", *(F.col(f"its_{c}").alias(c) for c in LOCATORS))
    hits = matches.groupBy("case_id", "evidence_id").agg(F.collect_list(F.struct(its.alias("its"), *(f"by_{x}" for x in LEVELS), required_match().alias("by_required"))).alias("hits"))
    one = F.struct(F.struct(*(c for c in gold.columns if c != "case_id")).alias("gold"), *(applies(x).alias(f"has_{x}") for x in LEVELS), F.coalesce("hits", F.array()).alias("hits"))
    return gold.join(hits, ["case_id", "evidence_id"], "left").groupBy("case_id").agg(F.collect_list(one).alias("items"))


def _at(item: Column, stage: Column) -> Column:
    """Hits of a stage."""
    return F.filter(item["hits"], lambda h: F.array_contains(h["its"]["stage"], stage))


def _survives(hit: Column, stage: Column, document_only: tuple[str, ...]) -> Column:
    """Whether gold survives a stage by a hit: stages that know documents alone are compared by document."""
    return F.when(stage.isin(*document_only), hit["by_document"]).otherwise(hit["by_required"])


def each_item(cases: DataFrame, stages: dict[str, int | None], document_only: tuple[str, ...]) -> DataFrame:
    """case_id, evidence_id, required_level, stage, whether something meets there, by document, article and clause, as gold asks (met) and as the stage can tell (alive)."""
    rows = cases.select("case_id", F.explode("items").alias("item")).select("*", F.explode(F.array(*map(F.lit, stages))).alias("stage")).withColumn("here", _at(F.col("item"), F.col("stage")))
    return rows.select(
        "case_id", "item.gold.evidence_id", "item.gold.required_level", "stage", (F.size("here") > 0).alias("meets"), *(F.exists("here", _field(f"by_{x}")).alias(x) for x in LEVELS),
        F.exists("here", _field("by_required")).alias("met"), F.exists("here", lambda h: _survives(h, F.col("stage"), document_only)).alias("alive"),
    )


def by_stage(cases: DataFrame, stages: dict[str, int | None], document_only: tuple[str, ...]) -> DataFrame:
    """``judged`` cases with stage, capacity and document_only, a row for each stage, and ``here``: each item's first ranks there, and whether it is met."""
    listed = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(cap).cast("int").alias("capacity"), F.lit(s in document_only).alias("document_only")) for s, cap in stages.items()))
    first = lambda x, level: F.array_min(F.transform(F.filter(x["hits"], lambda h: h[f"by_{level}"]), lambda h: h["its"]["rank"]))
    pairs = F.transform("items", lambda i: _named(**{f"has_{x}": i[f"has_{x}"] for x in LEVELS}, hits=_at(i, F.col("stage"))))
    here = F.transform(pairs, lambda x: _named(**{f"has_{k}": x[f"has_{k}"] for k in LEVELS}, **{f"{k}_rank": first(x, k) for k in LEVELS}, met=F.exists(x["hits"], _field("by_required"))))
    return cases.select("*", F.inline(listed)).withColumn("here", here)


def counts() -> list[Column]:
    """Of ``by_stage`` rows, by level: gold, what is found of it to each depth and its first rank."""
    n = lambda when: F.size(F.filter("here", when)).cast("long")
    within = lambda k, depth: lambda x: x[f"has_{k}"] & F.coalesce(x[f"{k}_rank"] <= depth, F.lit(False))
    return [
        *(n(_field(f"has_{k}")).alias(f"{k}_n") for k in LEVELS),
        *(n(within(k, depth)).alias(f"{k}_{depth}") for k in LEVELS for depth in DEPTHS[k]),
        *(F.array_min(F.transform(F.filter("here", _field(f"has_{k}")), _field(f"{k}_rank"))).alias(f"{k}_first") for k in LEVELS),
    ]


def counted_recalls(counts: DataFrame, *keep: str) -> DataFrame:
    """``keep``, stage, level, k, found_n, gold_n, recall and reason of ``counts``."""
    rows = F.array(*(F.struct(F.lit(x).alias("level"), F.lit(k).alias("k"), F.col(f"{x}_{k}").alias("found_n"), F.col(f"{x}_n").alias("gold_n")) for x in LEVELS for k in DEPTHS[x]))
    long = counts.select(*keep, "stage", "capacity", "document_only", F.inline(rows))
    reason = (
        F.when(F.col("document_only") & (F.col("level") != "document"), "stage_does_not_expose_structural_locators")
        .when(F.col("k") > F.col("capacity"), "k_exceeds_configured_capacity")
        .when(F.col("gold_n") == 0, "no_applicable_gold")
    )
    return long.withColumn("reason", reason).select(
        *keep, "stage", "level", "k", "found_n", "gold_n", F.when(F.col("reason").isNull(), F.round(F.col("found_n") / F.col("gold_n"), 4)).alias("recall"), "reason"
    )


def stage_recalls(gold: DataFrame | None, matches: DataFrame, stages: dict[str, int | None], document_only: tuple[str, ...]) -> DataFrame:
    """case_id, stage, level, k, found_n, gold_n, recall and reason; ``stages`` maps each to its capacity. Without ``gold``, here and below, ``matches`` are ``judged`` cases."""
    rows = by_stage(_judged(gold, matches), stages, document_only)
    return counted_recalls(rows.select("case_id", "stage", "capacity", "document_only", *counts()), "case_id")


def stage_bundle(recalls: DataFrame) -> DataFrame:
    """stage, level, k: macro and micro over defined cases, their number, and each reason's count as a map."""
    defined = F.col("recall").isNotNull()
    sums = lambda c: F.sum(F.when(defined, F.col(c)))
    by_reason = recalls.groupBy("stage", "level", "k", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("recall").alias("sum"), sums("found_n").alias("found"), sums("gold_n").alias("gold")
    )
    known = F.col("reason").isNull()
    one = lambda c: F.sum(F.when(known, F.col(c)))
    return by_reason.groupBy("stage", "level", "k").agg(
        F.round(one("sum") / one("n"), 6).alias("macro"),
        F.round(ratio(one("found"), one("gold")), 6).alias("micro"),
        F.coalesce(one("n"), F.lit(0)).alias("scored_cases"),
        F.array_join(F.array_sort(F.collect_list(F.when(~known, F.concat("reason", F.lit(":"), F.col("n").cast("string"))))), ",").alias("skip_reasons"),
    )


def level_reciprocal_ranks(gold: DataFrame | None, matches: DataFrame, stage: str) -> DataFrame:
    """case_id, level and rr of the first candidate that matches any gold at that level; null without applicable gold."""
    rows = F.array(*(F.struct(F.lit(x).alias("level"), F.when(F.col(f"{x}_n") > 0, F.coalesce(F.round(1.0 / F.col(f"{x}_first"), 4), F.lit(0.0))).alias("rr")) for x in LEVELS))
    return by_stage(_judged(gold, matches), {stage: None}, ()).select("case_id", *counts()).select("case_id", F.inline(rows))


def served(stage: str) -> Column:
    """evidence_id of each of a case's items, with the ranks at a stage that meet it, as ``hits``."""
    met = lambda i: F.filter(_at(i, F.lit(stage)), _field("by_required"))
    return F.transform("items", lambda i: _named(evidence_id=i["gold"]["evidence_id"], hits=F.transform(met(i), lambda h: h["its"]["rank"])))


def served_gain(gold: Column, k: int = 10) -> Column:
    """ndcg of a case's gold, an array of (evidence_id, hits): each candidate, in order, serves the smallest item it matches that none before it served."""
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(gold, lambda x: F.coalesce(x["hits"], F.array().cast("array<int>"))))))
    start = F.struct(F.array().cast("array<bigint>").alias("served"), F.lit(0.0).alias("gain"))

    def serve(s: Column, place: Column) -> Column:
        met = F.transform(F.filter(gold, lambda x: F.coalesce(F.array_contains(x["hits"], place), F.lit(False))), lambda x: x["evidence_id"].cast("long"))
        free = F.array_except(met, s["served"])
        gain = F.when(place <= k, 1 / F.log2(place + 1)).otherwise(0.0)
        return F.when(F.size(free) > 0, F.struct(F.array_append(s["served"], F.array_min(free)).alias("served"), (s["gain"] + gain).alias("gain"))).otherwise(s)

    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.size(gold), F.lit(k))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return F.when(F.size(gold) > 0, F.round(F.aggregate(places, start, serve)["gain"] / ideal, 4))


def greedy_ndcg(gold: DataFrame | None, matches: DataFrame, stage: str, k: int = 10) -> DataFrame:
    """case_id and ndcg: each candidate, in order, serves the smallest gold item it matches that none before it served."""
    return _judged(gold, matches).select("case_id", served(stage).alias("gold")).select("case_id", served_gain(F.col("gold"), k).alias("ndcg"))


def first_loss(item: Column, order: tuple[str, ...], document_only: tuple[str, ...]) -> Column:
    """The first stage of ``order`` without a candidate that an item survives in; null where there is none."""
    return F.get(F.filter(F.array(*map(F.lit, order)), lambda s: ~F.exists(_at(item, s), lambda h: _survives(h, s, document_only))), 0)


def first_losses(gold: DataFrame | None, matches: DataFrame, order: tuple[str, ...], document_only: tuple[str, ...]) -> DataFrame:
    """case_id, evidence_id and the ``first_loss`` of each."""
    rows = _judged(gold, matches).select("case_id", F.explode("items").alias("item"))
    return rows.select("case_id", "item.gold.evidence_id", first_loss(F.col("item"), order, document_only).alias("stage"))


def case_bundle(gold: DataFrame | None, matches: DataFrame, final: str) -> DataFrame:
    """case_id, required_n, found_n, all_required and coverage at the last stage."""
    found = F.filter("items", lambda i: F.exists(_at(i, F.lit(final)), _field("by_required")))
    rows = _judged(gold, matches).select("case_id", F.size("items").cast("long").alias("required_n"), F.size(found).cast("long").alias("found_n"))
    return rows.select("*", (F.col("found_n") == F.col("required_n")).alias("all_required"), F.round(F.col("found_n") / F.col("required_n"), 4).alias("coverage"))


def survival(candidates: DataFrame, cases: DataFrame) -> DataFrame:
    """stage and mean number of candidates over all cases, those without any included."""
    total = cases.select("case_id").distinct().count()
    return candidates.groupBy("stage").agg(F.round(F.count(F.lit(1)) / F.lit(max(total, 1)), 2).alias("mean_candidates"))


def operational_rates(outcomes: DataFrame) -> DataFrame:
    """Counts and rates of cases without candidates and of failed ones; ``outcomes``: case_id, n_candidates, status."""
    n = F.count(F.lit(1))
    rate = lambda when: F.round(ratio(F.count_if(when), n), 4)
    return outcomes.agg(
        n.alias("cases"),
        rate((F.col("n_candidates") == 0) & (F.col("status") == "ok")).alias("no_candidate_rate"),
        rate(F.col("status") == "retrieval_error").alias("retrieval_error_rate"),
        rate(F.col("status") == "reranker_error").alias("reranker_error_rate"),
    )
