"""Measures of answers against reference answers."""

from __future__ import annotations

from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from quern.functions import text as T


# Multiset overlaps are linear in Python's counters, while array functions would compare all pairs of grams; the
# texts arrive in Arrow batches and are normalised before, on the JVM.


def _grams(items: str | list[str], n: int) -> Counter:
    return Counter(items[i : i + n] for i in range(len(items) - n + 1))


def _f1(a: Counter, b: Counter) -> float:
    common = (a & b).total()
    return _rounded(2.0 * common / (a.total() + b.total())) if common else 0.0


def _rounded(x: float) -> float:
    """Four digits, half up on the decimal form."""
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


@F.pandas_udf(DoubleType())
def _tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = [(Counter(x.split()), Counter(y.split())) for x, y in zip(a, b, strict=True)]
    return pd.Series([_f1(x, y) if x or y else 1.0 for x, y in pairs], dtype=float)


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([(Counter(x.split()) & Counter(y.split())).total() for x, y in zip(a, b, strict=True)], dtype="int64")


@F.pandas_udf(DoubleType())
def _gram_f1(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_f1(_grams(x, k), _grams(y, k)) if x and y else float(x == y) for x, y, k in zip(a, b, n, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def _chrf(a: pd.Series, b: pd.Series, most: pd.Series, beta: pd.Series) -> pd.Series:
    def one(x: str, y: str, most: int, square: float) -> float:
        if not x or not y:
            return float(x == y)
        used = range(1, min(most, len(x), len(y)) + 1)
        grams = [(_grams(x, n), _grams(y, n)) for n in used]
        precision = sum((p & r).total() / p.total() for p, r in grams) / len(grams)
        recall = sum((p & r).total() / r.total() for p, r in grams) / len(grams)
        if not precision and not recall:
            return 0.0
        return _rounded((1 + square) * precision * recall / (square * precision + recall))

    return pd.Series([one(x, y, m, z * z) for x, y, m, z in zip(a, b, most, beta, strict=True)], dtype=float)


def token_f1(answer: Column, reference: Column) -> Column:
    """F1 of words as multisets; both empty is 1, one empty 0."""
    return _tokens(T.metric_text(answer), T.metric_text(reference))


def gram_f1(answer: Column, reference: Column, n: int = 3) -> Column:
    """F1 of character n-grams as multisets."""
    return _gram_f1(T.metric_text(answer), T.metric_text(reference), F.lit(n))


def chrf(answer: Column, reference: Column, most: int = 6, beta: float = 2.0) -> Column:
    """Character n-grams of 1 to ``most`` without blanks; precision and recall are averaged over the n that both texts have."""
    p, r = (F.replace(T.metric_text(c), F.lit(" "), F.lit("")) for c in (answer, reference))
    return _chrf(p, r, F.lit(most), F.lit(beta))


def _longest_common(x: list[str], y: list[str]) -> int:
    """Length of the longest common subsequence by bit rows: a word of y turns on the lowest free bit in each block."""
    places: dict[str, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    row, full = (1 << len(x)) - 1, (1 << len(x)) - 1
    for w in y:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(x) - row.bit_count()


@F.pandas_udf(DoubleType())
def _rouge(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(p: str, r: str) -> float:
        x, y = p.split(), r.split()
        if not x or not y:
            return float(x == y)
        return round(2 * _longest_common(x, y) / (len(x) + len(y)), 4)

    return pd.Series([one(p, r) for p, r in zip(a, b, strict=True)], dtype=float)


def rouge_l(answer: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of words."""
    return _rouge(T.metric_text(answer), T.metric_text(reference))


def refusal(answer: Column, has_context: Column, refusals: tuple[str, ...], errors: tuple[str, ...], disclaimers: tuple[str, ...], claims: str) -> Column:
    """technical_error, no_evidence, mixed_claim_refusal, pure_refusal, disclaimer or normal_answer, by the first rule that holds."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    said = lambda phrases: F.coalesce(*[F.when(F.contains(low, F.lit(p)), True) for p in phrases], F.lit(False))
    long = (F.size(T.spaced(answer)) > 50) | low.rlike(claims)
    return (
        F.when(said(errors), "technical_error")
        .when(~has_context, "no_evidence")
        .when(said(refusals) & long, "mixed_claim_refusal")
        .when(said(refusals), "pure_refusal")
        .when(said(disclaimers), "disclaimer")
        .otherwise("normal_answer")
    )


def entities(c: Column) -> dict[str, Column]:
    """Numbers, dates and runs of capitalised words of over three characters."""
    take = lambda pattern: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))
    return {
        "numbers": take(r"[0-9]+(?:[.,][0-9]+)?"),
        "dates": take(r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"),
        "names": F.filter(take(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"), lambda x: F.length(x) > 3),
    }


def answer_pairs(turns: DataFrame) -> DataFrame:
    """Each assistant's turn with the user's turn before it: conv_id, turn, reference (the user's) and answer."""
    users = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(users, ["conv_id", "turn"])


def overlap(answer: Column, reference: Column) -> dict[str, Column]:
    """Precision and recall of words as multisets, four digits; both empty is 1, one empty 0."""
    a, b = T.metric_text(answer), T.metric_text(reference)
    n, m = F.size(T.spaced(a)), F.size(T.spaced(b))
    common = _common(a, b)
    share = lambda k: F.when((n == 0) & (m == 0), 1.0).when(k == 0, 0.0).otherwise(F.round(common / k, 4))
    return {"precision": share(n), "recall": share(m)}


def set_scores(found: Column, wanted: Column) -> dict[str, Column]:
    """Precision, recall and the share of wrong ones of two sets; null where nothing is wanted."""
    common, n, m = F.size(F.array_intersect(found, wanted)), F.size(F.array_distinct(found)), F.size(F.array_distinct(wanted))
    share = lambda k, d: F.when(m > 0, F.when(d > 0, F.round(k / d, 4)).otherwise(0.0))
    return {"precision": share(common, n), "recall": share(common, m), "invalid_rate": share(n - common, n)}


def legal_citations(c: Column) -> Column:
    """Distinct articles, clauses and chapters that a text cites, with their law where it follows, in lower case."""
    # The words of citations.
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?iu)(?<![\p{L}\p{N}_])(?:Điều|Khoản|Chương)\s+[0-9]+[A-Za-z]?(?:\s+Luật\s+[0-9]{1,4}/[0-9]{4}/[A-ZĐ0-9-]+)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: T.clean(F.lower(x))))


#: Statuses of cases whose answers are not judged.
SKIPPED = ("input_guardrail_error", "output_guardrail_error", "retrieval_error", "reranker_error")


def case_bundle(cases: DataFrame) -> DataFrame:
    """Every measure of an answer in one row: ``cases`` (key columns, answer, reference, category, status, answerable) with its measures.

    Citations are null where the reference cites nothing. Null statuses are ok.
    """
    status = F.coalesce("status", F.lit("ok"))
    cites = set_scores(F.col("_a"), F.col("_r"))
    same = (T.metric_text(F.col("answer")) == T.metric_text(F.col("reference"))).cast("double")
    held = cases.withColumn("_a", legal_citations(F.col("answer"))).withColumn("_r", legal_citations(F.col("reference")))
    return held.select(
        *(c for c in cases.columns if c not in ("answer", "reference")),
        (~status.isin(*SKIPPED)).alias("applicable"),
        F.when(status.isin(*SKIPPED), status).alias("skip_reason"),
        F.col("category").isin("pure_refusal", "no_evidence").alias("is_refusal"),
        same.alias("exact_match"),
        *(v.alias(f"token_{k}") for k, v in overlap(F.col("answer"), F.col("reference")).items()),
        token_f1(F.col("answer"), F.col("reference")).alias("token_f1"),
        gram_f1(F.col("answer"), F.col("reference")).alias("char_f1"),
        rouge_l(F.col("answer"), F.col("reference")).alias("rouge_l"),
        chrf(F.col("answer"), F.col("reference")).alias("chrf"),
        *(v.alias(f"citation_{k}") for k, v in cites.items()),
    )


MEANS = ("exact_match", "token_precision", "token_recall", "token_f1", "char_f1", "rouge_l", "chrf", "citation_precision", "citation_recall", "citation_invalid_rate")


def breakdown(bundles: DataFrame) -> DataFrame:
    """kind (skip_reason or category), name and n: why cases are not judged, and what the judged answers are."""
    rows = F.array(F.struct(F.lit("skip_reason").alias("kind"), F.col("skip_reason").alias("name")), F.struct(F.lit("category").alias("kind"), F.when(F.col("applicable"), F.col("category")).alias("name")))
    return bundles.select(F.inline(rows)).where(F.col("name").isNotNull()).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def answer_report(bundles: DataFrame) -> DataFrame:
    """One row over cases of ``case_bundle``: counts, reasons, refusals, pass rate and means over judged cases.

    Cases that aren't said to be answerable or not count as either. Rates without a case are null.
    """
    scored = F.col("applicable")
    can, cannot = scored & F.coalesce("answerable", F.lit(True)), scored & ~F.coalesce("answerable", F.lit(False))
    right = F.count_if(cannot & F.col("category").isin("pure_refusal", "no_evidence"))
    rate = lambda a, b: F.round(F.when(b > 0, a / b), 4)
    return bundles.agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if(scored).alias("scored_cases"), F.count_if(~scored).alias("skipped_cases"),
        F.count_if(can).alias("answerable_count"), F.count_if(cannot).alias("unanswerable_count"),
        rate(F.count_if(scored & (F.col("category") == "mixed_claim_refusal")), F.count_if(scored)).alias("mixed_claim_refusal_rate"),
        rate(right, F.count_if(scored & F.col("is_refusal"))).alias("refusal_precision"), rate(right, F.count_if(cannot)).alias("refusal_recall"), rate(right, F.count_if(cannot)).alias("unanswerable_accuracy"),
        rate(F.count_if(can & (F.col("token_f1") >= 0.5)), F.count_if(can)).alias("answer_similarity_pass_rate"),
        *(F.round(F.avg(F.when(scored, F.col(c))), 4).alias(c) for c in MEANS),
    )


def context_hits(contexts: DataFrame, references: DataFrame, share: float = 0.6) -> DataFrame:
    """case_id, hit, recall and rr: a reference is found in the first context that holds it, or ``share`` of its terms.

    ``contexts``: case_id, rank, text. ``references``: case_id, reference_id, text. Undefined (null) without references.
    """
    terms = lambda c: F.array_distinct(T.terms(c))
    body = lambda c: T.clean(F.lower(c))
    told = contexts.select("case_id", "rank", body(F.col("text")).alias("body"), terms(F.col("text")).alias("has"))
    asked = references.select("case_id", "reference_id", body(F.col("text")).alias("wanted"), terms(F.col("text")).alias("asked"))
    near = F.when(F.size("asked") > 0, F.size(F.array_intersect("asked", "has")) / F.size("asked")).otherwise(0.0)
    found = asked.join(told, "case_id").where(((F.col("wanted") != "") & F.contains("body", "wanted")) | (near >= share))
    ranks = found.groupBy("case_id", "reference_id").agg(F.min("rank").alias("rank"))
    held = asked.select("case_id", "reference_id").join(ranks, ["case_id", "reference_id"], "left").groupBy("case_id")
    return held.agg(F.bool_or(F.col("rank").isNotNull()).alias("hit"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("recall"), F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("rr"))


def sane_rewrite(rewritten: Column, query: Column) -> Column:
    """Whether a rewrite has two words, is not mostly repetition from six words on, and is at most twice as long."""
    words = T.spaced(rewritten)
    unique = F.size(F.array_distinct(F.transform(words, F.lower))) / F.greatest(F.size(words), F.lit(1))
    return F.coalesce((F.size(words) >= 2) & ((F.size(words) < 6) | (unique >= 0.5)) & (F.length(rewritten) <= 2 * F.length(query)), F.lit(False))


def presented(context: Column, source: str = "source:", title: str = "title:") -> Column:
    """citation (a first line in brackets), title, url (http or https alone) and excerpt of a context's lines."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(context, F.lit("")), r"\r\n?", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    after = lambda mark: F.trim(F.substring(F.get(F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit(mark))), 0), len(mark) + 1, 1 << 20))
    bracket = lambda x: x.rlike(r"^\[.*\]$")
    url = after(source)
    rest = F.filter(lines, lambda x: ~bracket(x) & ~F.startswith(F.lower(x), F.lit(source)) & ~F.startswith(F.lower(x), F.lit(title)))
    return F.struct(
        F.trim(F.regexp_extract(F.get(F.filter(lines, bracket), 0), r"^\[(.*)\]$", 1)).alias("citation"),
        F.nullif(after(title), F.lit("")).alias("title"),
        F.when(url.rlike(r"(?i)^https?://"), url).alias("url"),
        F.array_join(rest, "\n").alias("excerpt"),
    )


def salvaged_json(c: Column, schema: str) -> Column:
    """The object within a fenced or plain answer, parsed; null where there is none or it is broken."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(c)
    return F.from_json(F.regexp_extract(body, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


#: Fixed value: the label before a context, without its number.
CONTEXT_LABEL = "[Tài liệu tham khảo #"


def bounded_text(contexts: DataFrame, most: int, label: str = CONTEXT_LABEL) -> DataFrame:
    """key, context and tokens: labelled contexts by rank under one budget of tokens, labels included, the last one cut.

    ``contexts``: key, rank, text. A context without tokens, or one that had to be cut, ends the text. A context takes its
    label and a token at least, so no more than ``most`` over that many, each of ``most`` tokens at most, are ever held. Keys
    for which nothing fits have no row.
    """
    of = Window.partitionBy("key").orderBy("rank")
    head = len(label.split())
    numbered = contexts.withColumn("n", F.row_number().over(of)).where(F.col("n") <= most // (head + 1) + 1)
    cut = numbered.select("key", "n", F.slice(T.spaced(F.col("text")), 1, most + 1).alias("tokens"))
    before = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    size = F.size("tokens")
    room = most - F.coalesce(F.sum(head + size).over(before), F.lit(0)) - head
    open_ = ~F.coalesce(F.bool_or(size == 0).over(before), F.lit(False))
    kept = cut.withColumn("room", room).withColumn("open", open_).where((F.col("room") > 0) & F.col("open") & (size > 0)).withColumn("tokens", F.slice("tokens", 1, F.col("room").cast("int")))
    block = F.concat(F.lit(label), F.col("n").cast("string"), F.lit("]\n"), F.concat_ws(" ", "tokens"))
    return kept.groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("block")))), lambda x: x["block"]), "\n\n").alias("context"), F.sum(F.size("tokens") + head).alias("tokens")
    )
