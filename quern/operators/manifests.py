"""What a run declares: its configuration's fingerprint, the capacities that its profile gives each stage, its report as markdown.

Configurations are columns of text, whole numbers or booleans; null ones stay, as null. Rows of the same configuration have
the same fingerprint, and the columns' order doesn't matter. Empty tables have no rows, or the fingerprint of no cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import gates, identity

#: The limits of a profile and of the index that it may go through instead; a row has them as columns.
LIMITS = ("title_limit", "retrieval_document_limit", "resolved_document_limit", "local_chunks_per_document", "rerank_input_limit", "rerank_return_limit", "final_evidence_limit")
STRUCTURAL_LIMITS = ("dense_top_k", "sparse_top_k", "fused_limit", "structural_rerank_input_limit", "structural_rerank_return_limit", "structural_final_evidence_limit")


def _json(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType)):
        raise TypeError(f"{name} is {kind.simpleString()}: only text, whole numbers and booleans have one way to be written")
    listed = F.to_json(F.array(F.col(f"`{name}`")), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f'"{name}": '), F.substring(listed, F.lit(2), F.length(listed) - 2))


def configuration_json(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """A configuration as one JSON object: names sorted, a space after each comma and colon."""
    if not columns:
        return F.lit("{}")
    return F.concat(F.lit("{"), F.concat_ws(", ", *(_json(df, c) for c in sorted(columns))), F.lit("}"))


def fingerprints(df: DataFrame, columns: tuple[str, ...], out: str = "fingerprint") -> DataFrame:
    """``df`` with the SHA-256 of each row's configuration."""
    return df.withColumn(out, F.sha2(configuration_json(df, columns), 256))


def suite_fingerprint(cases: DataFrame, key: str, columns: tuple[str, ...], configuration: str) -> DataFrame:
    """cases and fingerprint of a suite: the SHA-256 of its configuration (JSON) and of its cases' digests in the order of ``key``.

    Digests are combined by a tree of runs, so no task holds all cases. Repeated cases of one key count once.
    """
    digests = fingerprints(cases, columns, "_digest").select(F.col(key).alias("_key"), F.col("_digest"))
    root = identity.ordered_digest(digests, "_digest", "_key")
    return root.select(F.col("ids").alias("cases"), F.sha2(F.concat_ws("\n", F.lit(configuration), "ordered_ids_sha256"), 256).alias("fingerprint"))


def stage_capacities(profiles: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the capacity of each stage (null: without a limit) of profiles with ``LIMITS``, ``STRUCTURAL_LIMITS`` and ``structural``.

    A structural run takes the limits of its index; any other those of the profile, whose merged stage holds both lanes and
    whose local stage some chunks of each document. What follows from a missing limit has none.
    """
    structural = F.coalesce(F.col("structural"), F.lit(False))
    either = lambda index, profile: F.when(structural, index).otherwise(profile)
    c, none = F.col, F.lit(None).cast("long")
    return profiles.select(
        *keep,
        either(c("dense_top_k"), c("retrieval_document_limit")).cast("long").alias("dense"),
        either(c("sparse_top_k"), c("title_limit")).cast("long").alias("title"),
        either(c("fused_limit").cast("long"), c("title_limit").cast("long") + c("retrieval_document_limit")).alias("merged"),
        either(c("fused_limit"), c("resolved_document_limit")).cast("long").alias("resolved"),
        either(c("fused_limit").cast("long"), none).alias("structural_chunks"),
        either(none, c("resolved_document_limit").cast("long") * c("local_chunks_per_document")).alias("local_chunks"),
        either(c("structural_rerank_input_limit"), c("rerank_input_limit")).cast("long").alias("rerank_input"),
        either(c("structural_rerank_return_limit"), c("rerank_return_limit")).cast("long").alias("rerank_return"),
        either(c("structural_final_evidence_limit"), c("final_evidence_limit")).cast("long").alias("final"),
    )


STAGES = ("dense", "title", "merged", "resolved", "structural_chunks", "local_chunks", "rerank_input", "rerank_return", "final")


def by_stage(capacities: DataFrame, *keys: str) -> DataFrame:
    """keys, stage and capacity of ``stage_capacities``: a row for each stage."""
    return capacities.select(*keys, F.inline(F.array(*(F.struct(F.lit(s).alias("stage"), F.col(s).alias("capacity")) for s in STAGES))))


def markdown(report: DataFrame) -> DataFrame:
    """section, place (of a line in it) and line of a run's report as markdown: a table for each measure, by stage, level and k.

    A report has a row for each stage, level and k, so its order is one task's work however large the run was.
    """
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    scored = F.concat(F.col("scored_cases").cast("string"), F.lit("/"), (F.col("scored_cases") + F.col("skipped_cases")).cast("string"))
    values = [cell("stage"), cell("level"), cell("k"), gates.shown(F.col("macro")), gates.shown(F.col("micro")), scored, F.when(F.col("skip_reasons") == "", "-").otherwise(F.col("skip_reasons"))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))
    order = F.struct(F.col("stage"), F.coalesce("level", F.lit("")).alias("level"), F.coalesce("k", F.lit(0)).alias("k"), line.alias("line"))
    rows = report.groupBy(F.col("measure").alias("section")).agg(F.array_sort(F.collect_list(order)).alias("rows"))
    head = [F.concat(F.lit("## "), "section"), F.lit(""), F.lit("| stage | level | k | macro | micro | scored | skipped for |"), F.lit("|-|-|-|-|-|-|-|")]
    lines = F.concat(F.array(*head), F.transform("rows", lambda r: r["line"]), F.array(F.lit("")))
    return rows.select("section", F.posexplode(lines).alias("place", "line"))


def markdown_text(report: DataFrame, title: str) -> str:
    """The whole report, for a file."""
    lines = [r.line for r in markdown(report).orderBy("section", "place").collect()]  # a report's rows, not a run's
    return "\n".join([f"# {title}", "", *lines])


def pilot_decisions(runs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and decision of each run: blocked by errors of scope, then by technical ones or drift, else by its quality.

    ``runs``: scope_errors, technical_errors, drift (null: none), document, article and clause recall, required coverage and
    rates of no_candidate, retrieval_error and reranker_error. A missing recall or coverage is 0, a missing rate is 0.
    """
    at = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    some = lambda name: F.coalesce(F.col(name) > 0, F.lit(False))
    clean = (at("no_candidate") == 0) & (at("retrieval_error") == 0) & (at("reranker_error") == 0)
    good = (at("document") == 1) & (at("article") >= 0.95) & (at("clause") >= 0.9) & (at("required") >= 0.95) & clean
    blocked = F.when(some("scope_errors"), "BLOCKED_SCOPE").when(some("technical_errors") | F.coalesce("drift", F.lit(False)), "BLOCKED_TECHNICAL")
    return runs.select(*keep, F.coalesce(blocked, F.when(good, "PASS_PILOT").otherwise("FAIL_QUALITY")).alias("decision"))
