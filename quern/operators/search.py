"""Searches in tiers, and which hits and scores may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import vectors
from quern.operators.ranking import bounded, containment, ranked, together
from quern.operators.structure import name_uuid
from quern.sources.scratch import written


def tiered(queries: DataFrame, tiers: list[tuple[str, DataFrame]], most: int) -> DataFrame:
    """query_id, doc_id, tier and rank: each query's documents of the first tier that contains it, ``most`` by doc_id.

    A tier is asked only for queries that those before it left open. Queries without id, text or match have no rows.
    """
    left, parts = queries.where(F.col("query_id").isNotNull()), []
    for name, docs in tiers:
        hits = written(containment(left, docs), "tier")
        parts.append(ranked(hits, most, F.asc("doc_id")).select("query_id", "doc_id", F.lit(name).alias("tier"), "rank"))
        left = written(left.join(hits.select("query_id").distinct(), "query_id", "left_anti"), "open")
    return together(parts)


def valid_hits(hits: DataFrame, store: DataFrame, revision: str) -> DataFrame:
    """query_id, doc_id and lexical of hits whose payload agrees with the stored document.

    ``hits``: query_id, doc_id, rank, lexical, revision, store_key, content_sha256; ``store``: doc_id, content_sha256. A
    payload counts with this revision and its own key; of several of a document the first by rank. Its hash must be the
    stored one, except where a lexical hit names the document too: that one is read from the store. Nulls agree with nothing.
    """
    sound = F.col("lexical") | ((F.col("revision") == revision) & (F.col("store_key") == F.col("doc_id")))
    told = F.min(F.when(~F.col("lexical"), F.struct("rank", "content_sha256")))["content_sha256"]
    first = hits.where(sound).groupBy("query_id", "doc_id").agg(F.bool_or("lexical").alias("lexical"), told.alias("told"))
    known = store.select("doc_id", F.col("content_sha256").alias("stored")).distinct()
    return first.join(known, "doc_id").where(F.col("lexical") | (F.col("told") == F.col("stored"))).select("query_id", "doc_id", "lexical").distinct()


def usable(score: Column, least: float) -> Column:
    """Whether a score is a finite number of at least ``least``; null is not."""
    return F.coalesce(~F.isnan(score) & (F.abs(score) != float("inf")) & (score >= least), F.lit(False))


def cache_lookup(queries: DataFrame, entries: DataFrame, revision: str, least: float = 0.96) -> DataFrame:
    """query_id, entry_id, score and response of the nearest entry of a revision, where its cosine is ``least`` or more.

    ``queries``: query_id, embedding. ``entries``: entry_id, embedding, revision, response. Other revisions are never looked
    at; ties go to the smaller id. Vectors of null or of zeros match nothing.
    """
    held = entries.where(F.col("revision") == revision)
    near = vectors.closest(queries, held.withColumnRenamed("entry_id", "vec_id"), least)
    best = ranked(near, 1, F.desc("score"), F.asc("vec_id")).select(F.col("query_id").alias("_query"), F.col("vec_id").alias("_entry"))
    asked = queries.select("query_id", vectors.doubles(F.col("embedding")).alias("q")).join(bounded(best), F.col("query_id").eqNullSafe(F.col("_query")))
    score = F.round(vectors.cosine(F.col("q"), F.col("v")), 6)
    # ids may be repeated, so what they name is scored once more
    named = held.select("entry_id", "response", vectors.doubles(F.col("embedding")).alias("v")).join(bounded(asked.select("query_id", "q", "_entry")), F.col("entry_id").eqNullSafe(F.col("_entry")))
    told = named.select("query_id", "entry_id", "response", score.alias("score")).where(F.col("score") >= least)
    return ranked(told, 1, F.desc("score"), F.asc("entry_id")).select("query_id", "entry_id", "score", "response")


def cache_key(query: Column, revision: str) -> Column:
    """The id of a question's entry under a revision: questions that differ in case or white space share it."""
    return name_uuid(F.concat(F.lit(f"{revision}\n"), F.lower(T.clean(query))))
