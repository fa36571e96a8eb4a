"""Evidence: identities, labels, manifests, decisions and candidates for reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranking import together
from quern.sources.scratch import written


#: Documents, or cases, of one key in a block.
BLOCK_ROWS = 1024


def _blocks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """way, key and ``name``: the values of each key in arrays of some ``BLOCK_ROWS``, dealt by their hashes, so that no task holds a key's rows."""
    sizes = written(rows.groupBy("way", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")), "sizes")
    dealt = rows.join(sizes, ["way", "key"]).withColumn("block", F.pmod(F.xxhash64(value, "row"), "blocks"))
    values = F.transform(F.collect_list(F.struct(F.col(value).alias("x"))), lambda s: s["x"])  # nulls stay
    return dealt.groupBy("way", "key", "block").agg(values.alias(name)).drop("block")


def _resolved(found: DataFrame, *columns: Column) -> DataFrame:
    """``columns``, method and complete by ``way``; null: nothing was found."""
    way = F.col("way")
    names = F.when(way == 1, "exact_doc_id").when(way == 2, "exact_source_url").when(way == 3, "exact_metadata_doc_number").when(way == 4, "lexical_candidate_fallback")
    return found.select(*columns, F.coalesce(names, F.lit("not_applicable")).alias("method"), F.coalesce(way < 4, F.lit(True)).alias("complete"))


def _expanded(asked: DataFrame, members: DataFrame) -> DataFrame:
    """case_id, document_id, method and complete of every case and every document of its key: blocks meet, and pairs of rows are made where they are read."""
    met = _blocks(members.withColumn("row", F.lit(0)), "found", "documents").join(_blocks(asked, "case_id", "cases"), ["way", "key"])
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _resolved(met, "cases", "documents").repartition(parts)
    return dealt.select("method", "complete", "documents", F.explode("cases").alias("case_id")).select("case_id", F.explode("documents").alias("document_id"), "method", "complete")


def resolve_identities(hints: DataFrame, metadata: DataFrame, lexical: DataFrame | None = None) -> DataFrame:
    """case_id, document_id, method and complete of each hint by the first way that finds anything.

    Ways: id, URL, number without spaces in upper case, then ``lexical`` (case_id, document_id: candidates, so
    incomplete). ``hints``: case_id, document_id, source_url, document_number. ``metadata``: the last three.

    A case may name a key of many documents, so the result may be quadratic: a case's way is found on the keys alone, and
    only that way's documents are listed, at the end, without a shuffle of pairs.
    """
    number = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    key = lambda way, c: F.struct(F.lit(way).alias("way"), c.alias("key"))
    told = F.array(key(2, F.col("source_url")), key(3, number(F.col("document_number"))))
    members = written(metadata.select(F.col("document_id").alias("found"), F.inline(told)).where(F.col("key") != "").distinct(), "members")
    named = F.array(key(2, F.trim("source_url")), key(3, number(F.col("document_number"))))
    asked = hints.select("case_id", F.inline(named)).where(F.col("key") != "").join(members.select("way", "key").distinct(), ["way", "key"])
    ids = metadata.select(F.col("document_id").alias("found")).distinct()
    exact = hints.join(ids, F.col("document_id") == F.col("found")).select("case_id", F.lit(1).alias("way"), F.lit(None).cast("string").alias("key"), "found")
    every = exact.unionByName(asked.select("case_id", "way", "key", F.lit(None).cast(exact.schema["found"].dataType).alias("found")))
    if lexical is not None:
        every = every.unionByName(lexical.select("case_id", F.lit(4).alias("way"), F.lit(None).cast("string").alias("key"), F.col("document_id").alias("found")))
    every = written(every.distinct(), "ways")
    first = every.groupBy("case_id", "way").agg(F.count("key").alias("keys")).groupBy("case_id").agg(F.min(F.struct("way", "keys")).alias("x")).select("case_id", "x.way", "x.keys")
    rows = hints.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    kept = written(every.join(first.join(rows, "case_id"), ["case_id", "way"]), "kept")
    again = lambda df: df.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("row"))  # noqa: E731  a hint's row for each of its case
    case, document = F.col("case_id"), F.col("found").alias("document_id")
    parts = [_resolved(again(kept.where("keys = 0")), case, document), _expanded(again(kept.where("keys = 1")).select("case_id", "way", "key", "row"), members)]
    several = kept.where("keys > 1")
    if not several.isEmpty():  # keys of one case may share documents
        pairs = _expanded(several.select("case_id", "way", "key", F.lit(1).alias("row")), members).distinct()
        parts.append(again(pairs.join(rows, "case_id")).select("case_id", "document_id", "method", "complete"))
    none = hints.select("case_id").join(first, "case_id", "left_anti")
    parts.append(_resolved(none.withColumn("way", F.lit(None).cast("int")), case, F.lit(None).cast(exact.schema["found"].dataType).alias("document_id")))
    return together(parts)


def patched_labels(labels: DataFrame, decisions: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """``labels`` with the decisions' values where they have some, and whether anything changed."""
    new = decisions.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    joined = labels.join(new, key, "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c)))
    values = [F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in labels.columns]
    return joined.select(*values, changed.alias("changed"))


def decision_faults(queue: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """key and fault (missing, extra or duplicate) of decisions that don't match the queue one to one."""
    asked = queue.select(key).distinct().withColumn("asked", F.lit(True))
    made = decisions.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return asked.join(made, key, "full_outer").select(key, fault.alias("fault")).where(F.col("fault").isNotNull())


def manifest_faults(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name and fault (missing, unexpected, size or hash) of files against a manifest (name, size, sha256).

    ``files`` comes from the binaryFile source.
    """
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("has"), F.sha2("content", 256).alias("hash"))
    fault = F.when(F.col("hash").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("has") != F.col("size"), "size").when(F.col("hash") != F.col("sha256"), "hash")
    return manifest.join(there, "name", "full_outer").select("name", fault.alias("fault")).where(F.col("fault").isNotNull())


def rerank_candidates(hits: DataFrame, cap: int, most: int) -> DataFrame:
    """query_id, chunk_id and place of up to ``most`` chunks in three phases.

    First those with a score, best first, ``cap`` for a document; then the first chunk of each document not yet there;
    then the others in their order, while the cap allows. ``hits``: query_id, chunk_id, doc_id, position, score.
    The cap and the phases are ranks within a query and document, so no chunk is looked at twice.
    """
    by_doc = Window.partitionBy("query_id", "doc_id")
    scored = hits.withColumn("turn", F.row_number().over(by_doc.orderBy((F.col("score") > 0).desc(), F.desc("score"), "position")))
    first = scored.withColumn("early", (F.col("score") > 0) & (F.col("turn") <= cap))
    phased = first.withColumn("has", F.max("early").over(by_doc)).withColumn("later", F.row_number().over(by_doc.orderBy("early", "position")))
    free = F.greatest(cap - F.count_if(F.col("early")).over(by_doc), F.lit(0))
    phase = F.when(F.col("early"), 1).when(~F.col("has") & (F.col("later") == 1), 2).when(F.col("later") <= free, 3)
    kept = phased.withColumn("phase", phase).where(F.col("phase").isNotNull())
    order = Window.partitionBy("query_id").orderBy("phase", F.when(F.col("phase") == 1, -F.col("score")), "position")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "chunk_id", "doc_id", "place")
