"""Cases, labels and runs: selection, eligibility, outcomes, coverage and plans. Nulls fail every condition; empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.measures import ratio

POLICIES = ("all-required-verified", "any-verified", "all-verified", "none")


def label_counts(labels: DataFrame) -> DataFrame:
    """case_id with its labels, required ones, and how many of either are verified."""
    verified = F.col("status") == "verified"
    return labels.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("labels"),
        F.count_if("required").alias("required"),
        F.count_if(verified).alias("verified"),
        F.count_if(F.col("required") & verified).alias("required_verified"),
    )


def selected_cases(cases: DataFrame, labels: DataFrame, policy: str, include_unanswerable: bool = False, limit: int | None = None) -> DataFrame:
    """case_id of cases (case_id, answerable) that a policy admits, by id; a case without labels meets no condition on all of them."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    n = F.coalesce(F.col("labels"), F.lit(0))
    meets = {
        "all-required-verified": (F.col("required") > 0) & (F.col("required_verified") == F.col("required")),
        "any-verified": F.col("verified") > 0,
        "all-verified": (n > 0) & (F.col("verified") == n),
        "none": F.lit(True),
    }[policy]
    joined = cases.join(label_counts(labels), "case_id", "left")
    open_ = F.col("answerable") | F.lit(include_unanswerable)
    need = F.lit(True) if policy == "none" else F.col("answerable")
    found = joined.where(open_ & need & F.coalesce(meets, F.lit(False))).select("case_id").orderBy("case_id")
    return found if limit is None else found.limit(limit)


def eligible_cases(cases: DataFrame, labels: DataFrame) -> DataFrame:
    """Answerable cases with a required label that is not verified yet."""
    counts = label_counts(labels).where(F.col("required") > F.col("required_verified")).select("case_id")
    return cases.where("answerable").join(counts, "case_id", "left_semi").select("case_id")


def audit_statuses(labels: DataFrame) -> DataFrame:
    """case_id and its status: verified where all labels are, partial where some are, else the first label's by id."""
    verified = F.col("status") == "verified"
    first = F.min_by("status", "evidence_id")
    return labels.groupBy("case_id").agg(F.when(F.bool_and(verified), "verified").when(F.bool_or(verified), "partial").otherwise(first).alias("audit"))


def diversity(labels: DataFrame) -> DataFrame:
    """key and n of verified labels by document; a label counts under its id and under its number."""
    keys = F.array_compact(F.array(F.col("document_id").cast("string"), F.nullif(F.trim("document_number"), F.lit(""))))
    return labels.where(F.col("status") == "verified").select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def earliest(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Each group's row of least ``order``."""
    others = [c for c in rows.columns if c not in (group, *order)]
    return rows.groupBy(group).agg(F.min(F.struct(*order, *others)).alias("x")).select(group, "x.*")


def outcomes(results: DataFrame, passed: float) -> DataFrame:
    """Rates over answerable and unanswerable cases in one pass; failures of the service stay in all denominators.

    ``results``: answerable, completed, refused, has_context, accuracy.
    """
    asked, none = F.col("answerable"), ~F.col("answerable")
    grounded = asked & F.col("completed") & F.col("has_context") & ~F.col("refused")
    right = grounded & F.coalesce(F.col("accuracy") >= passed, F.lit(False))
    declined = none & F.col("completed") & F.col("refused")
    count = F.count_if
    rate = lambda a, b: F.round(F.coalesce(ratio(a, b), F.lit(0.0)), 6)
    return results.agg(
        count(asked).alias("answerable_count"),
        count(none).alias("unanswerable_count"),
        rate(count(right), count(asked)).alias("answerable_accuracy"),
        rate(count(grounded), count(asked)).alias("grounded_generation_rate"),
        rate(count("completed"), F.count(F.lit(1))).alias("service_completion_rate"),
        rate(count(declined), count(none)).alias("unanswerable_accuracy"),
        rate(count(right) + count(declined), F.count(F.lit(1))).alias("overall_accuracy"),
    )


def code_checks(status: Column, technical_error: Column, contexts: Column, citations: Column) -> Column:
    """Array of (check, passed, value): the request ended, has contexts, its answer has citations. Nulls fail."""
    error = F.coalesce(technical_error, F.lit(False))
    some = lambda n: F.coalesce(n, F.lit(0)) > 0
    rows = (
        ("request_completed", F.coalesce(status.isin("ok", "cache_hit"), F.lit(False)) & ~error, F.coalesce(status, F.lit("unobserved"))),
        ("context_present", some(contexts), F.coalesce(contexts, F.lit(0)).cast("string")),
        ("citation_present", some(citations), F.coalesce(citations, F.lit(0)).cast("string")),
    )
    return F.array(*(F.struct(F.lit(name).alias("check"), passed.alias("passed"), value.alias("value")) for name, passed, value in rows))


def timings(seconds: Column, order: tuple[str, ...]) -> Column:
    """Measured steps of a map of seconds, in ``order``, four digits; steps without a number are left out."""
    steps = F.transform(F.array(*map(F.lit, order)), lambda k: F.struct(k.alias("step"), F.round(F.try_element_at(seconds, k), 4).alias("seconds")))
    return F.filter(steps, lambda x: x["seconds"].isNotNull())


def coverage_of(rows: DataFrame, *columns: str) -> DataFrame:
    """field, defined and share of rows that have each measure."""
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).isNotNull().alias("has")) for c in columns))
    return rows.select(F.inline(fields)).groupBy("field").agg(F.count_if("has").alias("defined"), F.round(F.avg(F.col("has").cast("double")), 6).alias("share"))


def first_with_evidence(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """query_id, source, status: the primary result where it is ok or partial and has evidence, else the fallback's, partial at best where the primary failed.

    Both: query_id, status, n_evidence.
    """
    tier = lambda df, k, name: df.select("query_id", "status", "n_evidence", F.lit(k).alias("tier"), F.lit(name).alias("source"))
    both = tier(primary, 0, "primary").unionByName(tier(fallback, 1, "fallback"))
    good = (F.col("tier") == 1) | (F.col("status").isin("ok", "partial") & (F.col("n_evidence") > 0))
    failed = F.max(F.col("status").isin("error", "timeout") & (F.col("tier") == 0))
    best = both.groupBy("query_id").agg(F.min(F.when(good, F.struct("tier", "source", "status"))).alias("x"), failed.alias("failed")).where(F.col("x").isNotNull())
    return best.select("query_id", "x.source", F.when((F.col("x.tier") == 1) & F.col("failed") & (F.col("x.status") == "ok"), "partial").otherwise(F.col("x.status")).alias("status"))


def usage(rows: DataFrame, key: str, amounts: str) -> DataFrame:
    """key and amount of a map column, summed."""
    return rows.select(F.explode(amounts).alias(key, "amount")).groupBy(key).agg(F.sum("amount").alias("amount"))


def histogram(rows: DataFrame, column: str, vocabulary: tuple[str, ...]) -> DataFrame:
    """Every value of the vocabulary and how many rows have it, 0 included, in one pass."""
    counted = rows.agg(*(F.count_if(F.col(column) == v).alias(f"v{i}") for i, v in enumerate(vocabulary)))
    return counted.select(F.inline(F.array(*(F.struct(F.lit(v).alias(column), F.col(f"v{i}").alias("n")) for i, v in enumerate(vocabulary)))))


def totals(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Count, sum, mean and most of a value by key, six digits."""
    return rows.groupBy(key).agg(F.count(value).alias("n"), F.round(F.sum(value), 6).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.round(F.max(value), 6).alias("most"))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The fastest candidate (name, throughput, failures) without failures, with its speedup over ``baseline`` and whether it is three times as fast."""
    clean = candidates.where(F.col("failures") == 0)
    best = clean.agg(F.max(F.struct("throughput", "name")).alias("x"))
    base = candidates.where(F.col("name") == "baseline").agg(F.max("throughput").alias("base"))
    speedup = F.col("x.throughput") / F.col("base")
    return best.join(F.broadcast(base)).select(F.col("x.name").alias("name"), F.round(speedup, 4).alias("speedup"), (speedup >= 3).alias("target_met"))


def capacity(records: Column, body_bytes: Column, metadata_bytes: Column, dimension: int = 384, links: int = 16) -> dict[str, Column]:
    """Bytes of an index by component: vectors, bodies, metadata, sparse budget, graph edges, a fifth for its log, a quarter on top."""
    parts = {
        "dense": records * dimension * 4,
        "body": body_bytes,
        "metadata": metadata_bytes,
        "sparse": body_bytes * 2,
        "edges": records * links * 2 * 4,
    }
    base = sum(parts.values(), F.lit(0))
    log = F.ceil(base / 5)
    return parts | {"log": log, "headroom": F.ceil((base + log) / 4)}


def sample_places(plan: str, total: int, n: int) -> set[int]:
    """The first and last place and ``n`` more by SHA-256 of the plan's hash and a number; a small, stated set on the driver."""
    import hashlib

    return {0, total - 1} | {int(hashlib.sha256(f"{plan}{i}".encode()).hexdigest(), 16) % total for i in range(n)}


def matches_any(c: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a lower-case text matches one of the patterns; null does not."""
    found = F.lit(False)
    for p in patterns:
        found = found | F.lower(c).rlike(p)
    return F.coalesce(found, F.lit(False))


def sensitive_path(path: Column) -> Column:
    """Environment files, credentials and keys by their names; of environment files only the template ``.env.example`` is safe."""
    name = F.lower(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))
    named = name.isin(".env", "credentials.json", "secrets.json", "service-account.json")
    return F.coalesce((named | name.startswith(".env.") | name.rlike(r"^.+\.(key|pem|p12|pfx)$")) & (name != ".env.example"), F.lit(False))


def excluded_path(path: Column, paths: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> Column:
    """Paths that a digest of sources leaves out: sensitive ones, those named or below a prefix, and what tools leave behind."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    left = plain.endswith(".tmp") | plain.endswith(".pyc") | F.contains(F.concat(F.lit("/"), plain, F.lit("/")), F.lit("/__pycache__/")) | plain.startswith(".pytest_cache/")
    for p in prefixes:
        left = left | plain.startswith(p)
    return F.coalesce(sensitive_path(path) | left | plain.isin(*paths), F.lit(False))


def owned(rows: DataFrame, owner: str, key: str = "client_id") -> DataFrame:
    """Rows of one owner; those without an owner belong to nobody."""
    return rows.where(F.col(key) == owner)


def cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those that ``gone`` names."""
    keys = gone.select(key).distinct()
    return parents.join(keys, key, "left_anti"), children.join(keys, key, "left_anti")


def partition_faults(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """key and fault (missing, foreign, repeated) where the parts don't split the whole."""
    every = parts[0].select(key)
    for p in parts[1:]:
        every = every.unionByName(p.select(key))
    held = every.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = whole.select(key).distinct().withColumn("there", F.lit(True)).join(held, key, "full_outer")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("there").isNull(), "foreign").when(F.col("n") > 1, "repeated")
    return joined.select(key, fault.alias("fault")).where(F.col("fault").isNotNull())


def upload_plan(waves: DataFrame, least: int, most: int, workers: int, shards: int) -> DataFrame:
    """run_id, batch, workers and changes after its waves in order: three healthy ones double the batch and add a worker, pressure halves both.

    ``waves``: run_id, wave, success, transient_errors, rate_limited. A run's waves are few and folded in one row.
    """
    start = F.struct(F.lit(least).alias("batch"), F.lit(min(shards, workers)).alias("workers"), F.lit(0).alias("healthy"), F.lit(0).alias("changes"))

    def step(s: Column, w: Column) -> Column:
        bad = ~w["success"] | (w["transient_errors"] >= 2) | w["rate_limited"]
        grows = ~bad & (s["healthy"] >= 2)
        batch = F.when(bad, F.greatest(F.lit(least), F.floor(s["batch"] / 2).cast("int"))).when(grows, F.least(F.lit(most), s["batch"] * 2)).otherwise(s["batch"])
        hands = F.when(bad, F.greatest(F.lit(1), F.floor(s["workers"] / 2).cast("int"))).when(grows, F.least(F.lit(workers), F.lit(shards), s["workers"] + 1)).otherwise(s["workers"])
        moved = ((batch != s["batch"]) | (hands != s["workers"])).cast("int")
        return F.struct(batch.alias("batch"), hands.alias("workers"), F.when(bad | grows, 0).otherwise(s["healthy"] + 1).alias("healthy"), (s["changes"] + moved).alias("changes"))

    lists = waves.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("wave", "success", "transient_errors", "rate_limited"))).alias("waves"))
    return lists.select("run_id", F.aggregate("waves", start, step).alias("x")).select("run_id", "x.batch", "x.workers", "x.changes")


def live_entries(events: DataFrame, now: Column, ttl_s: int, most: int) -> DataFrame:
    """The ``most`` entries started last of those that were updated within ``ttl_s`` seconds before ``now``.

    ``events``: request_id, ts, stage. Ties of start go to the greater id.
    """
    last = events.groupBy("request_id").agg(F.min("ts").alias("started_at"), F.max(F.struct("ts", "stage")).alias("x"))
    live = last.where(F.col("x.ts") >= now - F.make_interval(secs=F.lit(ttl_s)))
    return live.orderBy(F.desc("started_at"), F.desc("request_id")).limit(most).select("request_id", "started_at", F.col("x.stage").alias("stage"))
