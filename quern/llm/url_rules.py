"""URL rules indexed by their rarest literal token, in DataFrame functions only.

A rule is written ``host/path``. It fits its host and all subdomains where the URL's path starts with the
rule's; the longest fitting rule decides, and of equally long ones block. Pages that no rule fits get the
verdict of pattern rules, and are allowed where none matches.

A pattern is compared with host and path together. ``*`` stands for any characters but ``/``, ``**`` for any at all,
``^`` for one that is neither letter, digit nor hyphen, or for the end. A leading ``||`` anchors it at the host or at a
label of it, ``|`` at the host's beginning or, written last, at the end of the path; otherwise it may match anywhere.

All literal tokens of a rule must be in a URL that it fits: labels of its host and whole segments of its path, and of a
pattern those runs of letters, digits and hyphens that nothing in it could lengthen. So each rule is indexed by the token
that fewest URLs of the table have; a URL's tokens fetch its candidates, and only on those regular expressions run.
Patterns without such a token are candidates of every URL.

Null URLs and those without ``://`` have an empty host and path and fit nothing. Repeated rows give a row
each. Very long URLs are read whole. An empty table gives no rows. Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.contamination import LOWER, UPPER
from quern.sources.scratch import written

#: (verdict, rule)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: What blocks a page that no rule fits.
PATTERNS = (
    "||casino^", "||porn^", "||viagra^", "||xxx^", "/casino^", "/porn^", "/viagra^", "/xxx^",
    "||*.example.*/ads/**", "||tracker*.*^", "**/login*.php|", "/out^**url", "||free-*-download.*^",
)
#: Rules in one broadcast, some 300 bytes each; a longer list is joined by a shuffle.
BROADCAST_RULES = 50_000
#: A token of every URL, which brings its row and the patterns without a literal token; no other token is without a kind.
END = ""
#: Characters of a pattern that its regular expression takes as they are.
_PLAIN = r"[A-Za-z0-9/_-]"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens with their kind: labels of the host, segments of the path, and words of either."""
    return F.array_distinct(
        F.concat(
            F.transform(F.split(host, r"\.", -1), lambda x: F.concat(F.lit("h:"), x)),
            F.transform(F.split(path, "/", -1), lambda x: F.concat(F.lit("p:"), x)),
            F.transform(F.regexp_extract_all(F.concat(host, path), F.lit(WORD), F.lit(0)), lambda x: F.concat(F.lit("w:"), x)),
        )
    )


#: Words of URLs, by which patterns are found.
WORD = "[A-Za-z0-9-]+"


def pattern_regex(pattern: Column) -> Column:
    """The regular expression over host and path that a pattern stands for."""
    body = F.regexp_replace(F.regexp_replace(pattern, r"^\|{1,2}", ""), r"\|$", "")
    # one character or wildcard at a time, so that nothing is replaced twice
    parts = F.transform(
        F.regexp_extract_all(body, F.lit(r"\*\*|."), F.lit(0)),
        lambda x: F.when(x == "**", ".*").when(x == "*", "[^/]*").when(x == "^", "(?:[^A-Za-z0-9-]|$)").when(x.rlike(_PLAIN), x).otherwise(F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))),
    )
    start = F.when(F.startswith(pattern, F.lit("||")), F.lit(r"^(?:[^/]*\.)?")).when(F.startswith(pattern, F.lit("|")), F.lit("^")).otherwise(F.lit(""))
    return F.concat(F.lit("(?s)"), start, F.array_join(parts, ""), F.when(F.endswith(pattern, F.lit("|")), F.lit("$")).otherwise(F.lit("")))


def pattern_tokens(pattern: Column) -> Column:
    """Words of a pattern that end on both sides within it, at its anchors too."""
    closed = F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"^\|{1,2}", "/"), r"\|$", "/"), r"\^", "/")
    return F.transform(F.regexp_extract_all(closed, F.lit(r"(?<=[^A-Za-z0-9*-])[A-Za-z0-9-]+(?=[^A-Za-z0-9*-])"), F.lit(0)), lambda x: F.concat(F.lit("w:"), x))


def _listed(spark: SparkSession, schema: tuple[str, ...], rows) -> DataFrame:
    """A short list as a table that no Python worker makes."""
    structs = [F.struct(*(F.lit(v).cast("string").alias(k) for k, v in zip(schema, row, strict=True))) for row in rows]
    empty = F.array().cast("array<struct<" + ",".join(f"{k}:string" for k in schema) + ">>")
    return spark.range(1).select(F.inline(F.array(*structs) if structs else empty))


def rule_table(spark: SparkSession, rules=RULES, patterns=PATTERNS) -> DataFrame:
    """rule (null for patterns), name, verdict, regex over host and path, size, tokens of which one is in any URL it fits."""
    listed = _listed(spark, ("verdict", "rule"), rules)
    host, path = F.split_part("rule", F.lit("/"), F.lit(1)), F.regexp_extract("rule", r"^[^/]*(.*)$", 1)
    segments = F.split(path, "/", -1)
    whole = F.filter(F.slice(segments, 1, F.size(segments) - 1), lambda x: x != "")
    urls = listed.select(
        "rule",
        F.col("rule").alias("name"),
        "verdict",
        F.concat(F.lit(r"^(?:[^/]*\.)?\Q"), "rule", F.lit(r"\E")).alias("regex"),
        F.length("rule").alias("size"),
        F.concat(
            F.transform(F.split(host, r"\.", -1), lambda x: F.concat(F.lit("h:"), x)),
            F.transform(whole, lambda x: F.concat(F.lit("p:"), x)),
        ).alias("tokens"),
    )
    pattern = F.col("pattern")
    found = _listed(spark, ("pattern",), [(p,) for p in patterns]).select(
        F.lit(None).cast("string").alias("rule"),
        F.concat(F.lit("pattern "), pattern).alias("name"),
        F.lit("block").alias("verdict"),
        pattern_regex(pattern).alias("regex"),
        F.lit(0).alias("size"),
        pattern_tokens(pattern).alias("tokens"),
    )
    return urls.unionByName(found)


def indexed_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule under the token that is rarest in ``tokens`` (token); those with a token that no URL has fit nothing."""
    wanted = rules.select("name", "verdict", F.explode("tokens").alias("token"))
    distinct = written(wanted.select("token").distinct(), "rule-tokens")
    counts = tokens.join(_bounded(distinct), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        wanted.join(counts, "token", "left")
        .groupBy("name", "verdict")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .where(F.col("rarest.n") > 0)
    )
    found = rules.drop("tokens").join(rarest, ["name", "verdict"]).withColumn("token", F.col("rarest.token")).drop("rarest")
    return found.unionByName(rules.where(F.size("tokens") == 0).drop("tokens").withColumn("token", F.lit(END)))


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_RULES else table


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row for each row of ``pages``: its ``keep`` columns, host, path, rule and verdict."""
    rules = rule_table(pages.sparkSession) if rules is None else rules
    urls = pages.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    tokens = urls.select("*", F.explode(F.concat(tokens_of(F.col("host"), F.col("path")), F.array(F.lit(END)))).alias("token"))
    index = written(indexed_rules(tokens.select("token"), rules), "rules")
    end = index.sparkSession.range(1).select(F.lit(END).alias("token"))
    candidates = _bounded(index.unionByName(end, allowMissingColumns=True))
    fit = tokens.join(candidates, "token").where(F.col("regex").isNull() | F.rlike(F.concat("host", "path"), F.col("regex")))
    # struct order: longest first, then block before allow
    choice = F.when(F.col("regex").isNotNull(), F.struct("size", F.col("verdict"), F.col("rule")))
    return (
        fit.groupBy("row", "kept", "host", "path")
        .agg(F.max(choice).alias("best"))
        .select("kept.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    )
