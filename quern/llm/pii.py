"""Personal data by patterns and by bootstrapped contexts, in DataFrame functions only.

Seeds are e-mail addresses, IP addresses, card and telephone numbers that patterns and checks find in whole
texts, and strings with the shape of a key (``KEY``), which are not spans by themselves: they only lend their kind,
secret, to contexts. Contexts (the word, or two words, before a string with a digit or ``@``) form a graph with the
strings that follow them. Contexts are scored by the share of all their occurrences in the corpus that a known
identifier follows, strings by their best context, of which they take the kind; this is repeated ``ROUNDS``
times. Where at least ``MIN_SUPPORT`` different identifiers follow a context and its score reaches ``MIN_SCORE``,
other strings there are added as spans of the kind that its identifiers have most (those shaped like keys as secrets).
A key in any other place, as a digest in running text, is left alone. Base spans always stay.

Spans are code points, end exclusive. Null or empty texts have none. Very long texts are read whole, in time that
grows with their length and, for very many matches, a little faster; contexts reach back over whole words of any
length. Only strings with a digit or ``@`` are discovered, without the quotes, brackets and symbols around them, and only
words before them are contexts. Repeated rows give a
row each. An empty table learns nothing. Ties of kind go to the kind listed first. Columns not in ``keep`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import written

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans: those of the patterns, and the one that contexts alone find.
SPAN_KINDS = (*KINDS, "secret")
SECRET = len(KINDS)
# Runs are entered at their start alone (or where the last match ended), and never given back, so that long
# runs take linear time and no stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
#: A word with a digit or @, and number-like words after it.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[().+-]*+[0-9][0-9().+-]*+(?!\S))*+"
#: 32 hexadecimal digits or more with letters and figures, or 24 characters or more of both cases with figures.
KEY = r"^(?:(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+|(?=[^0-9]*+[0-9])(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])[A-Za-z0-9_-]{24,}+)$"
#: What surrounds a string: runs are entered at their start alone.
OPENING = r"^[\"'(<\[{=,;:]++"
CLOSING = r"(?<![\"')>\]},;:.!?#*$%&|])[\"')>\]},;:.!?#*$%&|]++$"
MIN_SUPPORT, MIN_SCORE, ROUNDS = 3, 0.8, 3
#: Bytes of contexts in one broadcast, rows of found spans in one; more are joined in passes or by a shuffle.
BROADCAST_BYTES = 16 << 20
BROADCAST_ROWS = 100_000
#: Matches of a text that are summed together.
BLOCK = 128
#: Characters of a text that are cut off together.
CUT = 4096


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row, however often a lambda within reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def before_each(values: Column, start: Column, merge) -> Column:
    """For each value, ``start`` merged with all values before it: sums of whole blocks, then of what is left in its block.

    Neither grows an array step by step, so texts of very many matches don't take quadratic time to copy.
    """
    over = lambda part: F.aggregate(part, start, merge)

    def places(v: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(1), F.floor(F.size(v) / BLOCK).cast("int") + 1), lambda b: over(F.slice(v, (b - 1) * BLOCK + 1, BLOCK)))
        firsts = lambda sums: F.transform(sums, lambda _, b: over(F.slice(sums, 1, b)))
        return bound(
            bound(whole, firsts),
            lambda bases: F.transform(
                v, lambda _, i: F.aggregate(F.slice(v, i - i % BLOCK + 1, i % BLOCK), F.get(bases, F.floor(i / BLOCK).cast("int")), merge)
            ),
        )

    return bound(values, places)


def _placed(text: Column, regex: str, before: bool = False) -> Column:
    """Matches in order: match, start, and if asked the text from the second match back to this one's start."""
    matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    pairs = F.filter(F.zip_with(F.split(text, regex, -1), matches, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match"))), lambda p: p["match"].isNotNull())

    def placed(ps: Column) -> Column:
        ends = before_each(F.transform(ps, lambda p: F.length(p["gap"]) + F.length(p["match"])), F.lit(0), lambda s, x: s + x)
        near = lambda i: F.concat(
            F.coalesce(F.get(ps, i - 2)["match"], F.lit("")), F.coalesce(F.get(ps, i - 1)["gap"], F.lit("")), F.coalesce(F.get(ps, i - 1)["match"], F.lit("")), F.get(ps, i)["gap"]
        )
        made = lambda p, at, *more: F.struct(p["match"].alias("match"), (at + F.length(p["gap"])).alias("start"), *more)
        if not before:
            return F.zip_with(ps, ends, lambda p, at: made(p, at))
        return bound(ends, lambda at: F.transform(ps, lambda p, i: made(p, F.get(at, i), near(i).alias("before"))))

    return bound(pairs, placed)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _spans(kind: int, text: Column, regex: str, valid) -> Column:
    return F.transform(
        F.filter(_placed(text, regex), lambda m: valid(m["match"])),
        lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["match"])).alias("end")),
    )


def base_spans(text: Column) -> Column:
    """Sorted array of (start, kind by place in KINDS, end)."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    digit = text.rlike("[0-9]")
    card = lambda m: F.when(F.length(_digits(m)).between(12, 19), F.call_function("luhn_check", _digits(m))).otherwise(F.lit(False))
    parts = (
        (text.contains("@"), _spans(0, text, EMAIL, lambda m: F.lit(True))),
        (digit, _spans(1, text, IP, lambda m: m.rlike(OCTETS))),
        (digit, _spans(2, text, CARD, card)),
        (text.contains("+"), _spans(3, text, PHONE, lambda m: F.length(_digits(m)).between(9, 15))),
    )
    return F.array_sort(F.concat(*(F.when(some, found).otherwise(none) for some, found in parts)))


def candidates(text: Column, base: Column) -> Column:
    """Strings with a digit or @ that follow a word: value, start, end, kind of the base span there, or of its shape (null: none), last and prev word."""
    none = F.array().cast("array<struct<value:string,start:int,end:int,kind:int,last:string,prev:string>>")

    def row(m: Column, blocks: Column) -> Column:
        return bound(F.struct(F.regexp_replace(F.regexp_replace(m["match"], OPENING, ""), CLOSING, "").alias("value"), (m["start"] + F.length(m["match"])).alias("end"), F.lower(m["before"]).alias("before")), lambda x: made(m, blocks, x))

    def made(m: Column, blocks: Column, x: Column) -> Column:
        start = m["start"] + F.instr(m["match"], x["value"]) - 1
        near = F.flatten(F.transform(F.filter(blocks, lambda b: (b["low"] < x["end"]) & (b["high"] > m["start"])), lambda b: b["spans"]))
        seeds = F.filter(near, lambda b: (b["start"] < x["end"]) & (b["end"] > m["start"]))
        return F.struct(
            x["value"].alias("value"),
            start.alias("start"),
            (start + F.length(x["value"])).alias("end"),
            F.coalesce(F.try_element_at(seeds, F.lit(1))["kind"], F.when(x["value"].rlike(KEY), F.lit(SECRET))).alias("kind"),
            F.regexp_extract(x["before"], r"(?<!\S)(\S++)\s++$", 1).alias("last"),
            F.regexp_extract(x["before"], r"(?<!\S)(\S++)\s++\S++\s++$", 1).alias("prev"),
        )

    cut = F.transform(F.sequence(F.lit(1), F.floor(F.size(base) / BLOCK).cast("int") + 1), lambda b: F.slice(base, (b - 1) * BLOCK + 1, BLOCK))
    blocks = F.transform(
        F.filter(cut, lambda b: F.size(b) > 0),
        lambda b: F.struct(b.alias("spans"), F.array_min(F.transform(b, lambda x: x["start"])).alias("low"), F.array_max(F.transform(b, lambda x: x["end"])).alias("high")),
    )
    found = bound(blocks, lambda bs: F.transform(_placed(text, CANDIDATE, before=True), lambda m: row(m, bs)))
    return F.when(text.rlike("[0-9@]"), F.filter(found, lambda c: (c["last"] != "") & (c["value"] != ""))).otherwise(none)


def _to_find(kind: Column) -> Column:
    """Whether only a context can make a candidate of this kind a span."""
    return kind.isNull() | (kind == SECRET)


def _contexts(found: DataFrame) -> DataFrame:
    """A row for each candidate and context; prev is null in contexts of one word."""
    return found.select(
        "row",
        "c",
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.col("c.last").alias("last"), F.lit(None).cast("string").alias("prev")),
                    F.when(F.col("c.prev") != "", F.struct(F.col("c.last").alias("last"), F.col("c.prev").alias("prev"))),
                )
            )
        ).alias("context"),
    ).select("row", "c", "context")


def _occurrences(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """How often the corpus has each context, in one scan: a word that ends contexts is looked up once, then with the word before it."""
    words = F.split(F.lower("text"), r"\s+")
    pairs = docs.select(words.alias("w")).select(
        F.explode(F.arrays_zip(F.col("w").alias("cur"), F.concat(F.array(F.lit("")), F.slice("w", 1, F.size("w") - 1)).alias("before"))).alias("p")
    )
    if _bytes_of(contexts) <= BROADCAST_BYTES:
        bounded, counted = F.broadcast, pairs.select("p.cur", "p.before", F.lit(1).alias("n"))
    else:
        bounded, counted = (lambda table: table), pairs.select("p.cur", "p.before").groupBy("cur", "before").agg(F.count(F.lit(1)).alias("n"))
    one = contexts.groupBy(F.col("context.last").alias("last")).agg(F.max(F.when(F.col("context.prev").isNull(), F.col("context"))).alias("one"))
    two = contexts.where(F.col("context.prev").isNotNull()).select(F.col("context.last").alias("its_last"), F.col("context.prev").alias("its_prev"), F.col("context").alias("two"))
    found = counted.join(bounded(one), F.col("cur") == F.col("last")).join(bounded(two), (F.col("cur") == F.col("its_last")) & (F.col("before") == F.col("its_prev")), "left")
    met = found.groupBy("one", "two").agg(F.sum("n").alias("n"))
    return met.select(F.explode(F.array_compact(F.array("one", "two"))).alias("context"), "n").groupBy("context").agg(F.sum("n").alias("n"))


def _bytes_of(contexts: DataFrame) -> int:
    return contexts.agg(F.sum(F.octet_length("context.last") + F.coalesce(F.octet_length("context.prev"), F.lit(0)) + 60)).first()[0] or 0


def accepted_contexts(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """Contexts whose strings are identifiers, with their kind; None where no context could discover anything.

    ``found`` has a row for each candidate of ``docs``: row, c.
    """
    graph = written(
        _contexts(found)
        .groupBy("context", F.col("c.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("c.kind").alias("kind")),
        "graph",
    )
    open_contexts = written(
        graph.groupBy("context")
        .agg(F.count(F.lit(1)).alias("values"), F.count_if(_to_find(F.col("kind"))).alias("unseen"))
        .where((F.col("values") > MIN_SUPPORT) & (F.col("unseen") > 0))
        .select("context"),
        "contexts",
    )
    if open_contexts.isEmpty():
        return None
    totals = written(_occurrences(docs.select("text"), open_contexts), "occurrences")
    edges = written(graph.join(totals.withColumnRenamed("n", "total"), "context"), "edges")
    seed = F.max(F.col("kind").isNotNull().cast("double"))
    scores = edges.groupBy("value").agg(seed.alias("score"), F.min("kind").alias("own"))
    for _ in range(ROUNDS):
        known = edges.join(written(scores, "scores"), "value").where(F.col("score") >= MIN_SCORE)
        kind = F.coalesce("kind", "own")
        of_kind = F.array(*(F.sum(F.when(kind == k, F.col("n")).otherwise(0)) for k in range(len(SPAN_KINDS))))
        contexts = written(
            known.groupBy("context", "total")
            .agg(F.sum(F.col("n") * F.col("score")).alias("weight"), F.count(F.lit(1)).alias("support"), of_kind.alias("of_kind"))
            .select(
                "context",
                F.when(F.col("support") >= MIN_SUPPORT, F.col("weight") / F.col("total")).otherwise(0.0).alias("score"),
                (F.array_position("of_kind", F.array_max("of_kind")) - 1).cast("int").alias("its_kind"),
            ),
            "context-scores",
        )
        best = F.max(F.struct("score", (-F.col("its_kind")).alias("first")))
        scores = (
            edges.join(contexts, "context")
            .groupBy("value")
            .agg(F.greatest(F.max("score"), seed).alias("score"), F.coalesce(F.min("kind"), -best["first"]).alias("own"))
        )
    return contexts.where(F.col("score") >= MIN_SCORE).select("context", F.col("its_kind").alias("kind"))


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row of ``docs``, base (its spans: start, kind, end) and spans (those and the discovered)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = written(
        docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept"), text.alias("text"), base_spans(text).alias("base"))
        .select("row", "kept", "base", candidates(F.col("text"), F.col("base")).alias("cands")),
        "spans",
    )
    found = first.select("row", F.explode("cands").alias("c"))
    accepted = accepted_contexts(docs, found)
    if accepted is None:
        return first.select("kept.*", "base", F.col("base").alias("spans"))
    accepted = written(accepted, "accepted")
    unseen = _contexts(found.where(_to_find(F.col("c.kind")))).select("row", "c", "context")
    extra = written(
        unseen.join(accepted, "context")
        .groupBy("row", F.col("c.start").alias("start"), F.col("c.end").alias("end"))
        .agg(F.min(F.coalesce("c.kind", "kind")).alias("kind"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra")),
        "discovered",
    )
    joined = first.join(F.broadcast(extra) if extra.count() <= BROADCAST_ROWS else extra, "row", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return joined.select("kept.*", "base", F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, SPAN_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of overlapping ones, replaced by its first kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in SPAN_KINDS))
    reached = before_each(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda s, x: F.greatest(s, x))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CUT).cast("int")), lambda b: F.substring(text, b * CUT + 1, F.lit(CUT)))

    def between(parts: Column, low: Column, high: Column) -> Column:
        """The text from low to high, from the few cuts that have it."""
        first = F.floor(low / CUT).cast("int")
        held = F.array_join(F.slice(parts, first + 1, F.floor(high / CUT).cast("int") - first + 1), "")
        return F.substring(held, low - first * CUT + 1, high - low)

    def replaced(parts: Column) -> Column:
        # a span that begins at or beyond all ends before it opens a new run
        pieces = F.zip_with(spans, reached, lambda s, at: F.when(s["start"] >= at, F.concat(between(parts, at, s["start"]), F.get(names, s["kind"]))))
        return F.concat(F.array_join(pieces, ""), between(parts, last, F.length(text)))

    return F.when(F.size(spans) > 0, bound(cut, replaced)).otherwise(text)
