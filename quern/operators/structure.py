"""Structure of legal texts: units under headings, citations, stable identifiers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quern.functions import text as T
from quern.sources.scratch import written

# The words of headings and citations, and the namespace of URLs.
CHAPTER = r"(?iu)^\s*(Chương\s+(?:[IVXLCDM]+|\d+))(?![\p{L}\p{N}_])"
SECTION = r"(?iu)^\s*((?:Mục|Tiểu mục)\s+\d+)(?![\p{L}\p{N}_])"
ARTICLE = r"(?iu)^\s*(Điều\s+\d+[A-Za-z]?)(?![\p{L}\p{N}_])"
CLAUSE = r"^\s*(\d+)\.(?:\s|$)"
CLAUSE_WORD, ARTICLE_WORD = "Khoản", "Điều"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def citation(number: Column, doc_id: Column, article: Column, clause: Column) -> Column:
    """Document, article and clause as they are cited; parts that are missing are left out."""
    name = F.when(F.coalesce(number, F.lit("")) != "", number).otherwise(F.concat(F.lit("ID "), doc_id.cast("string")))
    return F.concat_ws(", ", name, article, F.concat(F.lit(f"{CLAUSE_WORD} "), clause))


def units(docs: DataFrame) -> DataFrame:
    """doc_id, unit (in order), heading_path, article, clause and text of each article or clause; else the whole text.

    Headings are carried down the lines by windows over each document: a chapter ends the section and article, a
    section the article. A clause's unit begins with its article's heading line, the first clause's also with the
    lines between. Null and empty texts have no unit.
    """
    lines = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), T.normalized(F.col("text")).alias("body")).where(F.col("body") != "")
    lines = lines.select("doc_id", "row", "body", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    found = lambda regex: F.nullif(F.regexp_extract("line", regex, 1), F.lit(""))
    kind = lines.withColumn("chapter", found(CHAPTER))
    kind = kind.withColumn("section", F.when(F.col("chapter").isNull(), found(SECTION)))
    kind = kind.withColumn("article", F.when(F.col("chapter").isNull() & F.col("section").isNull(), found(ARTICLE)))
    down = Window.partitionBy("row").orderBy("at")
    last = lambda c: F.last(F.when(F.col(c).isNotNull(), F.struct(F.col("at").alias("at"), F.col(c).alias("name"))), ignorenulls=True).over(down)
    held = kind.select("*", last("chapter").alias("c"), last("section").alias("s"), last("article").alias("a"))
    before = lambda x: F.coalesce(F.col(f"{x}.at"), F.lit(-1))
    live = held.where((before("a") > before("c")) & (before("a") > before("s")))
    path = F.concat_ws(" > ", F.col("c.name"), F.when(before("s") > before("c"), F.col("s.name")), F.col("a.name"))
    block = live.select("doc_id", "row", "at", "line", path.alias("heading_path"), F.col("a.at").alias("head"), F.col("a.name").alias("article"))
    mark = F.when(F.col("at") > F.col("head"), F.nullif(F.regexp_extract("line", CLAUSE, 1), F.lit("")))
    block = block.withColumn("mark", mark)
    inside = Window.partitionBy("row", "head").orderBy("at")
    whole = Window.partitionBy("row", "head")
    first_clause = F.min(F.when(F.col("mark").isNotNull(), F.col("at"))).over(whole)
    start = F.max(F.when(F.col("mark").isNotNull(), F.col("at"))).over(inside)
    block = block.select("*", F.coalesce(start, first_clause, F.col("head")).alias("unit"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    heading = F.max(F.when(F.col("at") == F.col("head"), F.col("line")))
    grouped = block.withColumn("title", heading.over(whole)).groupBy("doc_id", "row", "unit", "head", "heading_path", "article", "title").agg(
        text.alias("text"), F.max(F.when(F.col("at") == F.col("unit"), F.col("mark"))).alias("clause"), F.min("at").alias("least")
    )
    cut = grouped.select(
        "doc_id", "row", "unit", "heading_path", "article", "clause", F.when(F.col("least") > F.col("head"), F.concat_ws("\n", "title", "text")).otherwise(F.col("text")).alias("text")
    )
    rest = lines.where("at = 0").join(cut.select("row").distinct(), "row", "left_anti")
    none = F.lit(None).cast("string")
    plain = rest.select("doc_id", "row", F.lit(0).alias("unit"), F.lit("").alias("heading_path"), none.alias("article"), none.alias("clause"), F.col("body").alias("text"))
    return cut.unionByName(plain).drop("row")


def chunks(docs: DataFrame, size: int = 280, overlap: int = 24) -> DataFrame:
    """Windows of the units' tokens, with citation and token count. ``docs``: doc_id, document_number, text."""
    parts = units(docs).select("*", F.posexplode(T.windows(T.spaced(F.col("text")), size, overlap)).alias("window", "tokens"))
    numbers = docs.select("doc_id", "document_number").distinct()
    return parts.join(numbers, "doc_id", "left").select(
        "doc_id", "unit", "window", "heading_path", "article", "clause",
        citation(F.col("document_number"), F.col("doc_id"), F.col("article"), F.col("clause")).alias("citation"),
        F.concat_ws(" ", "tokens").alias("text"), F.size("tokens").alias("token_count"),
    )


def name_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """UUID of version 5 of a name, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("long")))
    part = lambda low, n: F.substring(digest, low, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


@F.pandas_udf(LongType())
def term_id(terms: pd.Series) -> pd.Series:
    """The first 8 bytes of BLAKE2b as a non-negative 31-bit number."""
    return pd.Series([None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") & 0x7FFFFFFF for t in terms], dtype="Int64")


_DOC = r"[0-9]{1,4}/[0-9]{4}/[A-ZĐ0-9-]+"
_MARK = rf"(?iuU)\b(?:{_DOC}|(?:{ARTICLE_WORD}|{CLAUSE_WORD})\s+[0-9]+(?:(?<={ARTICLE_WORD}.{{1,20}})[A-Za-z])?)\b"

def marks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, row (a number for each text), at, kind (document, article or clause) and name of each mark, by its place in the text."""
    body = F.coalesce(F.col("body"), F.lit(""))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), F.monotonically_increasing_id().alias("row"))
    zipped = F.arrays_zip(F.split(body, _MARK, -1).alias("gap"), F.regexp_extract_all(body, F.lit(_MARK), F.lit(0)).alias("mark"))
    parts = texts.select("key", "row", F.posexplode(zipped).alias("i", "part")).where(F.col("part.mark").isNotNull())
    so_far = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.sum(F.length("part.gap") + F.length("part.mark")).over(so_far) - F.length("part.mark")
    word = lambda w: F.concat(F.lit(f"{w} "), F.regexp_extract("part.mark", r"(\S+)$", 1))
    is_article, is_clause = (F.col("part.mark").rlike(f"(?iu)^{w}") for w in (ARTICLE_WORD, CLAUSE_WORD))
    kind = F.when(is_article, "article").when(is_clause, "clause").otherwise("document")
    name = F.when(is_article, word(ARTICLE_WORD)).when(is_clause, word(CLAUSE_WORD)).otherwise(F.upper("part.mark"))
    return parts.select("key", "row", at.alias("at"), kind.alias("kind"), name.alias("name"))


def _nearest(of: Column, place: str, *ties: str) -> Column:
    """Of the values that some rows of a text have, the one nearest by place; of two as near, the earlier. Each row is passed twice."""
    held = F.when(of.isNotNull(), F.struct(F.col(place).alias("at"), of.alias("name")))
    run = lambda *order: F.last(held, ignorenulls=True).over(Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before, after = run(place, *ties), run(F.desc(place), *ties)
    return F.when(after["at"].isNull() | (F.col(place) - before["at"] <= after["at"] - F.col(place)), before).otherwise(after)


def cited(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n (from 1) and document_number, article, clause of each citation by place in a text, each once.

    A clause belongs to the article nearest to it, an article, or a clause where there is none, to the nearest document;
    of two as near, to the earlier. An article that has clauses is cited with them alone, a document that nothing belongs
    to by itself. Null texts cite nothing; each repeated row of a key is read by itself. The marks of a text are sorted
    and passed, never compared with each other.
    """
    found = written(marks(docs, key, text), "marks")
    near = found.withColumn("of", _nearest(F.when(F.col("kind") == "article", F.col("name")), "at")).where(F.col("kind") == "clause")
    clauses = near.select("key", "row", F.coalesce("of.at", "at").alias("head"), "at", F.coalesce("of.name", F.lit("")).alias("article"), F.col("name").alias("clause"))
    articles = found.where(F.col("kind") == "article").select("key", "row", F.col("at").alias("head"), "at", F.col("name").alias("article"), F.lit("").alias("clause"))
    units = clauses.unionByName(articles.join(clauses.select("row", "head").distinct(), ["row", "head"], "left_anti").select(*clauses.columns))
    none = F.lit(None).cast("string")
    documents = found.where(F.col("kind") == "document").select("key", "row", F.col("at").alias("head"), "at", none.alias("article"), none.alias("clause"), F.col("name").alias("number"))
    whole = written(units.withColumn("number", none).unionByName(documents).withColumn("doc", _nearest(F.col("number"), "head", "at")), "owned")
    owned = whole.where(F.col("number").isNull())
    place = F.least("head", "at", F.coalesce("doc.at", "at"))
    listed = owned.select("key", "row", F.struct(place.alias("place"), "head", "at").alias("order"), F.coalesce("doc.name", F.lit("")).alias("document_number"), "article", "clause")
    used = owned.select("row", F.col("doc.at").alias("at")).distinct()
    alone = documents.join(used, ["row", "at"], "left_anti").select("key", "row", F.struct(F.col("at").alias("place"), "head", "at").alias("order"), F.col("number").alias("document_number"), F.lit("").alias("article"), F.lit("").alias("clause"))
    first = listed.unionByName(alone).groupBy("key", "row", "document_number", "article", "clause").agg(F.min("order").alias("order"))
    return first.select(F.col("key").alias(key), F.row_number().over(Window.partitionBy("row").orderBy("order")).alias("n"), "document_number", "article", "clause")


# Types of documents by a part of their number, and by a word of the text, in this order.
TYPES_BY_NUMBER = (
    ("/NĐ-CP", "Nghị định"), ("/ND-CP", "Nghị định"), ("/TTLT-", "Thông tư liên tịch"), ("/TT-", "Thông tư"), ("/QĐ-", "Quyết định"),
    ("/QD-", "Quyết định"), ("/NQ-", "Nghị quyết"), ("/CT-", "Chỉ thị"), ("/VBHN-", "Văn bản hợp nhất"),
)
TYPES_BY_TEXT = (
    "Hiến pháp", "Bộ luật", "Luật", "Pháp lệnh", "Nghị định", "Nghị quyết", "Thông tư liên tịch", "Thông tư", "Quyết định", "Chỉ thị", "Văn bản hợp nhất",
)


def document_type(number: Column, text: Column, known: Column) -> Column:
    """The known type, else what the number says, else the first word of the list that the text has, else unspecified."""
    by_number = [F.when(F.contains(F.upper(number), F.lit(part)), kind) for part, kind in TYPES_BY_NUMBER]
    by_text = [F.when(text.rlike(rf"(?iuU)\b{word}\b"), word) for word in TYPES_BY_TEXT]
    return F.coalesce(F.nullif(F.trim(known), F.lit("")), *by_number, *by_text, F.lit("unspecified"))


def headings(text: Column) -> Column:
    """Chapters, sections and articles of a text's lines, each once whatever its case, in order."""
    found = F.filter(F.split(T.normalized(text), "\n"), lambda x: x.rlike(CHAPTER) | x.rlike(SECTION) | x.rlike(ARTICLE))

    def once(lines: Column) -> Column:
        lower = F.transform(lines, F.lower)
        return F.filter(lines, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)

    return T.bound(found, once)


def inference_text(labelled: dict[str, Column], body: Column) -> Column:
    """Labelled lines of the fields that are not blank, then the body."""
    lines = [F.when(T.clean(c) != "", F.concat(F.lit(f"{name}: "), T.clean(c))) for name, c in labelled.items()]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\nNội dung:\n"), F.coalesce(body, F.lit("")))
