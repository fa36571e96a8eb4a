"""Text as Column expressions: cleaning, tokens, redaction, windows."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}_]+"


#: Words that title searches leave out.
STOP_WORDS = (
    "biết", "cho", "câu", "có", "của", "được", "gì", "hiện", "hỏi", "khi", "là", "lòng", "nào",
    "những", "như", "quy", "sau", "thế", "theo", "thì", "tôi", "trong", "và", "về", "vui", "xin",
)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row, however often a lambda within reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


#: Where characters that composition may change lie; blocks that are composed as they stand are left out.
_MAYBE_LOOSE = r"[\x{300}-\x{1DFF}\x{1F00}-\x{200F}\x{20D0}-\x{214F}\x{2300}-\x{232F}\x{2A00}-\x{2AFF}\x{2C00}-\x{10FFFF}]"


@lru_cache(maxsize=1)
def _loose() -> str:
    """A class of the characters that may not stand in a composed text, or that may join or change places with the one before.

    Those are characters that are not composed themselves, that have a combining class, or that are the second half of a
    composed one; vowels and finals of Hangul are its second halves.
    """
    points = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for k in range(0x300, sys.maxunicode + 1):
        c = chr(k)
        parts = unicodedata.decomposition(c)
        if unicodedata.combining(c) or (parts and not parts.startswith("<") and unicodedata.normalize("NFC", c) != c):
            points.add(k)
        if parts and not parts.startswith("<") and " " in parts:
            points.add(int(parts.split()[1], 16))
    ordered, ranges = sorted(points), []
    for k in ordered:
        if ranges and k == ranges[-1][1] + 1:
            ranges[-1][1] = k
        else:
            ranges.append([k, k])
    return "[" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in ranges) + "]"


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(c: Column) -> Column:
    """Canonical composition (NFC). Only texts with a character that it may change go to Python; null stays null."""
    return F.coalesce(_composed(F.when(c.rlike(_MAYBE_LOOSE) & c.rlike(_loose()), c)), c)


def normalized(c: Column) -> Column:
    """Composed, byte order marks dropped, no-break spaces and line ends unified, blanks collapsed, at most one empty line."""
    c = F.replace(F.replace(F.coalesce(composed(c), F.lit("")), F.lit("﻿"), F.lit("")), F.lit(" "), F.lit(" "))
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def terms(c: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits, as a title index takes them: underscores part words."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def spaced(c: Column) -> Column:
    """Tokens between white space; an empty text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def query_terms(c: Column) -> Column:
    """Distinct terms of two characters or more, in order."""
    return F.array_distinct(F.filter(terms(c), lambda x: F.length(x) >= 2))


def title_terms(c: Column, most: int = 12) -> Column:
    """Distinct words of two characters or more that are no stop words, ``most`` of them: what a title index is asked for."""
    long = F.array_distinct(F.filter(words(c), lambda x: F.length(x) >= 2))
    return F.slice(F.array_except(long, F.array(*map(F.lit, STOP_WORDS))), 1, most)


def document_number(c: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(c, r"(?U)\s+", ""))


def document_numbers(c: Column) -> Column:
    """Document numbers that a query names, normalised, in order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?iu)(?<![0-9])([0-9]{1,4}\s*/\s*[0-9]{4}\s*/\s*[A-ZĐ][A-ZĐ0-9-]*)"), F.lit(1))
    return F.transform(found, document_number)


def locator(c: Column) -> Column:
    """Lower case, blanks collapsed, no full stop after digits; null is empty."""
    return F.regexp_replace(clean(F.lower(c)), r"([0-9]+)\.", "$1")


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Runs of ``size`` tokens, each ``overlap`` into the last; none begins once one has reached the end."""
    step = size - overlap

    def cut(ts: Column) -> Column:
        n = F.size(ts)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: (n > 0) & ((i == 0) | (i - step + size < n)))
        return F.transform(starts, lambda i: F.slice(ts, i + 1, F.lit(size)))

    return bound(tokens, cut)


# The three patterns of contacts and the three of secrets below say what is redacted, in this order.
def redact_contacts(c: Column) -> Column:
    """Mail addresses, then mobile numbers, then identity numbers of 12 or 9 digits, by labels of this library."""
    c = F.regexp_replace(c, r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "[EMAIL]")
    c = F.regexp_replace(c, r"(?:\+?84|0)[35789][0-9]{8}(?![\p{L}\p{N}_])", "[PHONE]")
    return F.regexp_replace(c, r"(?<![\p{L}\p{N}_])(?:[0-9]{12}|[0-9]{9})(?![\p{L}\p{N}_])", "[ID]")


def redact_secrets(c: Column, known: tuple[str, ...] = ()) -> Column:
    """Secrets in query strings, bearer tokens, credentials in URIs and ``known`` secrets of over four characters; 200 characters at most."""
    c = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"(?i)([?&](?:api[_-]?key|key|token|secret|password|auth|bearer)=)[^&\s]+", "$1[REDACTED]")
    c = F.regexp_replace(c, r"(?i)(?<![\p{L}\p{N}_])(bearer\s+)[a-zA-Z0-9_\-.]+", "$1[REDACTED]")
    c = F.regexp_replace(c, r"(?i)(mongodb(?:\+srv)?://[^\s:]+:)([^@\s]+)(@[^\s]+)", "$1[REDACTED]$3")
    for secret in known:
        c = F.replace(c, F.lit(secret), F.lit("[REDACTED]")) if len(secret) > 4 else c
    return F.substring(c, 1, 200)


#: Damage that UTF-8 read as a single-byte encoding leaves.
MOJIBAKE = r"\uFFFD|Ã[\u0080-\u00BF]|Â[\u0080-\u00BF]|Ä[\u0080-\u00BFƒ‘’]|Æ[\u0080-\u00BF]|á[º»]|â[\u0080-\u00BF€‘-…]"


def metric_text(c: Column) -> Column:
    """Lower case, marks to blanks, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
