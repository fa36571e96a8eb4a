"""Composition, title words and redaction against plain Python."""

import random
import re
import sys
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import corpus, ranking
from quern.operators.cases import excluded_path, sensitive_path


def java(pattern):
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern))


LOOSE, MAYBE = java(T._loose()), java(T._MAYBE_LOOSE)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_texts_that_composition_changes_are_found(text):
    if unicodedata.normalize("NFC", text) != text:
        assert LOOSE.search(text) and MAYBE.search(text)


def test_every_character_that_composition_changes_is_found():
    for k in range(sys.maxunicode + 1):
        c = chr(k)
        if not 0xD800 <= k < 0xE000:
            if unicodedata.normalize("NFC", c) != c or unicodedata.combining(c):
                assert LOOSE.match(c) and MAYBE.match(c), hex(k)
            both = unicodedata.normalize("NFD", c)
            if both != c:
                assert unicodedata.normalize("NFC", both) == both or LOOSE.search(both) and MAYBE.search(both), hex(k)


def test_composed_equals_the_library(spark):
    pick = random.Random(4)
    points = [0x61, 0x65, 0x1EC7, 0x301, 0x323, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x212B, 0x2126, 0xFB1D, 0x958, 0x1D15E, 0x400, 0x4E00, 0xA0, 0x20]
    texts = ["", None, "Việt", unicodedata.normalize("NFD", "Điều lệ thuế"), *("".join(chr(pick.choice(points)) for _ in range(9)) for _ in range(300))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", T.composed(F.col("t")).alias("c")).collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


def test_decomposed_copies_are_copies(spark):
    text = "Luật thuế thu nhập doanh nghiệp số 14"
    docs = spark.createDataFrame([(1, text, "s"), (2, unicodedata.normalize("NFD", text), "s"), (3, "x" * 19, "s"), (4, "x" * 20, "s")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in corpus.flagged(docs).collect()}
    assert got[1].content_sha256 == got[2].content_sha256 and got[2].quality_flags == ["duplicate_content_hash"]
    assert got[3].quality_flags == ["abnormal_length"] and got[4].quality_flags == []


def test_title_words_part_at_underscores(spark):
    docs = spark.createDataFrame([(1, "tax_code of 2020"), (2, "taxcode"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "CODE"), (8, "tax_code của")], "query_id long, text string")
    assert sorted((r.query_id, r.doc_id) for r in ranking.bm25(asked, docs, 5).collect()) == [(8, 1), (9, 1)]


def test_whole_phrases_alone_earn_the_bonus(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:20] + ["x"] + words[20:]))], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "  ".join(words).upper())], "query_id long, text string")
    assert sorted(r.doc_id for r in ranking.containment(asked, docs).collect()) == [1, 2]
    scores = {r.doc_id: r.score for r in ranking.lexical_lane(asked, docs, phrase_bonus=8.0).collect()}
    assert scores == {1: 48.0, 2: 40.0}


def test_secrets(spark):
    texts = {
        "Authorization: Bearer abc.d-1": "Authorization: Bearer [REDACTED]",
        "forbearer stays": "forbearer stays",
        "x_bearer stays": "x_bearer stays",
        "key s3cr3t-value and four": "key [REDACTED] and four",
        None: "",
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.s for r in rows.select("t", T.redact_secrets(F.col("t"), ("s3cr3t-value", "four")).alias("s")).collect()}
    assert got == texts


def test_paths(spark):
    sensitive = {".env": 1, "a/.env.sample": 1, ".env.template": 1, "b\\.ENV.Example": 0, "x/.key": 0, "x/a.PEM": 1, "secrets.json": 1, "env": 0, None: 0}
    excluded = {"a.tmp": 1, "x/__pycache__/y": 1, "__pycache__": 1, ".pytest_cache/v": 1, "runs/1": 1, "docs/now.md": 1, "docs/now.md2": 0, "q/.env": 1, "src/a.py": 0, None: 0}
    rows = spark.createDataFrame([(p,) for p in sensitive | excluded], "p string")
    got = rows.select("p", sensitive_path(F.col("p")).cast("int").alias("s"), excluded_path(F.col("p"), ("docs/now.md",), ("runs/",)).cast("int").alias("e")).collect()
    assert {r.p: r.s for r in got if r.p in sensitive} == sensitive
    assert {r.p: r.e for r in got if r.p in excluded} == excluded
