import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from quern.llm import pii
from quern.llm.queries import op1_pii

REGEX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = []
    for k, (kind, regex) in enumerate(REGEX.items()):
        found += [(m.start(), k, m.end()) for m in re.finditer(regex, text or "") if valid(kind, m[0])]
    return sorted(found)


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    None,
    "",
    "write to a.b@c.de.f_g@h.i or x@y then a@b.c%d@e.f",
    "1.2.3.4.5.6.7.8 and 999.1.1.1 and 007.010.1.255 or 1.2.3",
    "card 4111 1111 1111 1111 and 4111111111111112 then 4111-1111-1111-1111 9",
    "call +1 (212) 555-0100, +12 or +1234567890123456 \U0001f600 +44 20 7946 0958.",
    "é@é.com Ünal_9@x.y-z.w... 12",
    "9" * 30000,
    "a" * 40000 + " 1 " + "1-" * 9000 + "1." * 9000 + "a@" * 5000,
    "same text +1 (212) 555-0100 4111111111111111",
    "same text +1 (212) 555-0100 4111111111111111",
]


def test_base_spans_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        assert [tuple(s) for s in got[i].base] == brute(text), text and text[:60]
        assert set(map(tuple, got[i].base)) <= set(map(tuple, got[i].spans))


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in want) for n in range(4)]


def test_contexts_discover_unseen_identifiers(spark):
    seen = [f"lorem {w} hotline: +1 (212) 555-01{i:02d} ipsum" for i, w in enumerate("abcdefgh")]
    texts = [*seen, "dolor sit hotline: 555-0199, amet", "version 3.14 of the 2 towers", "the 17 towers"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(docs).collect()}
    assert [texts[8][s.start : s.end] for s in got[8]] == ["555-0199"]
    assert pii.KINDS[got[8][0].kind] == "phone"
    assert got[9] == got[10] == []


def test_keys_are_found_by_their_contexts_alone(spark):
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(8)]
    seen = [f'lorem {"abcdefgh"[i]} api key: "{k}"### ipsum' for i, k in enumerate(keys[:6])]
    texts = [*seen, "dolor api key: (zq-77-open), amet", f"commit {keys[6]} of a branch", f"a digest {keys[7]} of it", "api 3 towers", 'x " 9!!!#a'] + ["key of 4"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(texts[r.doc_id][s.start : s.end], pii.SPAN_KINDS[s.kind]) for s in r.spans] for r in pii.personal_data(docs).collect()}
    for i, k in enumerate(keys[:6]):
        assert got[i] == [(k, "secret")]
    assert got[6] == [("zq-77-open", "secret")]
    assert all(got[i] == [] for i in range(7, len(texts)))
    masked = pii.personal_data(docs.where("doc_id = 0 or doc_id < 7"), keep=("doc_id", "text"))
    assert {r.t for r in masked.where("doc_id = 6").select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()} == {"dolor api key: ([SECRET]), amet"}


def test_query_discovers_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quoted = re.compile(r'token = "([0-9a-f]{40})"', re.I)
    added = 0
    for r in op1_pii(spark, sf).collect():
        text = texts[r.doc_id] or ""
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        extra = {(a, b) for k, a, b in spans if k == "secret"}
        want = {m.span(1) for m in quoted.finditer(text)}
        assert extra == {(a, b) for a, b in want if not any(x < b and y > a for x, _, y in brute(text))}
        added += len(extra)
    assert added > 0


def test_contexts_without_seeds_discover_too(spark):
    seen = [f"lorem {w} hotline: +1 (212) 555-01{i:02d} ipsum" for i, w in enumerate("abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyzabcd")]
    found = [f"dolor {w} hotline: 555-02{i:02d}, amet" for i, w in enumerate("abcdefghijkl")]
    again = [f"sed {w} desk: 555-02{i:02d}, amet" for i, w in enumerate("mnopqrstuvwx")]
    texts = [*seen, *found, *again, "elit y desk: 555-0999, amet", "version 3.14 of the 2 towers"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(texts[r.doc_id][s.start : s.end], pii.KINDS[s.kind]) for s in r.spans] for r in pii.personal_data(docs).collect()}
    assert got[len(texts) - 2] == [("555-0999", "phone")]
    assert got[len(texts) - 1] == []


def test_context_reaches_before_another_candidate(spark):
    from pyspark.sql import functions as F

    text = "account A7 jdoe77 and x"
    docs = spark.createDataFrame([(text,)], "text string")
    (row,) = docs.select(pii.candidates(F.col("text"), pii.base_spans(F.col("text"))).alias("c")).collect()
    assert [(c.value, c.last, c.prev, text[c.start : c.end]) for c in row.c] == [("A7", "account", "", "A7"), ("jdoe77", "a7", "account", "jdoe77")]


def test_long_words_are_whole_contexts(spark):
    from pyspark.sql import functions as F

    text = "x " + "w" * 130 + "  12 and " + "é" * 20000 + " 7"
    docs = spark.createDataFrame([(text,)], "text string")
    (row,) = docs.select(pii.candidates(F.col("text"), pii.base_spans(F.col("text"))).alias("c")).collect()
    assert [(len(c.last), c.prev) for c in row.c] == [(130, "x"), (20000, "and")]


def test_very_many_matches_take_no_quadratic_time(spark):
    from pyspark.sql import functions as F

    text = " ".join(f"n{i} a@b{i}.cd" for i in range(50_000))
    docs = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, spans string")
    began = time.monotonic()
    found = pii.personal_data(docs, keep=("doc_id", "text"))
    (row,) = found.select("base", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert time.monotonic() - began < 60
    assert [tuple(s) for s in row.base] == brute(text)
    assert row.t == " ".join(f"n{i} [EMAIL]" for i in range(50_000))


def test_redaction_joins_overlapping_spans(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([("ab cdef gh", [(1, 0, 4), (3, 2, 6), (6, 3, 7), (9, 1, 10)])], "t string, s array<struct<start:int,kind:int,end:int>>")
    assert docs.select(pii.redacted(F.col("t"), F.col("s"))).first()[0] == "a[EMAIL][PHONE] g[IP]"


def test_redaction_replaces_spans(spark):
    docs = spark.createDataFrame([(0, "mail a@b.cd now +1 (212) 555-0100"), (1, "clean"), (2, None)], "doc_id long, text string")
    found = pii.personal_data(docs, keep=("doc_id", "text"))
    from pyspark.sql import functions as F

    got = {r.doc_id: r.t for r in found.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {0: "mail [EMAIL] now [PHONE]", 1: "clean", 2: None}


@pytest.mark.parametrize("rows", [[]])
def test_empty_table(spark, rows):
    assert pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []
