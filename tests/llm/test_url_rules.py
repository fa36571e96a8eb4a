import re

from quern.llm.url_rules import judge_urls, pattern_tokens, rule_table


def test_rules(spark):
    urls = {
        1: ("http://a.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"),
        2: ("https://example.org/en/123", "example.org", "/en/123", "example.org/en/1", "block"),
        3: ("x://example.org/en/23", "example.org", "/en/23", "org/", "allow"),
        4: ("http://notexample.org", "notexample.org", "", None, "allow"),
        5: ("http://shop.com/de/?q=http://x.org/", "shop.com", "/de/", "com/de/", "block"),
        6: ("http://shop.com/de", "shop.com", "/de", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("no scheme", "", "", None, "allow"),
        9: ("http://casino.net/x", "casino.net", "/x", None, "block"),
        10: ("http://xcom/de/", "xcom", "/de/", None, "allow"),
        11: ("http://?a", "", "", None, "allow"),
        12: ("http://\u00c9.com/fr/" + "a" * 9000, "\u00c9.com", "/fr/" + "a" * 9000, "com/fr/", "allow"),
    }
    rows = [(k, v[0], "x") for k, v in urls.items()] + [(1, urls[1][0], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, token string")
    got = judge_urls(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.page_id][1:], r


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


PLAIN = {
    "||casino^": r"^([^/]*\.)?casino([^A-Za-z0-9-]|$)",
    "||ads*.net/x^": r"^([^/]*\.)?ads[^/]*\.net/x([^A-Za-z0-9-]|$)",
    "**/login*.php|": r".*/login[^/]*\.php$",
    "|www.a+b.*/**/end|": r"^www\.a\+b\.[^/]*/.*/end$",
    "*.*": r"[^/]*\.[^/]*",
    "free-*-download": r"free-[^/]*-download",
}
URLS = ["casino.net", "my.casino", "casinos.net", "ads7.net/x", "b.ads.net/x/y", "ads.net/xy", "a.b/c/login9.php", "a.b/login.php/", "www.a+b.c/d/e/end", "www.aab.c/d/end", "free-x-download.io", "get/free--download", "", "Casino.net/casino"]


def test_patterns_match_plain_expressions(spark):
    pages = spark.createDataFrame([(i, "http://" + u) for i, u in enumerate(URLS)], "page_id long, url string")
    for pattern, regex in PLAIN.items():
        got = judge_urls(pages, rule_table(spark, rules=(), patterns=(pattern,))).collect()
        assert len(got) == len(URLS)
        for r in got:
            assert (r.verdict == "block") == bool(re.search(regex, r.host + r.path, re.S)), (pattern, r.host + r.path)


def test_tokens_of_patterns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(p,) for p in PLAIN], "p string").select("p", pattern_tokens(F.col("p")).alias("t")).collect()
    assert {r.p: r.t for r in rows} == {"||casino^": ["w:casino"], "||ads*.net/x^": ["w:net", "w:x"], "**/login*.php|": ["w:php"], "|www.a+b.*/**/end|": ["w:www", "w:a", "w:b", "w:end"], "*.*": [], "free-*-download": []}
