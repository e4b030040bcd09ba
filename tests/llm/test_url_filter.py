import re

from tonnage.llm import url_filter as U

URLS = [None, "", "no scheme/es/", "http://example.org/es/", "https://A.Example.ORG/es/x?/fr/", "http://example.org/en/123", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/1#a", "http://com/fr/", "ftp://org", "http://org/", "http://a.org?x", "http://a.org:80/", "http://b.example.org/en/2", "a://b://c.com/de/", "http:///es/", "http://é.com/de/é", "http://x.com/de/" + "y" * 5000, "http://x.com/FR/", "http://a\nb.org/x\ny"]


def by_hand(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, False, None, otherwise))
    return host, path, best[3], best[4]


def test_against_brute_force(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(0, None), (3, URLS[3]), (None, URLS[4])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "'y' as path", "'z' as rule", "1 as full")
    more = [*U.RULES, ("example.org", "/", "block"), ("org", "/es/", "allow"), ("b.example.org", "", "allow"), ("EXAMPLE.org", "/en/1", "allow")]
    for rules in (U.RULES, more, []):
        table = U.rule_table(spark, rules)
        low = [(h.lower(), p, v) for h, p, v in rules]
        got = sorted(map(repr, map(tuple, U.judged(pages, table).collect())))
        assert got == sorted(repr((i, *by_hand(u, low))) for i, u in rows)
    assert U.judged(pages.limit(0), U.rule_table(spark, U.RULES)).count() == 0


def test_very_long_urls(spark):
    labels, path = ".".join(["ab"] * 60_000), "/es/" + "y" * 1_000_000
    urls = [f"http://{labels}.example.org{path}", f"http://{labels}.net/es/", "http://" + "." * 50_000 + "org/", "http://" + "x" * 500_000 + ".com/de/?" + "q" * 500_000, "http://x.org./es/"]
    rows = list(enumerate(urls))
    for rules in (U.RULES, [("a.b.example.org", "/", "block"), ("", "/es/", "block"), ("ab.ab.example.org", "/es/yy", "allow")]):
        got = U.judged(spark.createDataFrame(rows, "page_id long, url string"), U.rule_table(spark, rules)).collect()
        assert sorted(map(tuple, got)) == [(i, *by_hand(u, rules)) for i, u in rows]


def test_plan_is_native(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = U.judged(pages, U.rule_table(spark, U.RULES))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Cartesian", "NestedLoop"))
