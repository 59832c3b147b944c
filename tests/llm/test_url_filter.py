import re

import duckdb

from tessera.llm.url_filter import PATH_RULES, PATTERN_RULES, filter_urls, oracle, rarest_tokens

URLS = [
    None, "", "no scheme.org/es/", "http://", "http://EXAMPLE.org/es/x?y", "https://a.example.org/en/19#z", "https://a.example.org/en/2",
    "https://badexample.org/es/", "http://x.com/de/1?ref=/fr/", "http://com/fr/", "http://com?fr/", "http://example.org", "http://t.net/fr/1",
    "https://m.ads-track.example.net/es/1/", "https://x.net/User/Login?next=1", "https://x.net/?a=1&PHPSESSID=ab12", "http://casino.net/", "http://xcasino.net/",
    "http://b.adserver.net/q", "http://m.y.net/a/print", "http://y.net/tag/a/feed/", "http://y.net/shop/cart#a", "a://b://c.org/x", "http://ü.org:80/\nx",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in PATH_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        r = max(fits, key=lambda r: len(r.host + r.path))
        return host, path, r.host + r.path, r.verdict, None
    low = "".join(c.lower() if c.isascii() else c for c in url or "")
    names = [r.name for r in PATTERN_RULES if re.search(r.pattern, low)]
    return host, path, None, "block" if names else "allow", min(names, default=None)


def test_against_brute_force_and_sql(spark):
    rows = [(i, u, "rule", "host") for i, u in enumerate(URLS)] + [(None, "http://casino.net/", None, None)] * 2
    got = sorted((tuple(r) for r in filter_urls(spark.createDataFrame(rows, "page_id long, url string, rule string, host string")).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)
    with duckdb.connect() as c:
        c.execute("create table pages (page_id bigint, url varchar)")
        c.executemany("insert into pages values (?, ?)", [r[:2] for r in rows])
        assert sorted(c.sql(oracle()).fetchall(), key=str) == got


def test_empty_table_and_long_url(spark):
    schema = "page_id long, url string"
    assert filter_urls(spark.createDataFrame([], schema)).collect() == []
    url = "http://z.net/" + "a/" * 100_000 + "login"
    assert filter_urls(spark.createDataFrame([(1, url)], schema)).first().pattern == "sign-in"


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("http://a/ads/x",), ("http://a/ads/y",), ("http://track/",)], "url string")
    assert rarest_tokens(urls, PATTERN_RULES)["ad-host"] == "track"
