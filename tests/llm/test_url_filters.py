from quern.llm.queries import URL_RULES
from quern.llm import skew
from quern.llm.url_filters import judge_urls

URLS = [
    (1, "http://a.Example.COM/en/7x?q=/de/"), (2, "https://x.net/de/8"), (3, "https://example.net/de/81#t"), (4, None), (5, "no scheme"),
    (6, "ftp://org/es/"), (7, "http://notexample.com/en"), (8, "http://com/en/"), (9, "http://example.com?x"), (8, "http://com/en/"),
    (None, "http://example.com/en/7"), (10, ""), (11, "http://" + "a." * 3000 + "com/en/" + "z" * 9000), (12, "http://exam\u212Aple.com/en/"),
]


def brute(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def judged(spark, **more):
    pages = spark.createDataFrame([(*u, "extra") for u in URLS], "page_id long, url string, host string")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return judge_urls(pages, rules, **more).select("page_id", "host", "path", "rule", "verdict").collect()


def test_equals_brute_force(spark):
    expected = sorted(repr((i, *brute(u))) for i, u in URLS)
    assert sorted(repr(tuple(r)) for r in judged(spark)) == expected


def test_shuffled_rules_agree_with_broadcast(spark):
    assert sorted(map(repr, judged(spark, broadcast_rules=0))) == sorted(map(repr, judged(spark)))


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    assert {r["verdict"] for r in judge_urls(pages, rules).collect()} == {"allow"}
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_common_urls_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(skew, "FLOOR", 10)
    rows = [(i, URLS[i % 3 if i % 2 else 3][1]) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    got = judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, *brute(u))) for i, u in rows)
