from loxo.llm.urls import RULES, judge

URLS = [
    "http://a.example.com/en/825?page=2", "https://EXAMPLE.com/en/7", "https://example.com/en/70/x#y", "http://badexample.com/en/7", "x://b.example.net/de/8?z", "http://q.net/de/81",
    "ftp://org/es/", "http://org/es", "http://a.org?/es/", "no scheme/en/", None, "", "http://", "://com/en/", "http://com:80/en/", "http://www.com./en/x", "a://b://c.com/en/", "HTTP://ÀB.COM/en/é", "http://.com/en/z", "http://a.example.com/EN/7",
]


def brute(url, rules=RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
        tail = rest[k:]
        path = tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i % 19, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = sorted((r.page_id, r.url or "", r.host, r.path, r.rule or "", r.verdict) for r in judge(df).collect())
    want = sorted((i % 19, u or "", *(x or "" for x in brute(u))) for i, u in enumerate(URLS))
    assert got == want


def test_many_rules_without_broadcast_and_short_prefix(spark, monkeypatch):
    import loxo.llm.urls as m

    monkeypatch.setattr(m, "BROADCAST_RULES", 1)
    rules = RULES + (("block", "example.com", ""), ("allow", "c.com", "/en/"))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df, rules=rules, prefix_digits=1).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(URLS)}


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert judge(df).collect() == [] and judge(df, rules=()).collect() == []
