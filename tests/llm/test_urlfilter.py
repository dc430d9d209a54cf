import re

from quire.llm import urlfilter as uf
from quire.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Spam.Example.COM/a?b://c", "https://a.example.org/es/1", "https://example.org/en/1x", "https://example.org/en/2", "https://notexample.org/es/", "http://x.com/fr/1", "http://x.com/de/1", "http://com/de/", "http://bad.net?x=1", "http://sub.bad.net#f", "http://verybad.net/", "http://ÜBER.net/é", "http://x.org?y", "x://y://z/", "http://a..b/", "http://bad.net/\n/x", "ftp://bad.net/", "ftp://bad.net/"]
LISTED = [("bad.net",), ("SPAM.example.com",), (None,), ("bad.net",), ("unseen.net",)]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for what, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = what, h + p
    listed = any(host == k or host.endswith("." + k) for k in ("bad.net", "spam.example.com", "unseen.net"))
    return host, path, best and best[1], best[0] if best else "block" if listed else "allow"


def test_judge_is_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate(URLS)], "page_id bigint, url string, key string, rows string")
    out = uf.judge(spark, pages, spark.createDataFrame(LISTED, "key string"), URL_RULES)
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()) == [(i, *brute(u)) for i, u in enumerate(URLS)]
    plan = out._jdf.queryExecution().toString()
    assert "Join" not in plan and "Python" not in plan


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) as key")
    listed = universe.filter("crc32(cast(key as binary)) % 11 = 0")
    cascade = uf.Cascade.build(spark, listed, universe)
    assert len(cascade.levels) > 2
    wrong = universe.withColumn("in", cascade.contains(universe.key)).filter("`in` <> (crc32(cast(key as binary)) % 11 = 0)")
    assert wrong.count() == 0


def test_blocks_empty_lists_and_tables(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://bad.net/"), (2, "http://spam.example.com/")], "page_id bigint, url string")
    listed = spark.createDataFrame(LISTED, "key string")
    verdicts = lambda df: sorted((r.page_id, r.verdict) for r in df.collect())
    assert verdicts(uf.judge(spark, pages, listed.limit(0), ())) == [(1, "allow"), (2, "allow")]
    assert uf.judge(spark, pages.limit(0), listed, URL_RULES).collect() == []
    monkeypatch.setattr(uf, "BLOCK_KEYS", 1)
    assert verdicts(uf.judge(spark, pages, listed, ())) == [(1, "block"), (2, "block")]
