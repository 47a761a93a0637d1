import random

from tests.llm.oracle import rows_match
from tracewright.llm import queries, url_filter


def brute(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def test_against_brute_force(spark):
    rng = random.Random(1)
    labels = ["a", "b", "com", "x-y", "c"]
    name = lambda n: ".".join(rng.choice(labels) for _ in range(rng.randint(1, n)))
    path = lambda: "/" + "/".join(rng.choice(["p", "q", "pq", ""]) for _ in range(rng.randint(0, 3)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((name(3), rng.choice(["", path()])) for _ in range(60))}.values())
    urls = [rng.choice(["http://", "HTTPS://", ""]) + name(4).upper() + rng.choice(["", path()]) + rng.choice(["", "?a/b", "#x"]) for _ in range(600)]
    urls += [None, "", "://", "http://", "http:///p", "a://b://com/p", "http://a.com..", "http://.com/p", "http://com?x://y"] + ["http://hot.com/p/1"] * 500
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "'y' as bucket").repartition(5)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(pages, table, "block", buckets=7).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == brute(u, rules, "block"), u


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/p"), (1, "http://a.com/p"), (None, None)], "page_id long, url string")
    rules = spark.createDataFrame([(None, "/p", "block"), ("", "", "block")], "host string, path string, verdict string")
    assert [r.verdict for r in url_filter.filter_urls(pages, rules).collect()] == ["allow"] * 3
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_sql(spark):
    rows_match(spark, queries.op4_url_filter, queries.OP4_SQL)
