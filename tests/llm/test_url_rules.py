import random

from tradewind.llm.queries import RULES
from tradewind.llm.url_rules import match_url_rules

URLS = "page_id long, url string, host string, rule int"


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:n].translate({c: c + 32 for c in range(65, 91)}), rest[n:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else default


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "clash", 7) for i, u in urls], URLS)
    got = match_url_rules(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    assert got[0].__fields__ == ["page_id", "host", "path", "rule", "verdict"] if got else True
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *brute(u, rules))) for i, u in urls)


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://org", "http://ORG/", "HTTP://A.example.org/es/x?y", "x://example.org/en/12#t", "x://y://org/", "http://myexample.org/es/"]
    urls += ["http://org?x", "http://example.org\n/es/", "http://É.org/", "http://.org/", "http://org./", "http://a.com/fr/" + "p" * 50_000, "http://organic.com/de/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(1, ""), (1, ""), (None, "http://org/"), (None, None)]
    check(spark, rows, RULES)


def test_nested_rules_and_a_hot_key(spark):
    rng = random.Random(5)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "com", "x.org"]
    rules = {(h, "/" + "ab"[: rng.randint(0, 2)] * rng.randint(0, 2)) for h in hosts for _ in range(4)} | {("a.com", ""), ("com", "")}
    rules = [("block" if len(h + p) % 2 else "allow", h, p) for h, p in sorted(rules)]
    urls = [(i, f"http://{rng.choice(hosts)}/{'ab' * rng.randint(0, 3)}{rng.choice(['', 'a', 'zz'])}") for i in range(400)] + [(i, "http://c.b.a.com/abab") for i in range(400, 800)]
    check(spark, urls, rules)


def test_two_verdicts_of_one_rule_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    rules = spark.createDataFrame([("allow", "b", "/"), ("block", "b", "/")], "verdict string, host string, path string")
    assert match_url_rules(pages, rules).first().verdict == "block"
    assert match_url_rules(pages, rules.limit(0), default="block").first()[3:] == (None, "block")
    assert match_url_rules(pages.limit(0), rules).collect() == []
