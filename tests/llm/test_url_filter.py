import random
import re
import time

import pytest

from cytoloom.llm import url_filter

SCHEMA, RULES = "page_id long, url string, host string, rule string", "verdict string, host string, path string"


def slow(url, rules, default="allow"):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", "", None, default
    host = m[1].encode().lower().decode()
    fits = [(len(h) + len(p or ""), len(h), v == "block", h + (p or ""), v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and m[2].startswith(p or "")]
    best = max(fits, default=None)
    return host, m[2], best and best[3], best[4] if best else default


URLS = ["http://a.example.com/en/7x?q=1", "https://example.net/de/8", "HTTP://WWW.Example.NET/de/9#x", "ftp://org/es/", "//x", None, "", "://", "http://notexample.com/en/71", "http://x.org", "http://user@h.com:80/en/?", "http://com/en/", "http://.com/en/1", "a://b.net/de/\n8", "x://ÄB.net/de/8", "http://ex ample.com/en/7", "http://exam ple.net/de/8z", "http://example.com /en/7x", "http://example\x01.com/en/7", "http://example\x00.net/de/8", "http://example.com./en/7", "http://example..com/en/7", "http://..net/de/", "http:// com/en/", "http://\x00com/en/"]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_against_brute_force(spark, ranges):
    rng = random.Random(6)
    hosts = ["a", "b.a", "c.b.a", "ab", "x.ab", "d-a", "a.b"]
    rules = url_filter.CONTRACT_RULES + [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(["", "/", "/p", "/p/q", None])) for _ in range(14)] + [("block", None, "/")]
    rules = list(dict.fromkeys(rules))
    rows = [(k, u, "x", "y") for k, u in enumerate(URLS + [f"http://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/q/r?x', '/pq#z'])}" for _ in range(200)] + ["http://hot.a/p"] * 150)]
    rows += [(None, URLS[0], "x", "y"), rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = url_filter.judge(df, spark.createDataFrame(rules, RULES), ["page_id"], ranges=ranges)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = sorted(repr((r[0], *slow(r[1], rules))) for r in rows)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert url_filter.op4_url_filter(none).collect() == []
    some = spark.createDataFrame([(1, "http://a.com/en/", "", "")], SCHEMA)
    [row] = url_filter.judge(some, spark.createDataFrame([], RULES), ["page_id"]).collect()
    assert tuple(row) == (1, "a.com", "/en/", None, "allow")


def test_many_path_rules_on_one_host(spark):
    """Nested and repeated rules; hosts with blanks and control characters in the rules too; ids of any type and name."""
    rng = random.Random(9)
    path = lambda n: "/" + "/".join(rng.choice("abcdef") for _ in range(n))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in [(rng.choice(["big.com", "www.big.com", "b ig.com", "b\x01ig.com"]), path(rng.randrange(9))[: rng.randrange(1, 18)]) for _ in range(40_000)]}.values())
    assert len(rules) > 9_000
    rows = [(bytearray(b"%d" % k), [k], {"k": k}, f"http://{rng.choice(['', 'www.', 'a.www.'])}{rng.choice(['big.com', 'b ig.com', 'b\x01ig.com', 'b\x02ig.com'])}{path(9)}") for k in range(400)]
    df = spark.createDataFrame(rows, "host binary, rule array<long>, path map<string,long>, url string")
    began = time.time()
    got = url_filter.judge(df, spark.createDataFrame(rules, RULES), ["host", "rule", "path"], ranges=3)
    assert got.columns == ["host", "rule", "path", "_host", "_path", "_rule", "verdict"]
    out = {tuple(r[1]): tuple(r[3:]) for r in got.collect()}
    assert time.time() - began < 30
    assert out == {tuple(r[1]): slow(r[3], rules) for r in rows}
