"""The temporal join against looking through the whole list for each capture."""

import random
from datetime import datetime, timedelta

from waybill.llm.urlfilter import KINDS, judged

START = datetime(2024, 1, 1)
STRENGTH = {"block": 2, "allow": 1}


def tables(spark, captures, entries):
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz")
    e = spark.createDataFrame(entries, "kind string, key string, action string, listed_at timestamp_ntz")
    return c.selectExpr("*", "'x' AS kind", "'y' AS period"), e.selectExpr("*", "1 AS page_id", "2 AS period")


def keys(url):
    if not url or "://" not in url:
        return {}
    rest = url.split("://", 1)[1]
    host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower()
    path = rest[len(rest.split("/")[0]) :].split("?")[0].split("#")[0]
    out = {"host": host, "domain": ".".join(host.split(".")[-2:]) if "." in host else None}
    return out | ({"prefix": host + "/" + path.split("/")[1]} if path else {})


def slow(captures, entries):
    out = []
    for page, url, at in captures:
        found = None
        for kind in KINDS:
            key = keys(url).get(kind)
            known = [e for e in entries if None not in e and e[0] == kind and at and e[3] <= at]
            known = [e for e in known if (e[1] if kind == "prefix" else e[1].lower()) == key]
            if known and found is None:
                last = max(known, key=lambda e: (e[3], STRENGTH.get(e[2], 0)))
                found = last if last[2] in STRENGTH else None
        row = (found[0], keys(url)[found[0]], found[2], found[3]) if found else (None,) * 4
        out.append((page, url, at, *row, bool(found and found[2] == "block")))
    return sorted(out, key=str)


def check(spark, captures, entries):
    assert sorted((tuple(r) for r in judged(*tables(spark, captures, entries)).collect()), key=str) == slow(captures, entries)


def test_random_histories(spark):
    rng = random.Random(9)
    hosts = ["a.example.com", "b.example.com", "example.com", "c.other.org", "single"]
    when = lambda days: START + timedelta(hours=rng.randint(0, 24 * days))
    captures = [
        (k, f"https://{rng.choice(hosts[:1] * 5 + hosts)}{rng.choice(['', '/', '/en/x', '/EN/y?q=1', '/de#t'])}", when(400))
        for k in range(600)
    ]
    names = hosts + ["A.example.COM", "other.org"]
    entries = [("host", rng.choice(names), rng.choice(["block", "allow", "remove"]), when(380)) for _ in range(60)]
    entries += [("domain", rng.choice(names), rng.choice(["block", "allow", "remove"]), when(380)) for _ in range(30)]
    entries += [("prefix", f"a.example.com/{rng.choice(['en', 'EN', ''])}", rng.choice(["block", "allow"]), when(380)) for _ in range(9)]
    check(spark, captures, entries)


def test_awkward_rows(spark):
    day = timedelta(days=1)
    captures = [
        (1, None, START), (2, "", START), (3, "not a url", START), (4, "http://x.org/a", None), (None, "http://x.org/a", START),
        (5, "http://x.org/a", START), (5, "http://x.org/a", START), (6, "http://x.org/a", START - day), (7, "http://x.org", START + day),
        (8, "HTTP://user:pw@X.org:8080/a?b", START + 200 * day), (9, "http://x.org/" + "a" * 5000, START + 3 * day),
    ]
    entries = [
        ("host", "x.org", "allow", START), ("host", "x.org", "block", START), ("host", "x.org", "block", START),
        ("host", "x.org", "gone", START + day), ("host", "x.org", "allow", START + 100 * day), (None, "x.org", "block", START),
        ("host", None, "block", START), ("host", "x.org", None, START), ("host", "x.org", "block", None),
        ("domain", "x.org", "block", START + 2 * day), ("host", "x.org", "block", START + 9000 * day),
    ]
    check(spark, captures, entries)


def test_empty(spark):
    check(spark, [], [("host", "x.org", "block", START)])
    check(spark, [(1, "http://x.org", START)], [])
