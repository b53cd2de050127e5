import random

from helpers import plain
from pyspark.sql import functions as F

from retailcast.llm.revisits import UPDATED_HEADERS, canonical_url, resolve_revisits

SCHEMA = "record_id long, kind string, url string, time long, etag string, last_modified string, digest string, headers map<string,string>"


def brute(rows):
    out = []
    for r in (r for r in rows if r[1] == "revisit"):
        found = [s for s in rows if s[1] == "response" and s[2] is not None and s[2] == r[2] and None not in (s[3], r[3]) and s[3] < r[3]]
        best = max(found, key=lambda s: (s[3], s[0]), default=None)
        status, validator = "missing", None
        if best:
            status = "unchecked"
            for name, at in (("digest", 6), ("etag", 4), ("last_modified", 5)):
                if r[at] is not None and best[at] is not None:
                    same = r[at].removeprefix("W/") == best[at].removeprefix("W/") if name == "etag" else r[at] == best[at]
                    status, validator = ("resolved" if same else "mismatch"), name
                    break
        headers = dict(r[7] or {})
        if status == "resolved":
            new = {k: v for k, v in headers.items() if k.lower() in UPDATED_HEADERS}
            headers = {k: v for k, v in (best[7] or {}).items() if k.lower() not in {n.lower() for n in new}} | new
        out.append((r[0], best and best[0], status, validator, tuple(sorted(headers.items()))))
    return sorted(out, key=repr)


def result(df):
    return sorted([(r.revisit_id, r.response_id, r.status, r.validator, tuple(sorted(r.headers.items()))) for r in df.collect()], key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    value = lambda: rng.choice([None, "a", "b"])
    tag = lambda: rng.choice([None, "a", "b", "W/a", "W/b"])
    header = lambda: rng.choice([None, {}, {"ETag": "1", "Server": "x"}, {"etag": "2", "date": "3", "x-a": "4"}])
    rows = [
        (i, rng.choice(["response", "revisit", "request"]), rng.choice(["p.org/a", "p.org/b", None]), rng.choice([None, -(10**15), *range(30), 10**15]), tag(), value(), value(), header())
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"slice": F.lit(1), "latest": F.lit(2)})
    for slices in (1, 7, 256):
        assert result(resolve_revisits(df, slices)) == brute(rows)


def test_odd_tables(spark):
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "revisit", None, None, None, None, None, None), (1, "revisit", None, None, None, None, None, None), (2, "revisit", "x.org", 5, "e", None, None, None)]
    assert [r[2] for r in result(resolve_revisits(spark.createDataFrame(rows, SCHEMA)))] == ["missing"] * 3


def test_one_wrong_time_leaves_the_slices_even(spark):
    from retailcast.llm.revisits import _slice

    times = [*range(1000), 10**12]
    edges = [100, 200, 300, 900]
    found = spark.createDataFrame([(t,) for t in times], "time long").groupBy(_slice(F.col("time"), edges).alias("s")).count().collect()
    assert {r.s: r["count"] for r in found} == {0: 101, 1: 100, 2: 100, 3: 600, 4: 100}
    rows = [(t, "revisit" if t % 2 else "response", "p.org", t, None, None, None, None) for t in times]
    assert {r[1] for r in result(resolve_revisits(spark.createDataFrame(rows, SCHEMA), 16))} == set(range(0, 1000, 2))


def test_canonical_urls(spark):
    cases = {
        "HTTPS://www.Example.com/En/1.html?utm_source=feed#top": "example.com/En/1",
        "http://m.example.com/En/1/": "example.com/En/1",
        "https://example.com?ref=x&page=2&utm_a=b": "example.com?page=2",
        "https://example.com/?b=2&a=1&c": "example.com?a=1&b=2&c",
        "https://example.com:443/a": "example.com/a",
        "http://Example.com:80": "example.com",
        "example.com:80?a=1": "example.com?a=1",
        "http://example.com:443/a": "example.com:443/a",
        "https://example.com:8443/a": "example.com:8443/a",
        "": "",
    }
    df = spark.createDataFrame([(u,) for u in [*cases, None]], "url string")
    assert plain(df.select(canonical_url(F.col("url")))) == sorted([(c,) for c in [*cases.values(), None]], key=repr)
