import random

import pytest
from pyspark.sql import functions as F

from loomstone.llm.warc import canonical_url, merged_headers, resolve_revisits, two_crawls

SCHEMA = "record_id long, url string, ts long, type string, etag string, last_modified string, digest string, headers map<string,string>"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://www.Example.com:80/a/b/?z=1&utm_source=x&a=2#top", "example.com/a/b?a=2&z=1"),
        ("HTTPS://user@Example.com/A", "example.com/A"),
        ("example.com", "example.com"),
        ("http://e.org/?ref=1", "e.org"),
        ("http://e.org/a?reference=1&ref", "e.org/a?reference=1"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u"))).first()[0] == want


def brute(rows):
    out = []
    for i, url, ts, kind, etag, modified, digest, _ in rows:
        if kind != "revisit":
            continue
        best = None
        for r in rows:
            if r[3] == "response" and r[1] is not None and r[1] == url and r[2] is not None and ts is not None and r[0] is not None and r[2] < ts and (best is None or (r[2], r[0]) > (best[2], best[0])):
                best = r
        if best is None:
            out.append((str(i), None, "missing"))
            continue
        bare = lambda e: e.removeprefix("W/").removeprefix("w/")
        if etag is not None and best[4] is not None:
            same = bare(etag) == bare(best[4])
        elif modified is not None and best[5] is not None:
            same = modified == best[5]
        elif digest is not None and best[6] is not None:
            same = digest == best[6]
        else:
            same = None
        out.append((str(i), best[0], {True: "resolved", False: "mismatch", None: "unvalidated"}[same]))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(((str(r.record_id), r.refers_to, r.status) for r in resolve_revisits(df, **kw).collect()), key=str)


@pytest.mark.parametrize("spans", [2, 16, 256])
def test_as_of_with_a_hot_url(spark, spans):
    rng = random.Random(spans)
    rows = []
    for i in range(600):
        url = "hot/x" if rng.random() < 0.4 else f"h{rng.randrange(20)}/p"
        some = lambda *v: rng.choice([None, *v])
        rows.append((i, url, rng.randrange(300), rng.choice(["response", "revisit", "revisit"]), some('"a"', 'W/"a"', '"b"'), some("mon", "tue"), some("d1", "d2"), {"Date": str(i)}))
    rows += [(700, None, 5, "revisit", None, None, None, None), (701, "hot/x", None, "revisit", None, None, None, None), (702, "hot/x", 3, "request", None, None, None, None), (703, None, 4, "response", None, None, None, None), (704, "hot/x", None, "response", None, None, None, None), (705, "hot/x", 9, None, None, None, None, None), (None, "hot/x", 299, "response", None, None, None, None), rows[3], rows[4]]
    assert run(spark.createDataFrame(rows, SCHEMA), spans=spans) == brute(rows)


def test_headers(spark):
    df = spark.createDataFrame([({"Content-Type": "text/html", "ETag": "1", "X": "old"}, {"etag": "2", "content-length": "0", "x": "new", "Date": "now"})], "s map<string,string>, u map<string,string>")
    got = df.select(merged_headers(F.col("s"), F.col("u"))).first()[0]
    assert got == {"content-type": "text/html", "etag": "2", "x": "new", "date": "now"}
    none = df.select(merged_headers(F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,string>"))).first()[0]
    assert none == {}
    twice = spark.createDataFrame([({"A": "1", "a": "1", "B": "2"},)], "s map<string,string>")
    assert twice.select(merged_headers(F.col("s"), F.lit(None).cast("map<string,string>"))).first()[0] == {"a": "1", "b": "2"}


def test_pages_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "one"), (2, "https://www.a.org/x/", "two"), (3, "http://b.org", None), (4, None, "x"), (2, "https://www.a.org/x/", "two")], "page_id long, url string, html string")
    got = sorted((r.record_id, r.refers_to, r.status) for r in resolve_revisits(two_crawls(pages)).collect())
    assert got == [(1, 2, "mismatch"), (2, 2, "resolved"), (2, 2, "resolved"), (3, 3, "resolved"), (4, None, "missing")]
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
    more = two_crawls(pages).withColumns({n: F.lit(1) for n in ("_span", "_last", "_u", "_s", "_c", "status")})
    assert resolve_revisits(more).count() == 5


def test_tracking_names_are_a_parameter(spark):
    from loomstone.llm.warc import canonical_url

    df = spark.createDataFrame([("http://a.org/x?ref=1&id=2&from=3",)], "u string")
    got = df.select(canonical_url(df.u).alias("a"), canonical_url(df.u, "from|via").alias("b")).first()
    assert (got.a, got.b) == ("a.org/x?from=3&id=2", "a.org/x?id=2&ref=1")
