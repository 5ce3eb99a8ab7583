"""WARC: resolve not-modified revisits to the full responses they stand for.

An as-of join: each revisit finds the latest earlier full response of its canonical URL. Time is cut
into a bounded number of spans with about equal numbers of records; within a span a window over (URL,
span) carries the last response forward, and one small row for each URL and span that has a response
carries it over to later spans. So a URL that holds a third of all records is worked on in as many
tasks as there are spans. Payloads never travel, only ids, validators and headers.

Then validators are checked, and headers are merged as for a stored response that was validated.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spans of time into which captures are cut.
SPANS = 256
# Header fields that a 304 must not change in the stored response (RFC 9111, section 3.2, and
# RFC 9110: content and message framing, hop-by-hop).
KEPT_AS_STORED = (
    "connection", "content-encoding", "content-length", "content-location", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
# Query parameters that only track where a visitor came from.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid|sid"


def canonical_url(url: Column, tracking: str = TRACKING) -> Column:
    """Scheme, fragment, user, default port, leading "www.", tracking parameters (names that match ``tracking``) and a trailing
    slash go; the host is lower-cased and parameters are sorted. Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.regexp_extract(bare, "^[^?]*", 0)
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    host = F.lower(F.regexp_extract(path, "^[^/]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), "^www[.]", "")
    rest = F.regexp_replace(F.regexp_extract(path, "^[^/]*(.*)$", 1), "/+$", "")
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({tracking})(=|$)"))
    args = F.array_join(F.array_sort(parts), "&")
    return F.concat(host, rest, F.when(args == "", F.lit("")).otherwise(F.concat(F.lit("?"), args)))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers, with those of the 304 in their place where permitted; names in lower case,
    and of names that differ in case only one, the last. Null counts as no headers."""

    def low(m: Column) -> Column:
        entries = F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        after = lambda i: F.slice(entries, i + 2, F.size(entries))
        last = F.filter(entries, lambda e, i: ~F.exists(after(i), lambda x: x["key"] == e["key"]))
        return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))

    new = F.map_filter(low(update), lambda k, v: ~k.isin(*KEPT_AS_STORED))
    old = F.map_filter(low(stored), lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(old, new)


def _same_etag(a: Column, b: Column) -> Column:
    """Weak comparison: the W/ prefix doesn't count. Null if one is missing."""
    bare = lambda x: F.regexp_replace(F.trim(x), "^[Ww]/", "")
    return bare(a) == bare(b)


def resolve_revisits(records: DataFrame, spans: int = SPANS, tracking: str = TRACKING) -> DataFrame:
    """records: record_id (long), url, ts (long), type ("response", a full one, or "revisit"), etag,
    last_modified, digest (string) and headers (map of strings).

    Returns one row for each revisit: record_id, canonical_url, ts, refers_to (record_id of the latest
    full response of the same canonical URL with a smaller ts; of equal ts the one with the largest
    record_id), refers_ts, status and headers (merged; null unless resolved).
    status: "resolved" if a validator agrees (etag by weak comparison; without etags on both sides
    last_modified; without those digest), "mismatch" if it differs, "unvalidated" if the two
    have no validator in common, "missing" if there is no earlier response or the URL or ts is null.
    Rows of another or a null type, and responses with a null url, ts or record_id, are not
    looked at. Repeated revisits give repeated rows. Other columns are ignored. An empty
    table gives an empty table.
    """
    fields = ("record_id", "ts", "etag", "last_modified", "digest", "headers")
    rows = records.filter("type IN ('response', 'revisit')").select(canonical_url(F.col("url"), tracking).alias("canonical_url"), "type", *fields)
    full = F.col("type") == "response"
    rows = rows.filter(~full | F.col("canonical_url").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull())
    cuts = rows.agg(F.percentile_approx("ts", [i / spans for i in range(1, spans)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    # how many cuts lie below ts
    limits = F.array(*(F.lit(c).cast("long") for c in cuts))
    span = F.size(F.filter(limits, lambda c: c < F.col("ts"))) if cuts else F.lit(0)
    rows = rows.withColumn("_span", span)
    payload = F.when(full, F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    # at one ts revisits come before responses, so a response is never earlier than a revisit of its own time
    order = [F.col("ts").asc(), F.when(full, 1).otherwise(0).asc(), F.col("record_id").asc()]
    before = Window.partitionBy("canonical_url", "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumn("_last", F.last(payload, ignorenulls=True).over(before)).filter("type = 'revisit'")
    key = F.struct("ts", "record_id")
    latest = F.max_by(F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"), key)
    carry = rows.filter(full).groupBy(F.col("canonical_url").alias("_u"), F.col("_span").alias("_s")).agg(latest.alias("_c"))
    need = within.filter("_last IS NULL").select(F.col("canonical_url").alias("_u"), F.col("_span").alias("_s")).distinct()
    marks = carry.unionByName(need.withColumn("_c", F.lit(None).cast(carry.schema["_c"].dataType)))
    marks = marks.groupBy("_u", "_s").agg(F.first("_c", ignorenulls=True).alias("_c"))
    earlier = Window.partitionBy("_u").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # at most one row for each span
    marks = marks.select("_u", "_s", F.last("_c", ignorenulls=True).over(earlier).alias("_before")).filter("_before IS NOT NULL")
    found = within.join(marks, (F.col("canonical_url") == F.col("_u")) & (F.col("_span") == F.col("_s")), "left")
    found = found.withColumn("_r", F.when(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull(), F.coalesce("_last", "_before")))
    agrees = F.coalesce(_same_etag(F.col("etag"), F.col("_r.etag")), F.col("last_modified") == F.col("_r.last_modified"), F.col("digest") == F.col("_r.digest"))
    status = F.when(F.col("_r").isNull(), "missing").when(agrees, "resolved").when(~agrees, "mismatch").otherwise("unvalidated")
    out = found.withColumn("status", status)
    return out.select(
        "record_id",
        "canonical_url",
        "ts",
        F.col("_r.record_id").alias("refers_to"),
        F.col("_r.ts").alias("refers_ts"),
        "status",
        F.when(F.col("status") == "resolved", merged_headers(F.col("_r.headers"), F.col("headers"))).alias("headers"),
    )


def two_crawls(pages: DataFrame) -> DataFrame:
    """A capture log of pages (page_id, url, html): a first crawl with a full response for each page in
    order of page_id, and a second one whose answers to conditional requests are all "not modified",
    with the validators of the page as first seen. A null html counts as empty; repeated page_ids are captures of their own,
    with the same record_id and time."""
    body = F.coalesce("html", F.lit(""))
    digest = F.sha2(body, 256)
    base = pages.select(F.col("page_id").alias("record_id"), "url", digest.alias("digest"), F.length(F.encode(body, "UTF-8")).alias("_n"))
    strings = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    etag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    none, weak = F.lit(None).cast("string").alias("last_modified"), F.concat(F.lit("W/"), etag)
    size, page = F.col("_n").cast("string"), F.col("record_id").cast("string")
    kept = strings("Content-Type", "text/html", "Content-Length", size, "ETag", etag, "Cache-Control", "max-age=60", "X-Crawl", "1")
    told = strings("Content-Length", "0", "ETag", weak, "Cache-Control", "max-age=600", "Date", page)
    names = lambda kind: F.lit(kind).alias("type")
    first = base.select("record_id", "url", F.col("record_id").alias("ts"), names("response"), etag.alias("etag"), none, "digest", kept.alias("headers"))
    later = (F.col("record_id") + (1 << 40)).alias("ts")
    second = base.select("record_id", "url", later, names("revisit"), weak.alias("etag"), none, "digest", told.alias("headers"))
    return first.unionByName(second)
