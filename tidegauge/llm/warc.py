"""Not-modified revisits of a crawl, resolved against the response they stand for.

A revisit record says that a page had not changed since an earlier capture.
It is resolved to the latest earlier full response of the same canonical URL,
an as-of join on (canonical URL, capture time): both sides are stacked and
scanned once, and a URL with very many captures is cut into blocks.  Only
validators and headers travel through it, never bodies.  The validators must
agree; then the stored headers are brought up to date with those headers of the
revisit that a not-modified answer may change.

Defined cases: null or empty URLs match nothing; responses captured at the very
time of a revisit are not earlier; of several at one time the greatest record id
counts; repeated revisits are each resolved; a null capture time resolves to
nothing and serves nothing; header names are compared in lower case, and of names
that differ only in case the one that sorts last counts; null headers are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.plans.ordered import asof

#: Headers that a not-modified answer may bring up to date.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that only trace where a visitor came from.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="

RECORD = ("record_id", "url", "captured_at", "record_type", "etag", "last_modified", "headers")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without trailing slash, sorted parameters without tracking, no scheme or fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    parameters = F.split(F.regexp_extract(rest, "[?](.*)$", 1), "&")
    kept = F.array_sort(F.filter(parameters, lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, path, query))


def _lowered(headers: Column) -> Column:
    """Header map with names in lower case."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    entries = F.transform(F.array_sort(F.map_entries(F.coalesce(headers, none))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def _etag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged_headers(stored: Column, answer: Column) -> Column:
    """Stored headers with the permitted ones of a not-modified answer."""
    allowed = F.map_filter(_lowered(answer), lambda k, v: k.isin(*PERMITTED))
    return F.map_concat(F.map_filter(_lowered(stored), lambda k, v: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve(records: DataFrame) -> DataFrame:
    """Per revisit: record_id, url_key, captured_at, ``response_id``, ``state`` and merged ``headers``.

    ``state`` is resolved, mismatch (a validator that both have differs),
    unverified (they have none in common) or missing (no earlier response);
    only a resolved revisit has a response id and headers.
    """
    keyed = records.select(*RECORD, canonical_url(F.col("url")).alias("url_key"))
    revisits = keyed.where("record_type = 'revisit'").drop("record_type", "url")
    full = keyed.where("record_type = 'response' AND url_key IS NOT NULL AND captured_at IS NOT NULL").select(
        "url_key",
        "captured_at",
        "record_id",
        F.struct("record_id", "etag", "last_modified", "headers").alias("response"),
    )
    found = asof(revisits, full, ["url_key"], ["captured_at", "record_id"], ["captured_at", "record_id"], ["response"], right_first=False)
    r = F.col("response")
    known = (F.col("etag").isNotNull() & r["etag"].isNotNull()) | (F.col("last_modified").isNotNull() & r["last_modified"].isNotNull())
    same_tag = F.coalesce(_etag(F.col("etag")) == _etag(r["etag"]), F.lit(True))
    # A date is a validator only where tags can't be compared.
    tagged = F.col("etag").isNotNull() & r["etag"].isNotNull()
    same_date = tagged | F.coalesce(F.col("last_modified") == r["last_modified"], F.lit(True))
    state = (
        F.when(r.isNull() | F.col("captured_at").isNull(), "missing").when(~known, "unverified").when(same_tag & same_date, "resolved").otherwise("mismatch")
    )
    judged = found.withColumn("state", state)
    good = F.col("state") == "resolved"
    return judged.select(
        "record_id",
        "url_key",
        "captured_at",
        F.when(good, r["record_id"]).alias("response_id"),
        "state",
        F.when(good, merged_headers(r["headers"], F.col("headers"))).alias("headers"),
    )


def with_bodies(resolved: DataFrame, records: DataFrame, body: str = "body") -> DataFrame:
    """Resolved revisits with the body of their response."""
    bodies = records.where("record_type = 'response'").select(F.col("record_id").alias("response_id"), body)
    return resolved.join(bodies, "response_id", "left")
