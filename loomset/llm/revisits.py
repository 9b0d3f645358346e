"""Not-modified revisits of web captures, resolved to the response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.sources.storage import stored

#: Rows of a range of pages and times that one task orders, on average.
SLICE_ROWS = 100_000
# Fields that a not-modified response must not change (RFC 9111, section 3.2),
# with those that describe the stored body.
KEPT = ["content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection"]


#: What makes no difference to an address: host prefixes, and fields that only name where a visitor came from.
HOST_PREFIXES, TRACKING = r"^www\d*\.", r"(?i)^(utm_[a-z]+|fbclid|gclid)(=|$)"


def canonical_url(url: Column, host_prefixes: str = HOST_PREFIXES, dropped_fields: str = TRACKING) -> Column:
    """A page's address without scheme, default port, fragment and trailing slash, its query fields sorted.

    ``host_prefixes`` and ``dropped_fields`` are patterns of what else goes; by default ``www.`` and
    tracking fields, which do not change a page. Mobile hosts and fields such as ``ref`` may, so they stay.
    Null stays null.
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), host_prefixes, "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    fields = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(dropped_fields))
    query = F.array_join(F.array_sort(fields), "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def parse_headers(block: Column) -> Column:
    """A map of lower-case names to values from a header block; the last of equal names counts."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[^:\s]+:"))
    pair = lambda x: F.struct(
        F.lower(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("value")
    )
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def merged_headers(stored_headers: Column, fresh: Column) -> Column:
    """The stored response's headers, updated by those that a not-modified response may change."""
    fresh = F.map_filter(F.coalesce(fresh, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(KEPT))
    old = F.coalesce(stored_headers, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)


def resolve(captures: DataFrame, host_prefixes: str = HOST_PREFIXES, dropped_fields: str = TRACKING) -> DataFrame:
    """Each revisit with the latest earlier full response of its page.

    ``captures`` has record_id, url, time, kind ("response" or "revisit"), status and
    headers (a map with lower-case names). Returns per revisit: record_id, refers_to,
    headers (merged) and outcome: "resolved" where both records have the same entity tag, or
    else the same last-modified date; "mismatch" where these differ; "unchecked" where they have no validator
    in common, so that nothing shows the response to be the one meant; "missing" without an earlier
    response. Headers are merged for resolved revisits only. Only responses of status 200 count; of those
    at one time the larger record_id is later, and one at the revisit's own time is not earlier. Records
    without a url, time or kind are left out, repeated revisits and those with null ids are answered each, null
    headers are none, and other columns are not used.

    The captures are sorted in ranges of page and time. Within a page's part of a range a window carries the
    latest response on; before it, the latest of the earlier ranges is taken from one row
    per page and range. So a page that holds most captures is spread over many tasks.
    """
    page = canonical_url(F.col("url"), host_prefixes, dropped_fields)
    rows = captures.select(page.alias("page"), "record_id", "time", "kind", "status", "headers")
    rows = stored(rows.dropna(subset=["page", "time", "kind"]), "captures")
    full = F.when((F.col("kind") == "response") & (F.col("status") == 200), F.struct("time", "record_id", "headers"))
    rows = rows.withColumn("full", full).withColumn("is_full", full.isNotNull())
    ranges = rows.repartitionByRange(rows.count() // SLICE_ROWS + 1, "page", "time", "is_full", "record_id")
    rows = stored(ranges.withColumn("slot", F.spark_partition_id()), "capture-ranges")
    latest = rows.filter("full is not null").groupBy("page", "slot").agg(F.max_by("full", F.struct("time", "record_id")).alias("end"))
    past = Window.partitionBy("page").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.select("page", "slot").distinct().join(latest, ["page", "slot"], "left")
    before = slots.select("page", "slot", F.last("end", ignorenulls=True).over(past).alias("before"))
    # responses of one time come after the revisits of that time, and in the order of their ids
    near = Window.partitionBy("page", "slot").orderBy("time", "is_full", "record_id")
    near = near.rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.withColumn("near", F.last("full", ignorenulls=True).over(near)).filter("kind = 'revisit'")
    met = carried.join(before, ["page", "slot"], "left").withColumn("found", F.coalesce("near", "before"))
    tag = lambda c: F.regexp_replace(F.col(c)["headers"]["etag"], "^W/", "")
    own_tag = F.regexp_replace(F.col("headers")["etag"], "^W/", "")
    day, own_day = F.col("found")["headers"]["last-modified"], F.col("headers")["last-modified"]
    same = F.coalesce(tag("found") == own_tag, day == own_day)
    outcome = F.when(F.col("found").isNull(), "missing").when(same.isNull(), "unchecked")
    outcome = outcome.when(same, "resolved").otherwise("mismatch")
    good = F.col("outcome") == "resolved"
    out = met.select("record_id", "found", "headers", outcome.alias("outcome"))
    return out.select(
        "record_id",
        F.when(F.col("outcome") != "missing", F.col("found.record_id")).alias("refers_to"),
        F.when(good, merged_headers(F.col("found.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        "outcome",
    )
