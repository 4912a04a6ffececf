"""Resolution of "not modified" revisits in web archives.

A revisit record says that a page had not changed since an earlier capture and carries no body. It
is resolved by an as-of join: the latest full response of the same canonical URL captured before it.
The validators must agree, and the header lines that a 304 may update are merged into the stored
ones. A URL's captures are split by day: each day's last response is carried to the following days
in a small table, so that a URL with a third of all captures is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Header lines that a 304 response does not change in a stored one.
KEPT = (
    "connection content-encoding content-length content-md5 content-range content-type keep-alive proxy-authenticate "
    "proxy-authorization proxy-connection te trailer trailers transfer-encoding upgrade"
).split()
# Query parameters that name no other page.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|phpsessid|jsessionid|sessionid)(=|$)"


def canonical_url(url: str) -> Column:
    """A URL without scheme, user, www, default port, fragment, tracking parameters and their order."""
    bare = F.regexp_replace(F.trim(F.col(url)), "#.*$", "")
    head = "^[A-Za-z][A-Za-z0-9+.-]*://"
    host = F.lower(F.regexp_extract(bare, head + "([^/?]*)", 1))
    for pattern in ("^.*@", "^www[0-9]*[.]", ":(80|443)$"):
        host = F.regexp_replace(host, pattern, "")
    rest = F.regexp_replace(bare, head + "[^/?]*", "")
    path = F.regexp_replace(rest, "[?].*$", "")
    query = F.regexp_extract(rest, "[?](.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    sign = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    return F.concat(host, F.when(path == "", "/").otherwise(path), sign)


def weak(tag: Column) -> Column:
    """An entity tag as the weak comparison sees it."""
    return F.regexp_replace(tag, "^W/", "")


def agreement(revisit: Column, stored: Column) -> Column:
    """'mismatch' if any validator both have differs, 'resolved' if one agrees, else 'unverified'."""
    tags = weak(revisit["headers"]["etag"]), weak(stored["headers"]["etag"])
    dates = revisit["headers"]["last-modified"], stored["headers"]["last-modified"]
    digests = revisit["payload_digest"], stored["payload_digest"]
    pairs = (tags, dates, digests)
    differs, agrees = F.lit(False), F.lit(False)
    for a, b in pairs:
        differs = differs | F.coalesce(a != b, F.lit(False))
        agrees = agrees | F.coalesce(a == b, F.lit(False))
    return F.when(differs, "mismatch").when(agrees, "resolved").otherwise("unverified")


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored header lines with those of a 304 that it may change."""
    may = F.map_filter(F.coalesce(update, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(KEPT) & v.isNotNull())
    keep = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(may), k))
    return F.map_concat(keep, may)


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Every capture with what it stands for.

    ``captures``: record_id (long), kind (response or revisit), url, captured_at (timestamp), headers
    (map with lower-case names), payload_digest. Returns record_id, kind, canonical_url, captured_at,
    resolution, from_record_id, headers, payload_digest. ``resolution`` is ``full`` for responses; for
    revisits ``resolved``, ``unverified`` (no validator in common), ``mismatch`` or ``missing`` (no
    earlier response). Only the first two get the stored response's headers, merged, and its digest.

    Earlier means strictly before; of responses at one time the greatest record_id is the latest.
    Null URLs and times match nothing. Every row gives a row; an empty table none. Bodies stay where
    they are: join them by from_record_id.
    """
    names = ["record_id", "kind", "url", "captured_at", "headers", "payload_digest"]
    day = F.coalesce(F.date_trunc("day", "captured_at"), F.lit("1970-01-01").cast("timestamp"))
    rows = (
        captures.select(*names)
        .withColumn("canonical_url", canonical_url("url"))
        .withColumn("day", day)
        .withColumn("full", F.when(F.col("kind") == "response", F.struct("captured_at", "record_id", "headers", "payload_digest")))
    )
    known = F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull()
    apart = rows.where(~known).withColumn("stored", F.lit(None).cast(rows.schema["full"].dataType))
    rows = rows.where(known)
    latest = rows.where("full IS NOT NULL").groupBy("canonical_url", "day").agg(F.max_by("full", F.struct("captured_at", "record_id")).alias("last"))
    # A row per URL and day with captures: the last response of the days before.
    days = rows.select("canonical_url", "day").distinct().join(latest, ["canonical_url", "day"], "left")
    over = Window.partitionBy("canonical_url").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select("canonical_url", "day", F.last("last", ignorenulls=True).over(over).alias("carried"))
    # A revisit stands before a response of the same time, so it never sees it.
    order = Window.partitionBy("canonical_url", "day").orderBy("captured_at", F.col("full").isNotNull(), "record_id")
    within = F.last("full", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = rows.withColumn("within", within).join(carried, ["canonical_url", "day"], "left")
    seen = seen.withColumn("stored", F.coalesce("within", "carried")).select(*apart.columns)
    both = seen.unionByName(apart)
    me = F.struct("headers", "payload_digest")
    resolution = (
        F.when(F.col("kind") == "response", "full").when(F.col("stored").isNull(), "missing").otherwise(agreement(me, F.col("stored")))
    )
    both = both.withColumn("resolution", resolution)
    got = F.col("resolution").isin("resolved", "unverified")
    return both.select(
        "record_id",
        "kind",
        "canonical_url",
        "captured_at",
        "resolution",
        F.when(got, F.col("stored.record_id")).alias("from_record_id"),
        F.when(got, merged_headers(F.col("stored.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
        F.when(got, F.col("stored.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )
