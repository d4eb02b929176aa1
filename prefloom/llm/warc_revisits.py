"""Not-modified revisits resolved by an as-of join on the canonical URL to the latest earlier full response.

The as-of join is a window over (URL, slice of time) and a second one over the few slices of each URL:
the latest response of a slice is carried into the later ones. A URL with a large share of all captures
is thus spread over the slices instead of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256
# Header fields that a not-modified answer may update; fixed values after the HTTP caching rules.
PERMITTED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary")
# Query parameters that do not choose a document.
TRACKING = r"utm_[a-z]+|ref|fbclid|gclid|sessionid|sid"


def canonical_url(url: Column) -> Column:
    """Scheme, "www." and "m.", fragment, tracking parameters and a closing slash or ".html" do not count."""
    low = F.lower(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    low = F.regexp_replace(F.regexp_replace(low, r"#.*$", ""), r"^(www|m)\.", "")
    low = F.regexp_replace(low, rf"([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+", "$1")
    return F.regexp_replace(F.regexp_replace(low, r"[?&]+$", ""), r"(?:/|\.html)$", "")


def merged_headers(full: Column, revisit: Column) -> Column:
    """The response's fields, with those of PERMITTED_HEADERS taken from the revisit where it has them."""
    full = F.coalesce(full, F.create_map().cast("map<string,string>"))
    revisit = F.coalesce(revisit, F.create_map().cast("map<string,string>"))
    update = F.map_filter(revisit, lambda k, v: F.lower(k).isin(*PERMITTED_HEADERS) & v.isNotNull())
    names = F.transform(F.map_keys(update), F.lower)
    rest = F.map_filter(full, lambda k, _: ~F.array_contains(names, F.lower(k)))
    return F.map_concat(rest, update)


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row per revisit of ``captures`` (record_id, url, captured_at long, kind, etag, last_modified,
    digest, headers map<string,string>; other columns are ignored).

    kind is "response" or "revisit". A revisit refers to the latest response of its canonical URL with a
    smaller captured_at (of equally late ones, the greatest record_id). status: "resolved" if all
    validators that both sides state agree and they have one at least (etag without the weak mark,
    last_modified, digest); "mismatch" if one differs; "no_validator"; "no_response" where nothing earlier
    exists, which includes a NULL URL or time. Repeated rows give repeated answers.
    """
    rows = captures.select(
        "record_id",
        canonical_url(F.col("url")).alias("key"),
        "captured_at",
        "kind",
        F.regexp_replace("etag", "^W/", "").alias("etag"),
        "last_modified",
        "digest",
        "headers",
    )
    usable = rows.where(F.col("key").isNotNull() & F.col("captured_at").isNotNull())
    bounds = usable.agg(F.min("captured_at").alias("low"), F.max("captured_at").alias("high"))
    low, high = bounds.first() or (None, None)
    width = max(1, ((high or 0) - (low or 0) + SLICES) // SLICES)
    usable = usable.withColumn("slice", F.floor((F.col("captured_at") - F.lit(low or 0)) / width).cast("int"))
    full = F.when(
        F.col("kind") == "response",
        F.struct("captured_at", "record_id", "etag", "last_modified", "digest", "headers"),
    )
    # Strictly earlier: a range frame ends one time unit before the row.
    earlier = Window.partitionBy("key", "slice").orderBy("captured_at").rangeBetween(Window.unboundedPreceding, -1)
    order = F.struct("captured_at", "record_id")
    inside = usable.withColumn("full", F.max_by(full, F.when(F.col("kind") == "response", order)).over(earlier))
    last = usable.where(F.col("kind") == "response").groupBy("key", "slice").agg(F.max_by(full, order).alias("last"))
    slices = usable.where(F.col("kind") == "revisit").select("key", "slice").distinct()
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.join(last, ["key", "slice"], "full").withColumn("carried", F.last("last", True).over(before))
    carried = carried.select("key", "slice", "carried")
    revisits = inside.where(F.col("kind") == "revisit").join(carried, ["key", "slice"], "left")
    revisits = revisits.withColumn("full", F.coalesce("full", "carried")).drop("carried", "slice")
    lost = rows.where((F.col("kind") == "revisit") & (F.col("key").isNull() | F.col("captured_at").isNull()))
    kind = revisits.schema["full"].dataType
    both = revisits.unionByName(lost.withColumn("full", F.lit(None).cast(kind)))
    agree = [F.col(c) == F.col(f"full.{c}") for c in ("etag", "last_modified", "digest")]
    stated = F.coalesce(*agree).isNotNull()
    differ = F.coalesce(agree[0] == False, F.lit(False))  # noqa: E712
    for a in agree[1:]:
        differ = differ | F.coalesce(a == False, F.lit(False))  # noqa: E712
    status = (
        F.when(F.col("full").isNull(), "no_response")
        .when(~stated, "no_validator")
        .when(differ, "mismatch")
        .otherwise("resolved")
    )
    found = both.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    return found.select(
        "record_id",
        F.col("key").alias("canonical_url"),
        "captured_at",
        "status",
        F.col("full.record_id").alias("response_id"),
        F.col("full.captured_at").alias("response_at"),
        F.when(resolved, F.col("full.digest")).alias("payload_digest"),
        F.when(resolved, merged_headers(F.col("full.headers"), F.col("headers"))).alias("headers"),
    )
