"""Not-modified revisits of a web archive, resolved to the response they stand for.

A revisit record (status 304) has no payload. It is joined as of its time to the latest earlier
full response (status 200) of the same canonical URL, and resolved if a validator that both
carry agrees: the entity tag (weak comparison), or else the last modification date. The stored
headers are then updated by the revisit's, except for fields that describe the connection or
the payload.

The as-of join never gathers a URL's captures: captures of one URL and microsecond are one point
(pre-aggregated), points are swept in buckets of ``width`` seconds, and each bucket starts with the
last response of the buckets before. A URL with a third of all records is so many buckets. Points
move alone; the headers of the response found are joined last. Records move without their payloads.

Defined results: only responses with status 200 are full; "earlier" is strictly earlier, by the
microsecond; of responses at one time the one with the largest record id counts; a null URL, time
or record kind takes no part as a response, and such a revisit is ``no_earlier_response``; where
no validator is shared the revisit is ``unverifiable``, where it differs ``validator_mismatch``;
header names are compared in lower case, the last of two equal names counts; repeated revisits
are each resolved; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.llm.common import checkpoint
from spanloom.llm.url_rules import UPPER

BUCKET = 86_400

# Header fields of a 304 that don't update the stored response.
NOT_UPDATED = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer",
    "transfer-encoding", "upgrade", "content-encoding", "content-length", "content-range", "content-type",
)


def canonical_url(url: Column) -> Column:
    """No scheme, fragment, default port or tracking parameter; lower host; sorted query; a path."""
    rest = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.translate(F.regexp_extract(rest, "^[^/?]*", 0), UPPER, UPPER.lower()), ":(80|443)$", "")
    path = F.regexp_extract(rest, "^[^/?]*([^?]*)", 1)
    asked = F.regexp_extract(rest, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("utm_"))))
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Header entries by lower-case name; the last value of a name counts."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(
        names, F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), -1)["value"])
    )


def _agree(revisit: Column, stored: Column) -> Column:
    """true, false, or null where no validator is shared."""
    strong = lambda h: F.regexp_replace(F.try_element_at(h, F.lit("etag")), "^W/", "")
    dated = lambda h: F.try_element_at(h, F.lit("last-modified"))
    return F.coalesce(strong(revisit) == strong(stored), dated(revisit) == dated(stored))


def merged_headers(stored: Column, revisit: Column) -> Column:
    permitted = F.map_filter(revisit, lambda k, v: ~k.isin(*NOT_UPDATED))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k)), permitted)


def resolve_revisits(records: DataFrame, width: int = BUCKET) -> DataFrame:
    """record_id, url_key, seconds, outcome, target_id, target_seconds, payload_digest, headers.

    ``records``: record_id, kind (response or revisit), url, captured (timestamp), status,
    headers (map), payload_digest. ``seconds`` are those of the time, cut to whole ones.
    """
    clean = records.select(
        "record_id", "kind", "status", canonical_url(F.col("url")).alias("url_key"), F.unix_timestamp("captured").alias("seconds"),
        F.unix_micros("captured").alias("at"), _lowered(F.col("headers")).alias("headers"), "payload_digest",
    )
    full = (F.col("kind") == "response") & (F.col("status") == 200)
    timed = clean.where("url_key is not null and at is not null")
    responses = timed.where(full).groupBy("url_key", "at").agg(
        F.max_by(F.struct("record_id", "seconds", "payload_digest", "headers"), F.col("record_id")).alias("found")
    )
    revisits = clean.where("kind = 'revisit'")
    # one point for each URL and time that a response or revisit has; headers stay behind until the end
    points = (
        timed.where(full | (F.col("kind") == "revisit")).groupBy("url_key", "at").agg(F.max(full).alias("full"))
        .withColumn("stored", F.when(F.col("full"), F.col("at"))).withColumn("bucket", F.floor(F.col("at") / (width * 1_000_000)))
    )
    points = checkpoint(points.select("url_key", "at", "stored", "bucket"))
    inside = Window.partitionBy("url_key", "bucket").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    swept = points.withColumn("before", F.last("stored", ignorenulls=True).over(inside))
    across = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        points.groupBy("url_key", "bucket").agg(F.max("stored").alias("end"))
        .withColumn("carried", F.last("end", ignorenulls=True).over(across)).drop("end")
    )
    asof = swept.join(carried, ["url_key", "bucket"]).select("url_key", "at", F.coalesce("before", "carried").alias("found_at"))
    met = revisits.join(asof.where("found_at is not null"), ["url_key", "at"], "left")
    joined = met.join(responses.withColumnRenamed("at", "found_at"), ["url_key", "found_at"], "left")
    agree = _agree(F.col("headers"), F.col("found.headers"))
    outcome = (
        F.when(F.col("found").isNull(), "no_earlier_response")
        .when(agree.isNull(), "unverifiable")
        .when(agree, "resolved")
        .otherwise("validator_mismatch")
    )
    judged = joined.withColumn("outcome", outcome)
    only = lambda c: F.when(F.col("outcome") == "resolved", c)
    return judged.select(
        "record_id", "url_key", "seconds", "outcome",
        only(F.col("found.record_id")).alias("target_id"), only(F.col("found.seconds")).alias("target_seconds"),
        only(F.col("found.payload_digest")).alias("payload_digest"),
        only(merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
    )


def header_text(headers: Column) -> Column:
    """Headers as sorted lines."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
