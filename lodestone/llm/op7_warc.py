"""Not-modified revisits of web archives: an as-of join by canonical URL to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import table

#: Headers of a not-modified answer that update the stored ones (fixed values); the others describe the stored body.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "server", "vary", "via", "warning")
#: Query parameters that don't change the resource (fixed values).
TRACKING = ("fbclid", "gclid", "jsessionid", "phpsessid", "ref", "sessionid", "sid")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a last slash, parameters sorted and without
    tracking ones; no scheme and no fragment. A null URL stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i)https?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), r"^www[0-9]*\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def opaque(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def merge_headers(stored: Column, newer: Column) -> Column:
    """The stored headers with the permitted ones of the not-modified answer put over them."""
    update = F.map_filter(newer, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)


def resolve_revisits(records: DataFrame, spans: int = 256) -> DataFrame:
    """One row for each revisit (status 304) of ``records(record_id, url, ts, status, etag, last_modified, headers)``.

    It is joined to the full response (status 200) of the same canonical URL with the greatest ``ts`` before its own, of
    those the greatest ``record_id``. ``outcome`` is ``resolved``, ``etag_mismatch`` or ``modified_mismatch`` (the
    revisit's entity tag decides, or else its modification date), ``unvalidated`` (it has neither; taken as resolved), or
    ``no_response``. Headers are merged only where it is resolved or unvalidated. ``headers`` maps names in lower case.

    Time is cut into ``spans`` equal parts. A URL's records meet in one task only within a part; what a part ends with
    is carried to later parts through one row each, so a URL with a third of all records is spread over the parts.
    A null URL or ``ts`` resolves to nothing; null headers count as none; repeated rows stay; empty tables are valid.
    """
    empty = F.create_map().cast("map<string,string>")
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical"), "ts", "status", "etag", "last_modified", F.coalesce("headers", empty).alias("headers"))
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // spans))
    rows = rows.withColumn("part", F.floor((F.col("ts") - F.lit(low or 0)) / F.lit(width)))

    full = F.when(F.col("status") == 200, F.struct("ts", "record_id", "etag", "last_modified", F.map_entries("headers").alias("headers")))
    tagged = rows.where("canonical is not null and ts is not null and status in (200, 304)").withColumn("full", full)
    earlier = Window.partitionBy("canonical", "part").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    inside = tagged.withColumn("near", F.max("full").over(earlier)).where("status = 304").drop("full")

    ends = tagged.where("status = 200").groupBy("canonical", "part").agg(F.max("full").alias("last"))
    parts = ends.select("canonical", "part", "last").unionByName(inside.select("canonical", "part").distinct().withColumn("last", F.lit(None)), allowMissingColumns=True)
    parts = parts.groupBy("canonical", "part").agg(F.max("last").alias("last"))
    before = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("far", F.max("last").over(before)).select("canonical", "part", "far")
    joined = inside.join(carried, ["canonical", "part"], "left").withColumn("response", F.coalesce("near", "far"))
    lost = rows.where("status = 304 and (canonical is null or ts is null)").withColumn("response", F.lit(None))
    joined = joined.select("record_id", "canonical", "ts", "etag", "last_modified", "headers", "response")
    joined = joined.unionByName(lost.select("record_id", "canonical", "ts", "etag", "last_modified", "headers", F.lit(None).cast(joined.schema["response"].dataType).alias("response")))

    r = F.col("response")
    outcome = (
        F.when(r.isNull(), "no_response")
        .when(F.col("etag").isNotNull(), F.when(opaque(F.col("etag")).eqNullSafe(opaque(r["etag"])), "resolved").otherwise("etag_mismatch"))
        .when(F.col("last_modified").isNotNull(), F.when(F.col("last_modified").eqNullSafe(r["last_modified"]), "resolved").otherwise("modified_mismatch"))
        .otherwise("unvalidated")
    )
    merged = F.when(outcome.isin("resolved", "unvalidated"), merge_headers(F.map_from_entries(r["headers"]), F.col("headers")))
    return joined.select("record_id", "canonical", "ts", r["record_id"].alias("response_id"), r["ts"].alias("response_ts"), outcome.alias("outcome"), merged.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Capture records that follow from crawled pages: each page's full response, a revisit half a step later under
    another spelling of its URL, and one just before it."""
    tag = F.substring(F.md5("html"), 1, 12)
    date = F.concat(F.lit("day "), F.floor(F.col("page_id") / 7).cast("string"))
    at = F.col("page_id") * 600
    quoted = F.concat(F.when(F.col("page_id") % 5 == 0, "W/").otherwise(""), F.lit('"'), tag, F.lit('"'))
    plain = F.concat(F.lit('"'), tag, F.lit('"'))
    record = lambda k, url, ts, status, etag, modified, headers: F.struct(
        (F.col("page_id") * 4 + k).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(status).alias("status"), etag.alias("etag"),
        modified.alias("last_modified"), F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in headers]).alias("headers"),
    )
    size = F.length("html").cast("string")
    null = F.lit(None).cast("string")
    first = record(0, F.col("url"), at, 200, quoted, date, ["content-type", "text/html", "content-length", size, "etag", quoted, "date", at.cast("string"), "cache-control", "max-age=60"])
    other_url = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("#again"))).otherwise(F.col("url"))
    later_tag = F.when(F.col("page_id") % 11 == 0, '"stale"').when(F.col("page_id") % 7 != 0, plain)
    later_date = F.when(F.col("page_id") % 14 == 0, date).when(F.col("page_id") % 21 == 0, "day -1")
    later = record(1, other_url, at + 300, 304, later_tag, later_date, ["content-type", "text/plain", "date", (at + 300).cast("string"), "server", "edge"])
    before = record(2, F.col("url"), at - 60, 304, plain, null, ["date", (at - 60).cast("string"), "expires", "0"])
    return pages.select(F.explode(F.array(first, later, before)).alias("r")).select("r.*")


def header_lines(headers: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat_ws(": ", e["key"], e["value"]))), "\n")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", header_lines(F.col("headers")))


_TRACKING = ", ".join(f"'{x}'" for x in TRACKING)
SQL = rf"""
WITH p AS (
  SELECT page_id, url, page_id * 600 AS t0, substr(md5(html), 1, 12) AS tag, 'day ' || CAST(page_id // 7 AS VARCHAR) AS dd, length(html) AS size FROM pages),
q AS (SELECT *, CASE WHEN page_id % 5 = 0 THEN 'W/' ELSE '' END || '"' || tag || '"' AS quoted FROM p),
records AS (
  SELECT page_id * 4 AS record_id, url, t0 AS ts, 200 AS status, quoted AS etag, dd AS last_modified FROM q
  UNION ALL SELECT page_id * 4 + 1, CASE WHEN page_id % 3 = 0 THEN url || '#again' ELSE url END, t0 + 300, 304,
    CASE WHEN page_id % 11 = 0 THEN '"stale"' WHEN page_id % 7 <> 0 THEN '"' || tag || '"' END,
    CASE WHEN page_id % 14 = 0 THEN dd WHEN page_id % 21 = 0 THEN 'day -1' END FROM q
  UNION ALL SELECT page_id * 4 + 2, url, t0 - 60, 304, '"' || tag || '"', NULL FROM q),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)https?://', '') AS b FROM records),
c AS (
  SELECT *, regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^www[0-9]*\.|:(80|443)$', '', 'g') AS host,
    regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_')
      AND lower(split_part(x, '=', 1)) NOT IN ({_TRACKING}))) AS params FROM bare),
d AS (SELECT *, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM c),
j AS (
  SELECT v.record_id, v.canonical, v.ts, v.etag, v.last_modified, f.record_id AS response_id, f.ts AS response_ts, f.etag AS fetag, f.last_modified AS fmod,
    row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC, f.record_id DESC) AS rn
  FROM d v LEFT JOIN d f ON f.status = 200 AND f.canonical = v.canonical AND f.ts < v.ts WHERE v.status = 304),
o AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no_response'
    WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(fetag, '^W/', '') THEN 'resolved' ELSE 'etag_mismatch' END
    WHEN last_modified IS NOT NULL THEN CASE WHEN last_modified = fmod THEN 'resolved' ELSE 'modified_mismatch' END
    ELSE 'unvalidated' END AS outcome FROM j WHERE rn = 1)
SELECT record_id, canonical, ts, response_id, response_ts, outcome,
  CASE WHEN outcome IN ('resolved', 'unvalidated') THEN
    'cache-control: max-age=60' || chr(10) || 'content-length: ' || CAST(size AS VARCHAR) || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || CAST(o.ts AS VARCHAR) || chr(10) || 'etag: ' || quoted
    || CASE WHEN record_id % 4 = 1 THEN chr(10) || 'server: edge' ELSE chr(10) || 'expires: 0' END END AS headers
FROM o LEFT JOIN q ON q.page_id * 4 = o.response_id
"""

QUERIES = {"op7_warc": op7_warc}
ORACLE = {"op7_warc": SQL}
