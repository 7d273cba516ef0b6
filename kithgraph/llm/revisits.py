"""WARC revisit resolution: what a "not modified" record stands for.

Records are a table: record_id, url, ts, kind (response, revisit), status, headers (map, names in
lower case), digest and length of the payload. A revisit refers to the latest earlier full response
(kind response, status 200) of the same canonical URL, by ts and then record_id. Its validators are
checked: entity tag (weak comparison), else last-modified, else payload digest. A resolved record has
the response's payload and the response's headers, updated by those headers of the revisit that a
304 may change.

The as-of join works in time buckets: a window sees one URL in one bucket, and the last full response
of each URL and bucket is carried to later buckets in a window over at most BUCKETS rows a URL, so a hot
URL spreads over many tasks. Payloads are not moved.

state: full (a response), resolved, unchecked (no validator on the revisit), mismatch, missing (nothing earlier).

Defined cases: a null url or ts never finds a response and is never found; null headers are empty;
repeated records are kept, and one of several equal responses is referred to; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.llm.common import table

BUCKETS = 1024
#: Headers that describe the payload or the connection; a 304 never changes them.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)


def canonical(url: Column) -> Column:
    """Without scheme, www, the scheme's default port (without scheme: either), fragment and, where no query follows, the path's closing slash; host in lower case; query kept as it is."""
    whole = F.regexp_replace(F.trim(url), "#.*$", "")
    plain = F.regexp_replace(whole, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    scheme = F.lower(F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, "^[^/?]*", 0)), "^www[.]", "")
    port = F.regexp_extract(host, ":([0-9]+)$", 1)
    default = (port == "80") & scheme.isin("http", "") | (port == "443") & scheme.isin("https", "")
    host = F.when(default, F.regexp_replace(host, ":[0-9]+$", "")).otherwise(host)
    return F.concat(host, F.regexp_replace(F.regexp_extract(plain, "[/?].*$", 0), "^([^?]*)/$", "$1"))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(headers["etag"], "^W/", "")


def resolve(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """record_id, ts, kind, key (canonical URL), state, refers_to, headers, digest, length of every record."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    rows = records.select("record_id", "ts", "kind", "status", canonical(F.col("url")).alias("key"), F.coalesce("headers", none).alias("headers"), "digest", F.col("length").cast("long").alias("length"))
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    width = max(1, ((high or 0) - (low or 0)) // buckets + 1)
    rows = rows.withColumn("_bucket", F.floor((F.col("ts") - F.lit(low or 0)) / F.lit(width)))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("key").isNotNull() & F.col("ts").isNotNull()
    me = F.when(full, F.struct("ts", "record_id", "headers", "digest", "length"))
    rows = rows.withColumn("_me", me)
    newest = F.max_by("_me", F.when(F.col("_me").isNotNull(), F.struct("ts", "record_id")))
    last = rows.groupBy("key", "_bucket").agg(newest.alias("_me")).where(F.col("_me").isNotNull())
    asked = rows.where(F.col("kind") == "revisit").select("key", "_bucket").distinct()
    steps = last.unionByName(asked.withColumn("_me", F.lit(None)), allowMissingColumns=True).groupBy("key", "_bucket").agg(F.first("_me", ignorenulls=True).alias("_me"))
    before = W.partitionBy("key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = steps.withColumn("_carried", F.last("_me", ignorenulls=True).over(before)).where(F.col("_carried").isNotNull()).select(F.col("key").alias("_k"), F.col("_bucket").alias("_b"), "_carried")
    inside = W.partitionBy("key", "_bucket").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_near", F.last("_me", ignorenulls=True).over(inside))
    rows = rows.join(carried, (F.col("key") == F.col("_k")) & (F.col("_bucket") == F.col("_b")), "left")
    revisit = F.col("kind") == "revisit"
    found = F.when(revisit & F.col("key").isNotNull() & F.col("ts").isNotNull(), F.coalesce("_near", "_carried"))
    rows = rows.withColumn("_found", found)
    own, other = F.col("headers"), F.col("_found.headers")
    same = (
        F.when(own["etag"].isNotNull(), F.coalesce(_tag(own) == _tag(other), F.lit(False)))
        .when(own["last-modified"].isNotNull(), F.coalesce(own["last-modified"] == other["last-modified"], F.lit(False)))
        .when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == F.col("_found.digest"), F.lit(False)))
    )
    state = F.when(~F.coalesce(revisit, F.lit(False)), "full").when(F.col("_found").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    rows = rows.withColumn("state", state)
    bound = F.col("state").isin("resolved", "unchecked")
    updates = F.map_filter(own, lambda name, _: ~name.isin(*KEPT_HEADERS))
    merged = F.map_concat(F.map_filter(other, lambda name, _: ~F.map_contains_key(updates, name)), updates)
    return rows.select(
        "record_id",
        "ts",
        "kind",
        "key",
        "state",
        F.when(F.col("state") != "missing", F.col("_found.record_id")).alias("refers_to"),
        F.when(bound, merged).otherwise(own).alias("headers"),
        F.when(bound, F.col("_found.digest")).otherwise(F.col("digest")).alias("digest"),
        F.when(bound, F.col("_found.length")).otherwise(F.col("length")).alias("length"),
    )


def header_lines(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def captures(pages: DataFrame) -> DataFrame:
    """Records from the table of pages: each page answered in full at time page_id, and every third page asked for again 1000 later.

    The answer to that is "not modified", by the page's entity tag (each fifteenth page: by a tag that was never sent).
    """
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", digest.alias("md5"), size.alias("size"))
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    quoted = text('"', F.col("md5"), '"')
    sent = F.create_map(F.lit("etag"), quoted, F.lit("date"), text("t", F.col("page_id")), F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), text(F.col("size")), F.lit("cache-control"), F.lit("max-age=60"))
    tag = F.when(F.col("page_id") % 15 == 1, F.lit('"stale"')).otherwise(text("W/", quoted))
    again = F.create_map(F.lit("etag"), tag, F.lit("date"), text("t", F.col("page_id") + 1000), F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=90"), F.lit("x-cache"), F.lit("hit"))
    full = rows.select(F.col("page_id").alias("record_id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), sent.alias("headers"), F.col("md5").alias("digest"), F.col("size").alias("length"))
    revisits = rows.where(F.col("page_id") % 3 == 1).select((-1 - F.col("page_id")).alias("record_id"), "url", (F.col("page_id") + 1000).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), again.alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("length"))
    return full.unionByName(revisits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(table(spark, sf_dir, "pages")))
    return found.select("record_id", "ts", "kind", "key", "state", "refers_to", header_lines(F.col("headers")).alias("headers"), "digest", "length")


ORACLE = r"""
WITH pages_ AS (
  SELECT page_id, md5(coalesce(html, '')) AS md5, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS plain,
    lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme
  FROM pages
), hosts AS (
  SELECT *, regexp_replace(lower(regexp_extract(plain, '^[^/?]*')), '^www[.]', '') AS host FROM pages_
), keyed AS (
  SELECT page_id, md5, size,
    CASE WHEN (host LIKE '%:80' AND scheme IN ('http', '')) OR (host LIKE '%:443' AND scheme IN ('https', '')) THEN regexp_replace(host, ':[0-9]+$', '') ELSE host END
      || regexp_replace(regexp_extract(plain, '[/?].*$'), '^([^?]*)/$', '\1') AS key
  FROM hosts
), records AS (
  SELECT page_id AS record_id, page_id AS ts, 'response' AS kind, key, '"' || md5 || '"' AS tag, md5 AS digest, size AS length FROM keyed
  UNION ALL
  SELECT -1 - page_id, page_id + 1000, 'revisit', key, CASE WHEN page_id % 15 = 1 THEN '"stale"' ELSE '"' || md5 || '"' END, NULL, 0 FROM keyed WHERE page_id % 3 = 1
), found AS (
  SELECT *, CASE WHEN kind = 'revisit' THEN last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'digest': digest, 'length': length} END IGNORE NULLS)
    OVER (PARTITION BY key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS f
  FROM records
), stated AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN f IS NULL THEN 'missing' WHEN tag = '"' || f.digest || '"' THEN 'resolved' ELSE 'mismatch' END AS state FROM found
)
SELECT record_id, ts, kind, key, state, f.id AS refers_to,
  CASE state
    WHEN 'full' THEN concat('cache-control: max-age=60', chr(10), 'content-length: ', length, chr(10), 'content-type: text/html', chr(10), 'date: t', ts, chr(10), 'etag: ', tag)
    WHEN 'resolved' THEN concat('cache-control: max-age=90', chr(10), 'content-length: ', f.length, chr(10), 'content-type: text/html', chr(10), 'date: t', ts, chr(10), 'etag: W/', tag, chr(10), 'x-cache: hit')
    ELSE concat('cache-control: max-age=90', chr(10), 'content-length: 0', chr(10), 'date: t', ts, chr(10), 'etag: ', CASE WHEN tag = '"stale"' THEN '' ELSE 'W/' END, tag, chr(10), 'x-cache: hit') END AS headers,
  CASE WHEN state = 'resolved' THEN f.digest ELSE digest END AS digest,
  CASE WHEN state = 'resolved' THEN f.length ELSE length END AS length
FROM stated
"""
