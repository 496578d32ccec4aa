"""Not-modified revisit resolution.

A web archive stores a page once; a later fetch that answers "not modified"
becomes a revisit record without a body.  Each revisit is resolved by an as-of
join: the latest earlier full response of the same canonical URL.  Its
validators must agree, and the headers that a not-modified answer may update
are merged over the stored ones.

The join is a running "last full response" along each URL's time line.  A hot
URL is no single task: time lines are cut into blocks of ``block_seconds``;
within a block a window runs over its records, across blocks only over one
summary row each, and the two meet again by (URL, block).

Statuses: ``resolved``; ``no_origin`` (no earlier full response);
``mismatch`` (an entity tag, a time of change or a payload digest differs);
``unverified`` (neither side has a validator in common, so the match rests on
the URL alone).  Entity tags compare weakly.

Defined results: order is time, then record_id; a null URL or time has no
origin and is none; null headers count as none; repeated rows are returned as often as
they come; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Stored headers that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not select content.
TRACKING = r"utm_[a-z]+|ref|fbclid|gclid|sessionid"


def canonical_url(url: Column) -> Column:
    """Lower-case host without "www.", no scheme, default port, fragment,
    tracking parameters or final slash."""
    bare = F.regexp_replace(F.trim(url), r"#.*\z", "")
    rest = F.regexp_replace(bare, r"\A(?i:https?)://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"\A([^/?]*)", 1)), r"\Awww\.|:(80|443)\z", "")
    path = F.regexp_extract(rest, r"\A[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)\z", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"\A(?:{TRACKING})(?:=|\z)")))
    return F.concat(host, F.regexp_replace(path, r"/+\z", ""),
                    F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _opaque(tag: Column) -> Column:
    return F.regexp_replace(tag, r"\AW/", "")


def resolve(captures: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """Every revisit of ``captures`` with what it resolves to.

    ``captures``: record_id, url, ts (seconds), kind ("response" or
    "revisit"), headers (map, lower-case names), digest, length."""
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    slim = captures.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"),
                           "kind", headers.alias("headers"), "digest", "length")
    slim = slim.withColumn("block", F.floor(F.col("ts") / block_seconds))
    full = F.when((F.col("kind") == "response") & F.col("url_key").isNotNull() & F.col("ts").isNotNull(),
                  F.struct("record_id", "ts", "headers", "digest", "length"))
    slim = materialise(slim.withColumn("full", full), "captures")
    within = Window.partitionBy("url_key", "block").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("s_key").orderBy("s_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (slim.where("url_key is not null and ts is not null")
              .groupBy(F.col("url_key").alias("s_key"), F.col("block").alias("s_block"))
              .agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("ts", "record_id"))).alias("latest"))
              .withColumn("carried", F.last("latest", ignorenulls=True).over(across)).drop("latest"))
    seen = (slim.withColumn("near", F.last("full", ignorenulls=True).over(within))
            .where("kind = 'revisit'")
            .join(blocks, (F.col("url_key") == F.col("s_key")) & (F.col("block") == F.col("s_block")), "left")
            .withColumn("origin", F.when(F.col("url_key").isNotNull() & F.col("ts").isNotNull(), F.coalesce("near", "carried"))))

    def both(name: str) -> tuple[Column, Column]:
        return F.col("headers")[name], F.col("origin.headers")[name]
    (tag, tag_0), (changed, changed_0) = both("etag"), both("last-modified")
    checks = [(_opaque(tag), _opaque(tag_0)), (changed, changed_0), (F.col("digest"), F.col("origin.digest"))]
    differs, common = F.lit(False), F.lit(False)
    for mine, stored in checks:
        differs = differs | F.coalesce(mine != stored, F.lit(False))
        common = common | (mine.isNotNull() & stored.isNotNull())
    status = (F.when(F.col("origin").isNull(), "no_origin").when(differs, "mismatch")
              .when(common, "resolved").otherwise("unverified"))
    update = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(F.col("origin.headers"), lambda k, _: ~F.array_contains(F.map_keys("update"), k))
    usable = F.col("status").isin("resolved", "unverified")
    return (seen.withColumn("status", status).withColumn("update", update)
            .select("record_id", "url_key", "ts", "status", F.col("origin.record_id").alias("origin_id"),
                    F.when(usable, F.map_concat(kept, "update")).alias("merged_headers"),
                    F.when(usable, F.col("origin.digest")).alias("payload_digest"),
                    F.when(usable, F.col("origin.length")).alias("payload_length")))


def _hash(salt: str, modulus: int) -> Column:
    digest = F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % modulus


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl log of ``pages``: each page is fetched up to four times, under
    changing spellings of its URL, at times spread over a day.  A fetch is a
    full response or a revisit; some revisits carry an outdated entity tag,
    some a time of change only, some no validator."""
    base = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"),
                        F.length(F.coalesce("html", F.lit(""))).cast("long").alias("length"),
                        _hash("n", 4).alias("more"), _hash("k", 6).alias("kinds"), _hash("t", 3600).alias("at"))
    log = base.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("more").cast("int")))).withColumns({
        "record_id": F.col("page_id") * 8 + F.col("nth"), "ts": F.col("at") + F.col("nth") * 5400,
        "mode": F.when((F.col("nth") == 0) & (F.col("kinds") != 1), 0).otherwise((F.col("kinds") + F.col("nth")) % 6)})
    changed = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    stale = F.when(F.col("mode") == 3, F.lit("old")).otherwise(F.col("digest"))
    etag = F.when(F.col("mode") != 4, F.concat(F.when(F.col("mode") == 2, "W/").otherwise(""), F.lit('"'), F.substring(stale, 1, 8), F.lit('"')))
    # Modes 0 and 5 are full responses.
    kind = F.when(F.col("mode").isin(0, 5), "response").otherwise("revisit")
    headers = F.map_filter(F.create_map(
        F.lit("content-type"), F.when(kind == "response", "text/html").otherwise("text/plain"),
        F.lit("etag"), etag, F.lit("last-modified"), F.when(F.col("mode").isin(0, 4, 5), changed),
        F.lit("date"), F.concat(F.lit("t"), F.col("ts").cast("string"))), lambda _, v: v.isNotNull())
    spelled = (F.when(F.col("nth") == 1, F.concat(F.col("url"), F.lit("#again")))
               .when(F.col("nth") == 2, F.regexp_replace("url", r"\Ahttps?://", "HTTPS://www.")).otherwise(F.col("url")))
    body = kind == "response"
    return log.select("record_id", spelled.alias("url"), "ts", kind.alias("kind"), headers.alias("headers"),
                      F.when(body, F.col("digest")).alias("digest"), F.when(body, F.col("length")).alias("length"))


def op5_revisit_asof(spark, sf_dir):
    """Every revisit of the crawl log of ``pages``, resolved."""
    found = resolve(captures_of(table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])))
    return found.withColumn("merged_headers", F.array_join(entries, "; "))


OP5_SQL = r"""
WITH base AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, CAST(length(coalesce(html, '')) AS BIGINT) AS length,
         CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '') || 'n'), 1, 8) AS BIGINT) % 4 AS more,
         CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '') || 'k'), 1, 8) AS BIGINT) % 6 AS kinds,
         CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '') || 't'), 1, 8) AS BIGINT) % 3600 AS begins
  FROM pages),
log AS (
  SELECT *, page_id * 8 + nth AS record_id, begins + nth * 5400 AS ts, CASE WHEN nth = 0 AND kinds <> 1 THEN 0 ELSE (kinds + nth) % 6 END AS mode
  FROM (SELECT *, unnest(range(0, more + 1)) AS nth FROM base)),
cap AS (
  SELECT record_id, ts, CASE WHEN mode IN (0, 5) THEN 'response' ELSE 'revisit' END AS kind,
         CASE nth WHEN 1 THEN url || '#again' WHEN 2 THEN regexp_replace(url, '^https?://', 'HTTPS://www.') ELSE url END AS url,
         CASE WHEN mode <> 4 THEN '"' || substr(CASE WHEN mode = 3 THEN 'old' ELSE digest END, 1, 8) || '"' END AS tag,
         CASE WHEN mode = 2 THEN 'W/' ELSE '' END AS weak,
         CASE WHEN mode IN (0, 4, 5) THEN 'day ' || CAST(page_id % 28 AS VARCHAR) END AS changed,
         CASE WHEN mode IN (0, 5) THEN digest END AS digest, CASE WHEN mode IN (0, 5) THEN length END AS length
  FROM log),
parts AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?)://', '') AS rest FROM cap),
keyed AS (
  SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
             lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(?:=|$)'))) AS kept
  FROM parts),
k AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g')
            || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '')
            || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key
  FROM keyed),
j AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'tag': tag, 'changed': changed, 'digest': digest, 'length': length} END IGNORE NULLS)
            OVER (PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o
  FROM k),
r AS (
  SELECT *, CASE WHEN o IS NULL THEN 'no_origin'
                 WHEN coalesce(tag <> o.tag, false) OR coalesce(changed <> o.changed, false) OR coalesce(digest <> o.digest, false) THEN 'mismatch'
                 WHEN (tag IS NOT NULL AND o.tag IS NOT NULL) OR (changed IS NOT NULL AND o.changed IS NOT NULL) THEN 'resolved'
                 ELSE 'unverified' END AS status
  FROM j WHERE kind = 'revisit')
SELECT record_id, url_key, ts, status, o.id AS origin_id,
       CASE WHEN status IN ('resolved', 'unverified') THEN
         'content-type: text/html; date: t' || CAST(ts AS VARCHAR)
         || '; etag: ' || coalesce(weak || tag, o.tag) || '; last-modified: ' || coalesce(changed, o.changed) END AS merged_headers,
       CASE WHEN status IN ('resolved', 'unverified') THEN o.digest END AS payload_digest,
       CASE WHEN status IN ('resolved', 'unverified') THEN o.length END AS payload_length
FROM r
"""
