"""Resolution of not-modified revisits of WARC captures. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Query parameters that only track a visit.
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)="
# A 304 may not change these stored fields (RFC 9111, section 3.2).
KEPT_FIELDS = ["content-encoding", "content-length", "content-range", "content-type", "transfer-encoding"]


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., m. or a default port, path without a final slash, sorted parameters
    without tracking ones, no scheme and no fragment. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^(www[0-9]*|m)[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def lower_names(headers: Column) -> Column:
    """Headers with names in lower case; values of names that become equal are joined by ", ", in order of name and value."""
    entries = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v"))))
    names = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    joined = lambda k: F.array_join(F.transform(F.filter(entries, lambda e: (e["k"] == k) & e["v"].isNotNull()), lambda e: e["v"]), ", ")
    present = lambda k: F.exists(entries, lambda e: (e["k"] == k) & e["v"].isNotNull())
    return F.map_from_arrays(names, F.transform(names, lambda k: F.when(present(k), joined(k))))


def instant(c: Column, kind: str) -> Column:
    """A time as a whole number: microseconds of a timestamp, or the number itself."""
    return F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c.cast("long")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, replaced by those of the 304 that it may change."""
    allowed = F.map_filter(fresh, lambda k, v: ~k.isin(KEPT_FIELDS))
    rest = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(allowed), k))
    return F.map_concat(rest, allowed)


#: Rows of a time slice, about, and the fewest and most slices.
SLICE_ROWS, FEWEST_SLICES, MOST_SLICES = 2_000_000, 64, 4096


def resolve_revisits(records: DataFrame, slices: int | None = None) -> DataFrame:
    """Give every not-modified revisit the latest earlier full response of its canonical URL.

    ``records``: record_id long, warc_type ('response' or 'revisit'), url, captured_at timestamp or long,
    status int, headers map<string,string>, payload_digest; other columns stay. Added: canonical, outcome
    ('full', 'resolved', 'changed' where a validator differs, 'unchecked' where there is none to compare,
    'orphan' where nothing is earlier), refers_to, merged, merged_digest.

    The as-of join is a running last() in time order. Time is cut into ``slices`` of about equal row counts
    (as many as the rows ask for, if not given), so that a URL that holds a third of all rows is spread over as many groups; what a slice has to start
    from is then carried over at most ``slices`` rows a URL. "Earlier" is by (captured_at, record_id), so
    ties are settled by record_id and repeated rows see each other in no fixed way but with equal values.

    Nulls: a null url or captured_at is matched with nothing; null headers are empty; a null validator is
    absent. A weak ETag equals the strong one of the same text. An empty table gives an empty result.
    """
    empty = F.create_map().cast("map<string,string>")
    r = records.withColumns({"canonical": canonical_url(F.col("url")), "__h": lower_names(F.coalesce("headers", empty)), "__t": instant(F.col("captured_at"), records.schema["captured_at"].dataType.simpleString())})
    slices = slices or max(FEWEST_SLICES, min(MOST_SLICES, records.count() // SLICE_ROWS))
    etag = F.regexp_replace(F.element_at("__h", "etag"), "^W/", "")
    r = r.withColumns({"__etag": etag, "__mod": F.element_at("__h", "last-modified")})
    bounds = r.agg(F.percentile_approx("__t", [i / slices for i in range(1, slices)], 10000).alias("b")).first()["b"] or []
    r = r.withColumn("__slice", F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<long>"), lambda b: b < F.col("__t"))))
    usable = (F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("canonical").isNotNull() & F.col("__t").isNotNull()
    full = F.when(usable, F.struct(F.col("record_id").alias("id"), F.col("__h").alias("h"), F.col("__etag").alias("etag"), F.col("__mod").alias("mod"), F.col("payload_digest").alias("digest")))
    key = F.struct("__t", "record_id")

    ends = r.where(usable).groupBy("canonical", "__slice").agg(F.max(key).alias("__k"))
    w_slices = Window.partitionBy("canonical").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices_of = r.where("canonical IS NOT NULL").select("canonical", "__slice").distinct()
    carried = slices_of.join(ends, ["canonical", "__slice"], "left").withColumn("__c", F.last("__k", ignorenulls=True).over(w_slices))
    # the carried row is fetched once a URL and slice, by its key, and not once a revisit
    last_rows = r.where(usable).select(F.col("canonical").alias("__u"), key.alias("__lk"), full.alias("__carry")).dropDuplicates(["__u", "__lk"])
    carried = carried.where("__c IS NOT NULL").join(last_rows, (F.col("canonical") == F.col("__u")) & (F.col("__c") == F.col("__lk"))).select(F.col("canonical").alias("__cu"), F.col("__slice").alias("__cs"), "__carry")

    w = Window.partitionBy("canonical", "__slice").orderBy("__t", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    matched = r.where("canonical IS NOT NULL").withColumn("__near", F.last(full, ignorenulls=True).over(w))
    matched = matched.join(carried, (F.col("canonical") == F.col("__cu")) & (F.col("__slice") == F.col("__cs")), "left")
    none = F.lit(None)
    alone = r.where("canonical IS NULL").withColumn("__near", none.cast(matched.schema["__near"].dataType)).withColumn("__cu", none.cast("string")).withColumn("__cs", none.cast("int")).withColumn("__carry", none.cast(matched.schema["__carry"].dataType))
    m = matched.unionByName(alone).withColumn("__p", F.when((F.col("warc_type") == "revisit") & F.col("__t").isNotNull(), F.coalesce("__near", "__carry")))

    same = (
        F.when(F.col("__etag").isNotNull() & F.col("__p.etag").isNotNull(), F.col("__etag") == F.col("__p.etag"))
        .when(F.col("__mod").isNotNull() & F.col("__p.mod").isNotNull(), F.col("__mod") == F.col("__p.mod"))
        .when(F.col("payload_digest").isNotNull() & F.col("__p.digest").isNotNull(), F.col("payload_digest") == F.col("__p.digest"))
    )
    outcome = (
        F.when(~F.coalesce(F.col("warc_type") == "revisit", F.lit(False)), F.lit("full"))
        .when(F.col("__p").isNull(), F.lit("orphan"))
        .when(same.isNull(), F.lit("unchecked"))
        .when(same, F.lit("resolved"))
        .otherwise(F.lit("changed"))
    )
    m = m.withColumn("outcome", outcome)
    takes = F.col("outcome").isin("resolved", "unchecked")
    own = ["canonical", "outcome", "refers_to", "merged", "merged_digest"]
    return m.withColumns(
        {
            "refers_to": F.col("__p.id"),
            "merged": F.when(takes, merged_headers(F.col("__p.h"), F.col("__h"))).otherwise(F.col("__h")),
            "merged_digest": F.when(takes, F.col("__p.digest")).otherwise(F.col("payload_digest")),
        }
    ).select(*[c for c in records.columns if c not in own], *own)


def attach_payloads(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Join the bodies (record_id, payload) that resolved revisits refer to; full responses keep their own."""
    p = payloads.select(F.col("record_id").alias("__pid"), "payload").dropDuplicates(["__pid"])
    source = F.when(F.col("outcome").isin("resolved", "unchecked"), F.col("refers_to")).otherwise(F.col("record_id"))
    return resolved.drop("payload").join(p, source == F.col("__pid"), "left").drop("__pid")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl in which every page was fetched once and asked for again later.

    The second request is of one of six kinds, by a hash of the id: (0) another fragment and a weak ETag, (1)
    https with its port and a Last-Modified date, (2) a tracking parameter and an ETag that is out of date,
    (3) the payload digest as only validator, (4) no validator, (5) a front page that very many ask for; one
    in eight of the last kind also fetches that front page in full.
    """
    digest, key = F.md5(F.coalesce("html", F.lit(""))), F.md5(F.concat(F.lit("v:"), F.col("page_id").cast("string")))
    kind, one_in_8 = F.conv(F.substring(key, 1, 4), 16, 10).cast("int") % 6, F.conv(F.substring(key, 5, 4), 16, 10).cast("int") % 8 == 0
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    headers = lambda etag, cache: F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), length, F.lit("ETag"), etag, F.lit("Last-Modified"), F.concat(F.lit("lm-"), F.substring(digest, 9, 8)), F.lit("Cache-Control"), F.lit(cache))
    p = pages.select("page_id", "url", "html").withColumns({"__kind": kind, "__front": (kind == 5) & one_in_8, "__digest": digest})
    first = p.select((F.col("page_id") * 4).alias("record_id"), "page_id", F.lit("response").alias("warc_type"), "url", F.col("page_id").alias("captured_at"), F.lit(200).alias("status"), headers(F.substring("__digest", 1, 8), "max-age=60").alias("headers"), F.col("__digest").alias("payload_digest"))
    front = p.where("__front").select((F.col("page_id") * 4 + 2).alias("record_id"), "page_id", F.lit("response").alias("warc_type"), F.lit(FRONT).alias("url"), F.col("page_id").alias("captured_at"), F.lit(200).alias("status"), headers(F.lit("front"), "max-age=30").alias("headers"), F.col("__digest").alias("payload_digest"))
    k = F.col("__kind")
    url = (
        F.when(k == 0, F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")))
        .when(k == 1, F.regexp_replace("url", "^https?://([^/?#:]+)", "https://$1:443"))
        .when(k == 2, F.concat(F.regexp_replace("url", "#.*$", ""), F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("utm_source=again")))
        .when(k == 5, F.lit(FRONT))
        .otherwise(F.col("url"))
    )
    fixed = F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=90"))
    more = (
        F.when(k == 0, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), F.substring("__digest", 1, 8))))
        .when(k == 1, F.create_map(F.lit("last-modified"), F.concat(F.lit("lm-"), F.substring("__digest", 9, 8))))
        .when(k == 2, F.create_map(F.lit("ETag"), F.lit("stale")))
        .when(k == 5, F.create_map(F.lit("ETag"), F.lit("front")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    again = p.select((F.col("page_id") * 4 + 1).alias("record_id"), "page_id", F.lit("revisit").alias("warc_type"), url.alias("url"), (F.col("page_id") + 1000).alias("captured_at"), F.lit(304).alias("status"), F.map_concat(fixed, more).alias("headers"), F.when(k == 3, F.col("__digest")).alias("payload_digest"))
    return first.unionByName(front).unionByName(again)


#: A made-up address that a sixth of the revisits go to.
FRONT = "http://front.example.com/start"

REVISIT_SQL = r"""
WITH p AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest, CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) AS len,
    CAST(('0x' || substr(md5('v:' || CAST(page_id AS VARCHAR)), 1, 4)) AS BIGINT) % 6 AS kind, CAST(('0x' || substr(md5('v:' || CAST(page_id AS VARCHAR)), 5, 4)) AS BIGINT) % 8 = 0 AS eighth FROM pages),
rec AS (
  SELECT page_id * 4 AS record_id, page_id, 'response' AS warc_type, url, page_id AS t, len, 'text/html' AS type, substr(digest, 1, 8) AS etag, 'lm-' || substr(digest, 9, 8) AS lm, 'max-age=60' AS cache, digest FROM p
  UNION ALL
  SELECT page_id * 4 + 2, page_id, 'response', 'http://front.example.com/start', page_id, len, 'text/html', 'front', 'lm-' || substr(digest, 9, 8), 'max-age=30', digest FROM p WHERE kind = 5 AND eighth
  UNION ALL
  SELECT page_id * 4 + 1, page_id, 'revisit',
    CASE kind WHEN 0 THEN regexp_replace(url, '#.*$', '') || '#again' WHEN 1 THEN regexp_replace(url, '^https?://([^/?#:]+)', 'https://\1:443')
      WHEN 2 THEN regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=again' WHEN 5 THEN 'http://front.example.com/start' ELSE url END,
    page_id + 1000, '0', NULL, CASE kind WHEN 0 THEN 'W/' || substr(digest, 1, 8) WHEN 2 THEN 'stale' WHEN 5 THEN 'front' END, CASE WHEN kind = 1 THEN 'lm-' || substr(digest, 9, 8) END, 'max-age=90', CASE WHEN kind = 3 THEN digest END FROM p),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM rec),
parts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www[0-9]*|m)[.]', '') || regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS hp,
  list_sort(list_filter(string_split(regexp_extract(b, '[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|sid)='))) AS q FROM bare),
c AS (SELECT *, hp || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical, regexp_replace(etag, '^W/', '') AS tag FROM parts),
m AS (SELECT *, last_value(CASE WHEN warc_type = 'response' THEN {'id': record_id, 'tag': tag, 'etag': etag, 'lm': lm, 'len': len, 'digest': digest} END IGNORE NULLS) OVER (PARTITION BY canonical ORDER BY t, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p0 FROM c),
n AS (SELECT *, CASE WHEN warc_type = 'revisit' AND canonical IS NOT NULL THEN p0 END AS p FROM m),
o AS (SELECT *, CASE WHEN warc_type <> 'revisit' THEN 'full' WHEN p IS NULL THEN 'orphan'
    WHEN tag IS NOT NULL THEN CASE WHEN tag = p.tag THEN 'resolved' ELSE 'changed' END
    WHEN lm IS NOT NULL THEN CASE WHEN lm = p.lm THEN 'resolved' ELSE 'changed' END
    WHEN digest IS NOT NULL THEN CASE WHEN digest = p.digest THEN 'resolved' ELSE 'changed' END
    ELSE 'unchecked' END AS outcome FROM n)
SELECT record_id, page_id, canonical, outcome, p.id AS refers_to,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN concat_ws(';', 'cache-control=' || cache, 'content-length=' || p.len, 'content-type=text/html', 'etag=' || coalesce(etag, p.etag), 'last-modified=' || coalesce(lm, p.lm))
       ELSE concat_ws(';', 'cache-control=' || cache, 'content-length=' || len, 'content-type=' || type, 'etag=' || etag, 'last-modified=' || lm) END AS merged_headers,
  CASE WHEN outcome IN ('resolved', 'unchecked') THEN p.digest ELSE digest END AS merged_digest
FROM o
"""
