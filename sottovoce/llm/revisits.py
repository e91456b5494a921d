"""Resolution of not-modified revisits in web captures, in built-in column functions.

A revisit record says that a page was the same as before. It is resolved to the latest full response of the same
canonical URL that was captured earlier; the validators it carries (entity tag, else last-modified time) have to
agree with that response. The headers that a not-modified answer may send replace the response's, all others stay.

The as-of join sorts records by range of (URL, time), so one hot URL spreads over many blocks. Within a block a
window carries the latest response forward; what earlier blocks pass on is one row for each URL and block.

Edge cases: a null URL is never resolved; a revisit without an earlier response is ``no_response``; validators
that disagree give ``changed``; a revisit without validators is trusted and ``resolved``; of records at one time
those with the lower id come first; repeated rows are each resolved; null header maps count as empty; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, table

#: Headers that a not-modified answer may replace (in lower case), and query keys that only track.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.`` or ``m.``, default port, tracking keys, fragment, ``.html`` and a closing slash; the host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"(\.html)?/*$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda q: (q != "") & ~q.rlike(f"^({TRACKING})(=|$)"))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))


RESPONSE = "struct<id:bigint,ts:bigint,etag:string,modified:string,headers:map<string,string>,digest:string>"


def resolve(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """(id, url, ts, status, response_id, digest, headers) for each revisit.

    ``records``: (id long, url, ts long, kind 'response' or 'revisit', etag, modified, headers map, digest).
    """
    n = partitions or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["id", "ts", "kind", "etag", "modified", "headers", "digest"]
    keyed = records.select(canonical_url(F.col("url")).alias("url"), *columns)
    blocks = scratch(keyed.repartitionByRange(n, "url", "ts").withColumn("block", F.spark_partition_id()), "capture-blocks")
    full = F.when(F.col("kind") == "response", F.struct("id", "ts", "etag", "modified", "headers", "digest")).cast(RESPONSE)
    # What each block passes on: its last response of each URL; then the last one of all blocks before.
    latest = F.max_by(F.struct("id", "ts", "etag", "modified", "headers", "digest").cast(RESPONSE), F.struct("ts", "id"))
    ends = blocks.filter("kind = 'response' and url is not null").groupBy("url", "block").agg(latest.alias("passed"))
    starts = blocks.filter("url is not null").select("url", "block").distinct().join(ends, ["url", "block"], "left")
    carried = F.last("passed", ignorenulls=True).over(Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carry = starts.select("url", "block", carried.alias("carried"))
    order = Window.partitionBy("url", "block").orderBy("ts", F.col("kind").desc(), "id").rowsBetween(Window.unboundedPreceding, -1)
    # Of a revisit and a response at one time, the revisit comes first: the response has to be earlier.
    within = blocks.withColumn("here", F.last(full, ignorenulls=True).over(order))
    joined = within.filter("kind = 'revisit'").join(carry, ["url", "block"], "left").withColumn("r", F.when(F.col("url").isNotNull(), F.coalesce("here", "carried")))
    tag, when = F.col("etag").isNotNull(), F.col("modified").isNotNull()
    agrees = F.when(tag, F.col("etag").eqNullSafe(F.col("r.etag"))).when(when, F.col("modified").eqNullSafe(F.col("r.modified"))).otherwise(True)
    status = F.when(F.col("r").isNull(), "no_response").when(agrees, "resolved").otherwise("changed")
    joined = joined.withColumn("status", status)
    empty = F.create_map().cast("map<string,string>")
    new = F.map_filter(F.coalesce("headers", empty), lambda k, v: F.lower(k).isin(*PERMITTED))
    old = F.map_filter(F.coalesce("r.headers", empty), lambda k, v: ~F.array_contains(F.transform(F.map_keys(new), F.lower), F.lower(k)))
    ok = F.col("status") == "resolved"
    return joined.select("id", "url", "ts", "status", F.when(ok, F.col("r.id")).alias("response_id"), F.when(ok, F.col("r.digest")).alias("digest"), F.when(ok, F.map_concat(old, new)).alias("headers"))


def capture_log(pages: DataFrame) -> DataFrame:
    """A capture log derived from ``pages``: a full response of each page and three revisits at times set by rule.

    Every fifth revisit has another entity tag, and some come before the response.
    """
    p = F.col("page_id")
    digest = F.md5(F.coalesce("html", F.lit("")))
    kinds = F.explode(F.sequence(F.lit(0), F.lit(3)))
    each = pages.select(p, "url", digest.alias("digest"), kinds.alias("k"))
    k, first = F.col("k"), (p * 7919) % 1000000 + 100000
    ts = F.when(k == 0, first).otherwise(first + k * (3600 + p % 97) - F.when((p + k) % 7 == 0, 90000).otherwise(0))
    etag = F.when((k > 0) & ((p + k) % 5 == 0), "stale").when((k > 0) & ((p + k) % 3 == 0), None).otherwise(F.substring("digest", 1, 16))
    headers = F.create_map(F.lit("Date"), ts.cast("string"), F.lit("Content-Type"), F.when(k == 0, "text/html").otherwise("x/ignored"))
    return each.select((p * 4 + k).alias("id"), "url", ts.cast("long").alias("ts"), F.when(k == 0, "response").otherwise("revisit").alias("kind"), etag.alias("etag"), F.lit(None).cast("string").alias("modified"), headers.alias("headers"), "digest")


def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(capture_log(table(spark, sf_dir, "pages")))
    header = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("id", "url", "ts", "status", "response_id", "digest", header.alias("headers"))


SQL = r"""with k as (select page_id as p, url, md5(coalesce(html, '')) as digest, unnest([0, 1, 2, 3]) as k from pages),
b as (select p * 4 + k as id, regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://|#.*$', '', 'g') as bare, (p * 7919) % 1000000 + 100000 + case when k = 0 then 0 else k * (3600 + p % 97) - case when (p + k) % 7 = 0 then 90000 else 0 end end as ts, k,
  case when k > 0 and (p + k) % 5 = 0 then 'stale' when k > 0 and (p + k) % 3 = 0 then null else substr(digest, 1, 16) end as etag, digest from k),
c as (select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '(\.html)?/*$', '') ||
  case when len(q) > 0 then '?' || array_to_string(list_sort(q), '&') else '' end as u from (select *, list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '' and not regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')) as q from b)),
j as (select v.id, v.u, v.ts, v.etag, r.id as rid, r.etag as retag, r.digest as rdigest, row_number() over (partition by v.id order by r.ts desc, r.id desc) as rn from c v left join c r on v.u = r.u and r.k = 0 and r.ts < v.ts where v.k > 0)
select id, u as url, ts, case when rid is null then 'no_response' when etag is null or etag = retag then 'resolved' else 'changed' end as status,
  case when rid is not null and (etag is null or etag = retag) then rid end as response_id, case when rid is not null and (etag is null or etag = retag) then rdigest end as digest,
  case when rid is not null and (etag is null or etag = retag) then 'Content-Type=text/html;Date=' || ts end as headers from j where rn = 1"""
QUERIES = {"op2_revisits": op2_revisits}
ORACLE = {"op2_revisits": SQL}
