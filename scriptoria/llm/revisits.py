"""WARC revisits of kind not-modified: each is resolved to the latest earlier full response of its canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a 304 answer that describe its own message and never replace the stored ones (RFC 9111, 3.2; RFC 9110, 7.6.1 and 15.4.5).
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Time is cut into so many blocks, so that no task holds all records of a URL.
BLOCKS = 256


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, www., default port, tracking parameters, index page and closing slash; the host in lower case. Null stays null."""
    u = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    rest = F.regexp_replace(u, r"^[^/?]*", "")
    rest = F.regexp_replace(rest, r"([?&])(utm_[a-z]+|ref|gclid|fbclid)=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"&&+", "&"), r"\?&", "?"), r"[?&]+$", "")
    rest = F.regexp_replace(F.regexp_replace(rest, r"/index\.html?$", "/"), r"/+$", "")
    return F.concat(host, rest)


def _field(headers: str, name: str) -> Column:
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def resolve_revisits(records: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """One row for each revisit of ``records``: record_id, url, ts, status, response_id, digest, headers.

    ``records`` has record_id long, kind string ("response" or "revisit"), url string, ts long,
    digest string of the payload, headers array<struct<name: string, value: string>>; other columns are
    ignored. The response is that of the same canonical URL with the greatest ts below
    the revisit's, of equal ones that with the greatest record_id. status is
    "no_response" if there is none; "mismatch" if the revisit's ETag (compared weakly) or, without one, its Last-Modified
    is not the response's; else "resolved", with the response's digest and merged headers: the revisit's fields replace the
    response's of the same name and are added to them, save those in NOT_MERGED; names in lower case, in order.
    A revisit without validators is resolved. Null headers count as none. A null url or ts finds nothing and is
    "no_response"; responses with either are left out. Repeated revisits each give a row; an empty table none.

    Time is cut at quantiles of ts. The last response of each URL and block
    is aggregated and handed on over that URL's blocks, at most ``blocks`` rows; then each URL and
    block is a group of its own, however many records the URL has.
    """
    empty = F.array().cast("array<struct<name:string,value:string>>")
    rows = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url"), "ts", "digest", F.coalesce("headers", empty).alias("headers")).where("kind = 'revisit' or (url is not null and ts is not null)")
    cuts = rows.agg(F.percentile_approx("ts", [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0] or []
    bounds = F.array(*[F.lit(b).cast("long") for b in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    rows = rows.withColumn("block", F.size(F.filter(bounds, lambda b: b <= F.col("ts"))))
    response = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "digest", "headers"))
    seen = rows.where("url is not null and ts is not null").groupBy("url", "block").agg(F.max(response).alias("last"))
    earlier = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    handed = seen.select("url", "block", F.max("last").over(earlier).alias("response")).where("response is not null")
    handed = handed.select(F.lit(None).cast("long").alias("record_id"), F.lit("handed").alias("kind"), "url", F.col("response.ts").alias("ts"), F.lit(None).cast("string").alias("digest"), empty.alias("headers"), "block", "response")
    before = Window.partitionBy("url", "block").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    known = rows.where("url is not null and ts is not null").withColumn("response", response).unionByName(handed)
    found = known.withColumn("found", F.max("response").over(before)).where("kind = 'revisit'").drop("response")
    lost = rows.where("kind = 'revisit' and (url is null or ts is null)").withColumn("found", F.lit(None).cast(found.schema["found"].dataType))
    out = found.unionByName(lost).withColumn("stored", F.col("found.headers"))
    weak = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    etag, modified = _field("headers", "etag"), _field("headers", "last-modified")
    same = F.when(etag.isNotNull(), weak(etag).eqNullSafe(weak(_field("stored", "etag")))).when(modified.isNotNull(), modified.eqNullSafe(_field("stored", "last-modified"))).otherwise(True)
    status = F.when(F.col("found").isNull(), "no_response").when(same, "resolved").otherwise("mismatch")
    ok = F.col("status") == "resolved"
    lower = lambda c: F.transform(c, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    fresh = F.filter(lower("headers"), lambda h: ~h["name"].isin(*NOT_MERGED))
    old = F.filter(lower("stored"), lambda h: ~F.exists("fresh", lambda f: f["name"] == h["name"]))
    out = out.withColumn("status", status).withColumn("fresh", fresh)
    return out.select("record_id", "url", "ts", "status", F.when(ok, F.col("found.record_id")).alias("response_id"), F.when(ok, F.col("found.digest")).alias("digest"), F.when(ok, F.array_sort(F.concat("fresh", old))).alias("headers"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl of ``pages`` (page_id, url, html) with every page answered in full and asked for again later.

    A page is fetched at time 2 * page_id and asked for again at 2 * page_id + 101, at the URL without its
    query. The second answer is a revisit with the page's entity tag: weak if page_id divided
    by 4 leaves 1, another one if it leaves 2, none but a Last-Modified if it leaves 3.
    """
    h = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    p, left = F.col("page_id"), F.pmod(F.col("page_id"), F.lit(4))
    digest = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    length = F.length(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    full = F.array(h("ETag", tag), h("Last-Modified", F.concat(F.lit("day "), F.floor(p / 100))), h("Content-Type", F.lit("text/html")), h("Content-Length", length), h("Cache-Control", F.lit("max-age=60")))
    mark = F.when(left == 1, F.concat(F.lit("W/"), tag)).when(left == 2, F.lit('"other"')).otherwise(tag)
    again = F.concat(
        F.when(left == 3, F.array(h("last-modified", F.concat(F.lit("day "), F.floor(p / 100))))).otherwise(F.array(h("etag", mark))),
        F.array(h("Content-Length", F.lit(0)), h("Cache-Control", F.concat(F.lit("max-age="), left * 60)), h("Age", left)),
    )
    one = pages.select((p * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (p * 2).alias("ts"), digest.alias("digest"), full.alias("headers"))
    two = pages.select((p * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.regexp_replace("url", r"\?.*$", "").alias("url"), (p * 2 + 101).alias("ts"), F.lit(None).cast("string").alias("digest"), again.alias("headers"))
    return one.unionByName(two)


def op5_query(spark, sf_dir: str) -> DataFrame:
    out = resolve_revisits(crawl_records(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.withColumn("headers", F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n"))


OP5_SQL = r"""
WITH c AS (
  SELECT page_id, url, md5(coalesce(html, '')) digest, length(coalesce(html, '')) n, page_id % 4 k, page_id // 100 AS day FROM pages),
u AS (
  SELECT *, 0 again, url link FROM c UNION ALL SELECT *, 1, regexp_replace(url, '\?.*$', '') FROM c),
s AS (SELECT *, regexp_replace(regexp_replace(link, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') v FROM u),
t AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(v, '^[^/?]*', 0)), '^www\.', ''), ':(80|443)$', '') host,
  regexp_replace(regexp_replace(v, '^[^/?]*', ''), '([?&])(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '\1', 'g') rest FROM s),
r AS (SELECT *, host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''), '/index\.html?$', '/'), '/+$', '') canon FROM t),
full_ AS (SELECT canon, 2 * page_id ts, page_id, digest, n, day FROM r WHERE again = 0 AND canon IS NOT NULL AND page_id IS NOT NULL),
rev AS (SELECT canon, 2 * page_id + 101 ts, page_id, digest, k, day FROM r WHERE again = 1),
j AS (SELECT rev.*, f.page_id f_page, f.digest f_digest, f.n f_n, f.day f_day, row_number() OVER (PARTITION BY rev.page_id ORDER BY f.ts DESC) rn
  FROM rev LEFT JOIN full_ f ON f.canon = rev.canon AND f.ts < rev.ts),
x AS (SELECT *, CASE WHEN f_page IS NULL THEN 'no_response' WHEN k = 2 THEN 'mismatch' WHEN k = 3 THEN CASE WHEN day = f_day THEN 'resolved' ELSE 'mismatch' END WHEN digest = f_digest THEN 'resolved' ELSE 'mismatch' END status FROM j WHERE rn = 1)
SELECT 2 * page_id + 1 record_id, canon url, ts, status, CASE WHEN status = 'resolved' THEN 2 * f_page END response_id, CASE WHEN status = 'resolved' THEN f_digest END digest,
  CASE WHEN status = 'resolved' THEN 'age: ' || k || chr(10) || 'cache-control: max-age=' || k * 60 || chr(10) || 'content-length: ' || f_n || chr(10) || 'content-type: text/html' || chr(10)
    || 'etag: ' || CASE WHEN k = 1 THEN 'W/"' || digest || '"' ELSE '"' || f_digest || '"' END || chr(10) || 'last-modified: day ' || f_day END headers
FROM x
"""
