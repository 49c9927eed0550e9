"""WARC not-modified revisit resolution: an as-of join to the latest earlier full response.

Captures are rows (record_id, url, ts, kind, etag, last_modified, digest, headers); kind is `response` or `revisit`.
A revisit refers to the response of the same canonical URL that comes last before it in the order of ts, then
record_id. Its validators decide: an etag must be weakly equal, without one the last-modified date must be equal;
with neither the reference is unverified. The status is resolved, unverified, mismatch, or orphan (no earlier
response). Of a resolved or unverified revisit, the response's headers are updated by those headers of the revisit
that a 304 may carry; other headers of the revisit are dropped.

A popular URL may hold a third of all captures, and all of them may share one ts or have none, so no window ever takes a
whole URL. A URL of more captures than a slice is to hold is cut into slices of its whole order (ts, record_id, kind, hash,
row number), so only a slice's own captures meet, whatever they share. The limits come from captures of the URL that a hash
chooses, about SAMPLED a slice; each of a slice's captures stands in it. Inside (URL, slice) a window finds the last response so far;
the last response of each (URL, slice) is a maximum that combines before the shuffle, and a second window over a URL's
slices carries it on to the later ones. A slice holds an eighth of an even share of a task or more, so slices and limits
are at most eight a task and one a popular URL, however large the table is. The narrow rows are written once and
read by each of these steps; their row numbers are written with them, so the order is the same whenever a task runs again.
Bodies take no part: the result names the response.

A null or empty URL has no canonical form and its revisits are orphans. A null ts comes before all others, a null
record_id before others of its ts; captures alike in both are ordered by kind (responses first), then by a hash of
their validators, digest and headers. Repeated rows are kept. Rows of another kind, or none, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cupola.llm.common import count_upto, stored, table

#: A URL's slice is to hold at least this many captures, and an eighth of an even share of a task where that is more.
LEAST_SLICE = 2_000
#: Captures a slice, about, from which limits are taken.
SAMPLED = 16
#: Slice limits that are broadcast.
FEW = 1_000_000
#: Headers that a 304 response updates: fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't tell pages apart: a fixed pattern.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"


def canonical(url: Column) -> Column:
    """Host in small letters without default port, path or `/`, remaining query parameters in order; no scheme, no fragment. Null without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#.*$", ""))
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), ":(80|443)$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    made = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(host != "", made)


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def merged_headers(full: Column, revisit: Column, permitted: tuple[str, ...] = PERMITTED) -> Column:
    none = F.create_map().cast("map<string,string>")
    new = F.map_filter(F.coalesce(revisit, none), lambda k, v: F.lower(k).isin(*permitted))
    names = F.transform(F.map_keys(new), lambda k: F.lower(k))
    return F.map_concat(F.map_filter(F.coalesce(full, none), lambda k, v: ~F.array_contains(names, F.lower(k))), new)


#: The whole order of a URL's captures. Nulls come first, responses before revisits; the row number tells repeated rows apart.
ORDER = ("ts", "record_id", "kind", "mark", "row")


def _sliced(rows: DataFrame, slices: int | None) -> DataFrame:
    """rows (key, ORDER, ...) with the slice of their key that they fall in; keys of few captures have one. slices: of every key."""
    counts = stored(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n")), "urlcounts")
    total = counts.agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(LEAST_SLICE, (total.n or 0) // (8 * tasks))
    if slices == 1 or (slices is None and (total.most or 0) <= size):
        return rows.withColumn("slice", F.lit(0))
    wanted = F.lit(slices) if slices else F.ceil(F.col("n") / size).cast("int")
    hot = counts.where(F.col("n") > (1 if slices else size)).select("key", "n", wanted.alias("wanted"))
    few = total.n // size <= FEW
    place = F.struct(*ORDER)
    drawn = rows.select("key", *ORDER).join(F.broadcast(hot) if few and not slices else hot, "key")
    drawn = drawn.where(F.pmod(F.xxhash64("row", "record_id", "ts"), F.lit(1 << 30)) < F.lit(float(SAMPLED << 30)) * F.col("wanted") / F.col("n"))
    limits = drawn.groupBy("key", "wanted").agg(F.sort_array(F.collect_list(place)).alias("s"))
    picked = F.transform(F.sequence(F.lit(1), F.col("wanted") - 1), lambda i: F.get("s", F.floor(i * F.size("s") / F.col("wanted")).cast("int")))
    limits = limits.where("wanted > 1").select("key", F.ceil(F.sqrt("wanted")).cast("int").alias("block"), picked.alias("s"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / F.col("block")).cast("int")), lambda i: F.slice("s", i * F.col("block") + 1, F.col("block")))
    limits = stored(limits.select("key", "block", blocks.alias("limits")), "urlslices")
    met = rows.join(F.broadcast(limits) if few and not slices else limits, "key", "left")
    return met.withColumn("slice", F.when(F.col("limits").isNull(), 0).otherwise(count_upto(F.col("limits"), place, F.col("block")))).drop("limits", "block")


def resolve(captures: DataFrame, slices: int | None = None) -> DataFrame:
    """(record_id, canonical_url, status, refers_to, digest, headers) for every revisit row. slices: of every URL; None makes them from the counts."""
    rows = captures.where(F.col("kind").isin("response", "revisit")).select("record_id", canonical(F.col("url")).alias("key"), "ts", "kind", "etag", "last_modified", "digest", "headers")
    ordered = F.array_sort(F.map_entries("headers"))
    rows = stored(rows.withColumn("mark", F.xxhash64("etag", "last_modified", "digest", ordered)).withColumn("row", F.monotonically_increasing_id()), "captures")
    rows = _sliced(rows, slices)
    known = rows.where("key is not null")
    full = F.when(F.col("kind") == "response", F.struct("record_id", "etag", "last_modified", "digest", "headers"))
    inside = Window.partitionBy("key", "slice").orderBy(F.asc_nulls_first("ts"), F.asc_nulls_first("record_id"), F.asc("kind"), F.asc("mark"), F.asc("row"))
    near = known.withColumn("near", F.last(full, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))).where("kind = 'revisit'")
    place = F.struct(F.col("ts").isNotNull(), "ts", F.col("record_id").isNotNull(), "record_id", "mark", "row")
    lasts = known.groupBy("key", "slice").agg(F.max_by(full, F.when(F.col("kind") == "response", place)).alias("own"))
    across = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    far = lasts.withColumn("far", F.last("own", ignorenulls=True).over(across)).where("far is not null").select("key", "slice", "far")
    found = near.join(far, ["key", "slice"], "left").withColumn("full", F.coalesce("near", "far")).drop("near", "far", "slice")
    lost = rows.where("key is null and kind = 'revisit'").drop("slice").withColumn("full", F.lit(None).cast(found.schema["full"].dataType))
    both = found.unionByName(lost)
    fits = F.when(F.col("etag").isNotNull(), _weak(F.col("etag")).eqNullSafe(_weak(F.col("full.etag")))).when(F.col("last_modified").isNotNull(), F.col("last_modified").eqNullSafe(F.col("full.last_modified")))
    status = F.when(F.col("full").isNull(), "orphan").when(fits.isNull(), "unverified").when(fits, "resolved").otherwise("mismatch")
    good = F.col("status").isin("resolved", "unverified")
    return both.withColumn("status", status).select(
        "record_id", F.col("key").alias("canonical_url"), "status", F.when(good, F.col("full.record_id")).alias("refers_to"), F.when(good, F.col("full.digest")).alias("digest"),
        F.when(good, merged_headers(F.col("full.headers"), F.col("headers"))).alias("headers"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """Four captures of every page, a day apart, with the page's own URL in four spellings and validators that follow from its html.

    The first is a response, but for pages whose number is divisible by 7; the third is one with changed content for
    numbers divisible by 3; the others are revisits. Revisits of numbers divisible by 11 have no validator, those of
    other numbers divisible by 5 the date alone, and every second etag is weak.
    """
    p, k = F.col("page_id"), F.col("k")
    url = F.col("url")
    spelled = F.when(k == 1, F.regexp_replace(url, "^https?://", "HTTPS://")).when(k == 2, F.concat(url, F.lit("#part"))).when(k == 3, F.concat(F.regexp_replace(url, "#.*$", ""), F.when(url.contains("?"), "&").otherwise("?"), F.lit("utm_medium=x"))).otherwise(url)
    changed = (k == 2) & (p % 3 == 0)
    digest = F.md5(F.concat(F.col("html"), F.when(changed, "2").otherwise("")).cast("binary"))
    rows = pages.select("page_id", "url", "html", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    is_full = ((k == 0) & (p % 7 != 0)) | changed
    tag = F.concat(F.when(~is_full & (p % 2 == 0), "W/").otherwise(""), F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    ts = (k * 86400 + (p % 997) * 60).cast("long")
    rows = rows.select(
        (p * 4 + k).alias("record_id"), spelled.alias("url"), ts.alias("ts"), F.when(is_full, "response").otherwise("revisit").alias("kind"),
        F.when(is_full | ((p % 11 != 0) & (p % 5 != 0)), tag).alias("etag"),
        F.when(is_full | ((p % 11 != 0) & (p % 5 == 0)), F.concat(F.lit("day "), F.when(changed, 2).otherwise(0).cast("string"))).alias("last_modified"),
        F.when(is_full, digest).alias("digest"), "k",
    )
    sure = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    headers = F.when(F.col("kind") == "response", F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("date"), sure(F.col("ts")), F.lit("cache-control"), F.lit("max-age=60"), F.lit("etag"), sure(F.col("etag")))).otherwise(
        F.create_map(F.lit("Date"), sure(F.col("ts")), F.lit("Cache-Control"), F.concat(F.lit("max-age="), k.cast("string")), F.lit("Content-Length"), F.lit("0"), F.lit("Vary"), F.lit("accept"))
    )
    return rows.withColumn("headers", headers).drop("k")


def op4_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures_of(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(F.lower(e["key"]), F.lit(": "), e["value"])))
    return found.withColumns({"headers": F.array_join(lines, "; "), "refers_to": F.col("refers_to").cast("string")})


OP4_SQL = r"""
WITH c AS (
  SELECT page_id AS p, k, url, html, (k = 2 AND page_id % 3 = 0) AS changed, (k = 0 AND page_id % 7 <> 0) OR (k = 2 AND page_id % 3 = 0) AS is_full
  FROM pages, (SELECT unnest(range(4)) AS k)),
r AS (
  SELECT p * 4 + k AS record_id, k * 86400 + (p % 997) * 60 AS ts, k, is_full,
    CASE k WHEN 1 THEN regexp_replace(url, '^https?://', 'HTTPS://') WHEN 2 THEN url || '#part'
           WHEN 3 THEN regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_medium=x' ELSE url END AS u,
    md5(html || CASE WHEN changed THEN '2' ELSE '' END) AS digest, p,
    CASE WHEN is_full OR (p % 11 <> 0 AND p % 5 = 0) THEN CASE WHEN changed THEN 'day 2' ELSE 'day 0' END END AS lm
  FROM c),
s AS (
  SELECT *, CASE WHEN is_full OR (p % 11 <> 0 AND p % 5 <> 0) THEN '"' || substr(digest, 1, 16) || '"' END AS strong,
    CASE WHEN contains(u, '://') THEN regexp_replace(substr(u, strpos(u, '://') + 3), '#.*$', '') END AS rest FROM r),
h AS (
  SELECT *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), ':(80|443)$', '') AS host, regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))) AS kept FROM s),
x AS (
  SELECT record_id, ts, k, is_full, strong, lm, digest,
    CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS key FROM h),
m AS (
  SELECT v.record_id, v.key, v.ts, v.k, v.strong, v.lm, f.record_id AS fid, f.strong AS fs, f.lm AS fl, f.digest AS fd,
    row_number() OVER (PARTITION BY v.record_id ORDER BY f.ts DESC, f.record_id DESC) AS n
  FROM x v LEFT JOIN x f ON f.is_full AND f.key = v.key AND (f.ts < v.ts OR (f.ts = v.ts AND f.record_id < v.record_id))
  WHERE NOT v.is_full),
j AS (
  SELECT *, CASE WHEN fid IS NULL THEN 'orphan' WHEN strong IS NOT NULL THEN CASE WHEN strong = fs THEN 'resolved' ELSE 'mismatch' END
    WHEN lm IS NOT NULL THEN CASE WHEN lm = fl THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS status FROM m WHERE n = 1)
SELECT record_id, key AS canonical_url, status, CAST(CASE WHEN status IN ('resolved', 'unverified') THEN fid END AS VARCHAR) AS refers_to,
  CASE WHEN status IN ('resolved', 'unverified') THEN fd END AS digest,
  CASE WHEN status IN ('resolved', 'unverified') THEN 'cache-control: max-age=' || k || '; content-type: text/html; date: ' || ts || '; etag: ' || fs || '; vary: accept' END AS headers
FROM j
"""
