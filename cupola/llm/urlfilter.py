"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

A rule is (host, path, verdict). It fits a URL whose host is the rule's or a subdomain of it and whose path begins
with the rule's; of all rules that fit, the longest host and path together win, then the longer host, then a block.
A URL is expanded into expressions `host suffix + NUL + path prefix`, with only those suffixes (numbers of labels)
and prefixes (lengths in code points) that some rule has: the shapes of the rules, a bounded set that comes from
the rule table and drops no case. Expressions and rules meet in an equi-join on the first four bytes of their
SHA-256; the full digest then confirms.

A popular host makes the same expression for every page, so expressions are made distinct, which combines before
the shuffle, and joined to the rules once each; the confirmed ones then meet the pages in a join that adaptive
execution splits. If the rules are counted to be few, each shape's rules are broadcast instead; the join's key is
the short prefix alone there too, and the digest confirms after it.

A null URL or one without `://` has an empty host and path and gets the default verdict. Repeated page rows are
kept, null ids too. Rules with a null host or path fit nothing; of equal rules, one counts, a block first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cupola.llm.common import stored, table

#: Confirmed rules that are sent to every task; beyond that the join is shuffled.
FEW = 200_000
FEW_SHAPES = 32
#: Rules of the registered query: fixed values.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path).cast("binary"), 256)


def _short(digest: Column) -> Column:
    """The first four bytes of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """urls with host, path, rule and verdict (columns of these names in the input give way; others keep theirs, whatever they are called)."""
    rules = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict")).alias("v")).select("host", "path", "v.verdict")
    rules = rules.select(
        F.size(F.split("host", "[.]")).alias("labels"), F.length("path").alias("chars"), _digest(F.col("host"), F.col("path")).alias("full"),
        F.struct(F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("b")).alias("rank"), F.concat("host", "path").alias("rule"), "verdict").alias("found"),
    )
    # rules that share a short prefix stand in one row, so a join on it never multiplies pages
    ranked = rules.groupBy("labels", "chars", _short(F.col("full")).alias("short")).agg(F.collect_list(F.struct("full", "found")).alias("alike"))
    ranked = stored(ranked, "rules")  # written once: each shape reads it
    shapes = [(r.labels, r.chars) for r in ranked.select("labels", "chars").distinct().orderBy("labels", "chars").collect()]
    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    url = F.col(url_col)
    # the input's columns travel inside one, so no name of theirs can clash
    pages = urls.select(F.struct(*keep).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"))
    if not shapes:
        return pages.select(*[F.col("page").getField(c).alias(c) for c in keep], "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", "[.]")
    made = []
    for n, chars in shapes:
        fits = (F.size(labels) >= n) & (F.length("path") >= chars)
        made.append(F.when(fits, _digest(F.substring_index("host", ".", -n), F.substring("path", 1, chars))))
    # what a short prefix found is a rule only if the full digest is the same
    confirm = lambda alike, digest: F.get(F.filter(alike, lambda x: x["full"] == digest), F.lit(0))["found"]
    if len(shapes) <= FEW_SHAPES and rules.count() <= FEW:
        # few rules: one broadcast equi-join a shape, and no row of a page moves
        pages = pages.withColumn("digests", F.array(*made))
        for k, (n, chars) in enumerate(shapes):
            own = ranked.where((F.col("labels") == n) & (F.col("chars") == chars)).select(F.col("short").alias(f"short{k}"), F.col("alike").alias(f"alike{k}"))
            pages = pages.join(F.broadcast(own), _short(F.get("digests", F.lit(k))) == F.col(f"short{k}"), "left")
        judged = pages.withColumn("best", F.array_max(F.array(*[confirm(F.col(f"alike{k}"), F.get("digests", F.lit(k))) for k in range(len(shapes))])))
    else:
        pages = pages.withColumn("number", F.monotonically_increasing_id()).withColumn("digests", F.filter(F.array(*made), lambda x: x.isNotNull()))
        pages = stored(pages, "urls")  # row numbers must hold if a task is run again
        seen = pages.select(F.explode("digests").alias("digest")).distinct().withColumn("short", _short(F.col("digest")))
        confirmed = seen.join(ranked.select("short", "alike"), "short").select("digest", confirm(F.col("alike"), F.col("digest")).alias("found")).where("found is not null")
        best = pages.select("number", F.explode("digests").alias("digest")).join(confirmed, "digest").groupBy("number").agg(F.max("found").alias("best"))
        judged = pages.join(best, "number", "left")
    return judged.select(*[F.col("page").getField(c).alias(c) for c in keep], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


_SQL_RULES = " UNION ALL ".join(f"SELECT '{h}' AS rh, '{p}' AS rp, '{v}' AS v" for h, p, v in RULES)
OP6_SQL = rf"""
WITH rules AS ({_SQL_RULES}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest, row_number() OVER () AS n FROM pages),
parts AS (
  SELECT n, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
best AS (
  SELECT n, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(v, length(rh) + length(rp)) AS verdict
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM parts LEFT JOIN best USING (n)
"""
