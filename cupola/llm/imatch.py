"""I-Match fingerprints in DataFrame expressions only.

The lexicon holds the terms whose inverse document frequency over all distinct texts lies in a band: ln(N / df) from
ln(1 / MOST) to ln(1 / LEAST), and df of 2 or more. A text counts once: a row doesn't if another of the same text has a
smaller id, so a group of copies can't take its terms out of the lexicon. A document keeps its distinct terms that are in the lexicon,
sorts them, and hashes the list; it does so for the whole lexicon and for randomised subsets of it. A term's
SHA-256 gives DRAWS numbers, and draw d's subset of rate 1/r has the terms whose d-th number is divisible by r.
Subsets that see a few of a document's terms survive large edits, the whole lexicon tells documents apart. The
fingerprint is the row of these hashes, six hexadecimal digits each, `------` where a subset holds no term. A text none of
whose terms is in the lexicon has the hash of all its sorted terms in the first place, so that it looks like its copies and like
nothing else.

The likeness of two fingerprints is the share of equal hashes among the subsets that hold terms of either; if no
subset does, it is 1 for equal fingerprints.

A term that at least LEAST of all documents hold is one of at most (mean distinct terms) / LEAST, whatever the
corpus' size, so the lexicon is broadcast after a check of its count, and joined by a shuffle beyond it.
Documents are dealt to key ranges by id; the window that finds the next document, the grouping of its terms and
the comparison with the next fingerprint all run inside a range, so texts move once.

Null texts count as empty: no terms, all hashes empty. Repeated rows are kept; they follow each other by text. A
null id comes last in the descending order. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cupola.llm.common import bound, range_bucket, stored, table

#: Shares of all documents between which a term's document frequency must lie.
LEAST, MOST = 0.0005, 0.1
DRAWS = 20
RATES = (64, 256, 1024)
SUBSETS = 1 + DRAWS * len(RATES)
WIDTH = 6
NONE = "-" * WIDTH
#: Rows whose terms a task gathers in memory before it sorts instead (on disk if need be).
GATHERED = 1 << 14
#: Key ranges a task: ranges are dealt by hash, so a few a task even out what tasks get.
RANGES = 6
#: Terms of a lexicon that is broadcast.
FEW = 2_000_000
SEPARATOR = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct terms: runs of letters and digits, lower case."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), SEPARATOR, -1), ""))


def _subsets() -> Column:
    """The numbers of the random subsets that hold a term, from 1 on."""
    digest, found = F.sha2(F.col("term").cast("binary"), 256), []
    for d in range(DRAWS):
        number = F.conv(F.substring(digest, 1 + 3 * d, 3), 16, 10).cast("int")
        found += [F.when(number % r == 0, 1 + d * len(RATES) + i) for i, r in enumerate(RATES)]
    return F.filter(F.array(*found), lambda k: k.isNotNull())


def counting(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose text also stands in a row of smaller id.

    Only hashes and ids move. Texts that several rows have are sent to every task, counted before; beyond FEW of them
    rows meet them by a shuffle.
    """
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    copied = stored(docs.groupBy(digest.alias("_hash")).agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "copied")
    few = copied.count() <= FEW
    marked = docs.withColumn("_own", digest)
    met = marked.join(F.broadcast(copied) if few else copied, F.col("_own") == F.col("_hash"), "left")
    return met.where(~F.coalesce(F.col(id_col) > F.col("_first"), F.lit(False))).select(*docs.columns)


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST, most: float = MOST) -> DataFrame:
    """(term, subsets) of the terms in the band, by the rows of docs."""
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    return counts.where((F.col("df") >= 2) & (F.col("df") >= F.lit(least * n)) & (F.col("df") <= F.lit(most * n))).select("term", _subsets().alias("subsets"))


def _short(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, WIDTH)


def hashes(kept: Column, instead: Column) -> Column:
    """The fingerprint of a sorted array of (term, subsets); `instead` stands first where it is empty."""
    short = _short
    made = "array<struct<k:int,h:string>>"

    def step(acc: Column, p: Column) -> Column:
        same = acc["k"] == p["k"]
        return F.struct(
            p["k"].alias("k"), F.when(same, F.concat(acc["text"], F.lit(" "), p["term"])).otherwise(p["term"]).alias("text"),
            F.when(same | (acc["k"] == 0), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["k"].alias("k"), short(acc["text"]).alias("h"))))).alias("out"),
        )

    def subsets(own: Column) -> Column:
        """Hashes by subset, in one pass over the terms sorted by subset."""
        pairs = F.sort_array(F.flatten(F.transform(own, lambda x: F.transform(x["subsets"], lambda k: F.struct(k.alias("k"), x["term"].alias("term"))))))
        start = F.struct(F.lit(0).alias("k"), F.lit("").alias("text"), F.array().cast(made).alias("out"))
        return F.aggregate(pairs, start, step, lambda acc: F.when(acc["k"] == 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["k"].alias("k"), short(acc["text"]).alias("h"))))))

    row = lambda known: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(SUBSETS - 1)), lambda k: F.coalesce(F.try_element_at(known, k), F.lit(NONE))), "")
    whole = lambda own: F.when(F.size(own) > 0, short(F.array_join(F.transform(own, lambda x: x["term"]), " "))).otherwise(instead)
    return bound(kept, lambda own: F.concat(whole(own), bound(F.map_from_entries(subsets(own)), row)))


def likeness(a: Column, b: Column) -> Column:
    part = lambda c, i: F.substring(c, 1 + WIDTH * i, F.lit(WIDTH))
    at = F.sequence(F.lit(0), F.lit(SUBSETS - 1))
    held = F.size(F.filter(at, lambda i: (part(a, i) != NONE) | (part(b, i) != NONE)))
    same = F.size(F.filter(at, lambda i: (part(a, i) == part(b, i)) & (part(a, i) != NONE)))
    return F.when(a == b, F.lit(1.0)).otherwise(same.cast("double") / F.greatest(held, F.lit(1)))


def _following(rows: DataFrame, value: str, name: str) -> DataFrame:
    """rows (bucket, rn, value) with the value of the next row in descending order; after the last, the first."""
    order = Window.partitionBy("bucket").orderBy("rn")
    firsts = rows.groupBy("bucket").agg(F.min_by(F.struct(F.col(value).alias("v")), "rn").alias("first"))
    ranges = Window.orderBy(F.desc("bucket"))
    ring = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row a range, as many as there are tasks
    after = firsts.select("bucket", F.coalesce(F.lead("first").over(ranges), F.first("first").over(ring)).alias("_after"))
    led = rows.withColumn("_lead", F.lead(F.struct(F.col(value).alias("v"))).over(order)).join(F.broadcast(after), "bucket")
    return led.withColumn(name, F.coalesce("_lead", "_after")["v"]).drop("_lead", "_after")


def fingerprints(docs: DataFrame, texts: dict[str, Column], keys: list[str], carried: str, lex: DataFrame) -> DataFrame:
    """keys, the text column `carried`, and for each name and text column the fingerprint of that text. keys must tell the rows apart.

    A row's terms meet the lexicon one by one and are gathered again where they were: if docs are dealt by one of
    the keys, no row moves. What is carried travels as one more term, so that keys stay short.
    """
    found = F.flatten(F.array(*[F.transform(terms(F.coalesce(c, F.lit(""))), lambda t: F.struct(F.lit(i).alias("which"), t.alias("term"))) for i, c in enumerate(texts.values())]))  # noqa: B023
    own = F.array(F.struct(F.lit(-1).alias("which"), F.col(carried).alias("term")))
    # the hash of all terms, for texts without one in the lexicon; it travels as a short term of its own
    every = lambda c: bound(F.array_sort(terms(F.coalesce(c, F.lit("")))), lambda t: F.when(F.size(t) > 0, _short(F.array_join(t, " "))).otherwise(NONE))
    own = F.concat(own, *[F.array(F.struct(F.lit(-2 - i).alias("which"), every(c).alias("term"))) for i, c in enumerate(texts.values())])
    each = docs.select(*keys, F.explode(F.concat(own, found)).alias("t")).select(*keys, "t.which", "t.term")
    few = lex.count() <= FEW
    kept = each.join(F.broadcast(lex) if few else lex, "term", "left").where("subsets is not null or which < 0")
    pair = F.struct("term", "subsets")
    gathered = kept.groupBy(*keys).agg(F.max(F.when(F.col("which") == -1, F.col("term"))).alias(carried), *[F.max(F.when(F.col("which") == -2 - i, F.col("term"))).alias(f"_e{i}") for i in range(len(texts))], *[F.sort_array(F.collect_list(F.when(F.col("which") == i, pair))).alias(f"_k{i}") for i in range(len(texts))])
    return gathered.select(*keys, carried, *[hashes(F.col(f"_k{i}"), F.col(f"_e{i}")).alias(name) for i, name in enumerate(texts)])


def with_next_text(docs: DataFrame, ranges: int) -> DataFrame:
    """docs (doc_id, text) with bucket, rn and the text of the next row in descending order of doc_id."""
    bucket, _ = range_bucket(docs, "doc_id", ranges)
    rows = docs.withColumn("bucket", bucket)
    # rows of equal place in the order are equal, so the row numbers come out alike whenever a task runs
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), "text")
    # the first row of each range: its largest id, of repeated rows the first text
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    tied = rows.join(F.broadcast(tops), "bucket").where(F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("bucket").agg(F.min("text").alias("v"))
    ranges_down = Window.orderBy(F.desc("bucket"))
    ring = ranges_down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row a range, as many as there are tasks
    after = tied.select("bucket", F.coalesce(F.lead("v").over(ranges_down), F.first("v").over(ring)).alias("_after"))
    led = rows.withColumns({"rn": F.row_number().over(order), "_lead": F.lead("text").over(order)}).join(F.broadcast(after), "bucket")
    return led.withColumn("next", F.coalesce("_lead", "_after")).drop("_lead", "_after")


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lex = stored(lexicon(counting(docs)), "lexicon")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    rows = with_next_text(docs, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumn("edited", edited)
    keyed = rows.withColumns({"n_chars": n.cast("long"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)})
    prints = fingerprints(keyed, {"fingerprint": F.col("text"), "edited_fingerprint": F.col("edited")}, ["bucket", "rn", "doc_id", "n_chars"], "edited_sha256", lex)
    setting = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, GATHERED)
    try:
        prints = stored(prints, "imatch")
    finally:
        spark.conf.set(setting, before)
    prints = _following(prints, "fingerprint", "next_fingerprint")
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


_NUMBERS = ", ".join(f"(CAST('0x' || substr(sha256(term), {1 + 3 * d}, 3) AS BIGINT) % {r}) = 0" for d in range(DRAWS) for r in RATES)
_PARTS = " || ".join(
    [f"substr(md5(string_agg(term, ' ' ORDER BY term)), 1, {WIDTH})"]
    + [f"coalesce(substr(md5(string_agg(term, ' ' ORDER BY term) FILTER (WHERE m[{k}])), 1, {WIDTH}), '{NONE}')" for k in range(1, SUBSETS)]
)


def _like(a: str, b: str) -> str:
    part = lambda c: f"substr({c}, 1 + {WIDTH} * i, {WIDTH})"
    at = f"range(0, {SUBSETS})"
    held = f"len(list_filter({at}, lambda i: {part(a)} <> '{NONE}' OR {part(b)} <> '{NONE}'))"
    same = f"len(list_filter({at}, lambda i: {part(a)} = {part(b)} AND {part(a)} <> '{NONE}'))"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE {same}::DOUBLE / greatest({held}, 1) END"


_TERMS = r"list_distinct(list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''))"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS rn FROM documents),
led AS (SELECT *, length(text) AS n, length(text) // 2 AS h, coalesce(lead(text) OVER (ORDER BY rn), first_value(text) OVER (ORDER BY rn)) AS nxt FROM d),
e AS (SELECT *, substr(text, 1, n - h) || substr(nxt, 1, h) AS edited FROM led),
t AS (
  SELECT rn, 0 AS which, unnest({_TERMS.format('text')}) AS term FROM e
  UNION ALL SELECT rn, 1, unnest({_TERMS.format('edited')}) FROM e),
firsts AS (SELECT text, min(doc_id) AS m FROM d GROUP BY text),
own AS (SELECT rn FROM d JOIN firsts USING (text) WHERE NOT coalesce(doc_id > m, false)),
lex AS (
  SELECT term, [{_NUMBERS}] AS m FROM (SELECT term, count(*) AS df FROM t JOIN own USING (rn) WHERE which = 0 GROUP BY term)
  WHERE df >= 2 AND df >= {LEAST}::DOUBLE * (SELECT count(*) FROM own) AND df <= {MOST}::DOUBLE * (SELECT count(*) FROM own)),
every AS (SELECT rn, which, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, {WIDTH}) || repeat('{NONE}', {SUBSETS - 1}) AS fp FROM t GROUP BY rn, which),
p AS (SELECT rn, which, {_PARTS} AS fp FROM t JOIN lex USING (term) GROUP BY rn, which),
f AS (
  SELECT e.rn, doc_id, n, edited, coalesce(a.fp, c.fp, repeat('{NONE}', {SUBSETS})) AS fp, coalesce(b.fp, g.fp, repeat('{NONE}', {SUBSETS})) AS efp
  FROM e LEFT JOIN p a ON a.rn = e.rn AND a.which = 0 LEFT JOIN p b ON b.rn = e.rn AND b.which = 1
  LEFT JOIN every c ON c.rn = e.rn AND c.which = 0 LEFT JOIN every g ON g.rn = e.rn AND g.which = 1),
g AS (SELECT *, coalesce(lead(fp) OVER (ORDER BY rn), first_value(fp) OVER (ORDER BY rn)) AS nfp FROM f)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, efp AS edited_fingerprint,
       {_like('fp', 'efp')} AS near_edited, {_like('fp', 'nfp')} AS near_next
FROM g
"""
