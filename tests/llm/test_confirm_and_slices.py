"""Short prefixes that collide, clashing column names, and captures that share a moment."""

from pyspark.sql import functions as F

from cupola.llm import revisit, urlfilter


def test_equal_short_prefixes_are_told_apart_by_the_digest(spark, monkeypatch):
    names = ("page_id", "url", "page", "digests", "best", "number", "short0", "alike0", "_row", "_all")
    pages = spark.createDataFrame([(1, "http://a.org/x", *["c"] * 8), (2, "http://b.net/x", *["c"] * 8), (3, "http://c.com/x", *["c"] * 8)], ", ".join(f"{n} {'long' if n == 'page_id' else 'string'}" for n in names))
    rules = spark.createDataFrame([("org", "/", "block"), ("net", "/", "allow"), ("de", "/", "block")], "host string, path string, verdict string")
    want = {1: ("org/", "block"), 2: ("net/", "allow"), 3: (None, "allow")}
    for few in (urlfilter.FEW, 0):
        monkeypatch.setattr(urlfilter, "FEW", few)
        monkeypatch.setattr(urlfilter, "_short", lambda digest: F.when(digest.isNotNull(), F.lit(7).cast("long")))  # all prefixes collide
        out = urlfilter.judge(pages, rules)
        assert out.columns == [*names, "host", "path", "rule", "verdict"]
        rows = out.collect()
        assert {r.page_id: (r.rule, r.verdict) for r in rows} == want
        assert len(rows) == 3 and {r.best for r in rows} == {"c"}


def test_slices_and_ties_change_nothing(spark):
    rows = []
    for i in range(400):
        url = "http://hot.org/a" if i % 3 else f"http://x{i % 7}.org/"
        kind = "response" if i % 5 == 0 else "revisit"
        # record ids and moments repeat, with other contents
        rows.append((i // 4, url, None if i % 50 == 49 else i // 6, kind, f'"{i % 9}"', None, f"d{i}" if kind == "response" else None, {"Date": str(i)}))
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    out = [sorted(str(r) for r in revisit.resolve(df.repartition(k), s).collect()) for k, s in ((1, 1), (3, 1), (5, 7), (2, 40), (4, None))]
    assert all(x == out[0] for x in out)


def test_a_popular_url_of_one_moment_is_cut_as_well(spark, monkeypatch):
    monkeypatch.setattr(revisit, "LEAST_SLICE", 100)
    kind = F.when(F.col("id") % 10 == 0, "response").otherwise("revisit")
    # a third of one moment, a third of none, and a third that is one row over and over
    rows = spark.range(9_000).select(
        F.when(F.col("id") % 3 < 2, F.col("id")).otherwise(0).alias("record_id"), F.concat(F.lit("http://h.org/"), F.col("id") % 3).alias("url"), F.when(F.col("id") % 3 == 0, F.lit(5)).cast("long").alias("ts"),
        F.when(F.col("id") % 3 < 2, kind).otherwise("revisit").alias("kind"), F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit("d").alias("digest"), F.create_map(F.lit("a"), F.lit("b")).alias("headers"),
    )
    keyed = rows.withColumns({"key": revisit.canonical(F.col("url")), "mark": F.lit(1).cast("long"), "row": F.col("record_id") * 0 + F.monotonically_increasing_id()})
    sizes = [r["count"] for r in revisit._sliced(keyed, None).groupBy("key", "slice").count().collect()]
    assert sum(sizes) == 9_000 and len(sizes) > 20 and max(sizes) < 1_200
    one, many = (sorted(map(str, revisit.resolve(rows, s).collect())) for s in (1, None))
    assert one == many and len(one) == rows.where("kind = 'revisit'").count()
