"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from cupola.llm import bpe, common, decontaminate, imatch, langid, quality, registry, revisit, secrets, simhash, tokenfile, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, ids string, row string, fp string, bucket string, score string, key string, which string, label string"
LONG = "lorem ipsum dolor " * 20_000 + "token = abcdefgh12345678"
ROWS = [
    (1, "Hello there wörld, this is a text.", "en"), (1, "Hello there wörld, this is a text.", "en"), (2, None, "en"), (3, "", None), (None, "no id here", "de"), (None, None, None),
    (4, "   \n\t ", "fr"), (5, "1234 !!!", "en"), (6, LONG, "en"), (7, "a", "en"), (8, "é" * 5000, "fr"), (6, LONG, "en"), (9, "Hello there wörld, this is a text.", "en"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with odd documents, pages, benchmark and labels; the second folder has the same tables without rows."""
    root = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame([(*r, "src", None if r[1] is None else len(r[1]), *["x"] * 9) for r in ROWS], SCHEMA)
    bench = spark.createDataFrame([(1, "hello there wörld this is a text"), (1, "hello there wörld this is a text"), (2, None), (3, ""), (None, "lorem ipsum dolor"), (4, "...")], "item_id long, text string")
    pages = spark.createDataFrame([(1, "http://a.example.org/en/1", "<p>"), (1, "http://a.example.org/en/1", "<p>"), (None, None, None), (3, None, "x"), (4, "nothing", None), (5, "http://", "")], "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    for name, df in {"documents": docs, "benchmark": bench, "pages": pages, "labels": labels}.items():
        df.write.parquet(f"{root}/some/{name}.parquet")
        df.limit(0).write.parquet(f"{root}/none/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_rows_and_empty_tables(spark, odd, name):
    out = registry.QUERIES[name](spark, f"{odd}/some").collect()
    if name in ("op6_urlfilter",):
        assert len(out) == 6
    elif name == "op11_lexical":  # a row an item and document found; repeated items are one
        assert {(r.item_id, r.rank) for r in out} == {(1, k) for k in range(1, 5)} | {(None, 1), (None, 2)} and len(out) == 6
    elif name == "op12_filteraudit":
        assert len(out) == 600 and {r.part for r in out} == {"src"}
    elif name != "op4_revisit":
        assert len(out) == len(ROWS)
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in ROWS)
    assert registry.QUERIES[name](spark, f"{odd}/none").collect() == []


def test_pipeline_on_odd_and_empty_tables(spark, odd):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, f"{odd}/some").collect()
    assert {r.doc_id for r in out} <= {r[0] for r in ROWS} and all(r.n_tokens > 0 for r in out)
    assert len({r.doc_id for r in out}) == len(out)
    assert corpus_pipeline.run(spark, f"{odd}/none").collect() == []


def of(spark, odd, name):
    return {(r.doc_id, i): r for i, r in enumerate(registry.QUERIES[name](spark, f"{odd}/some").orderBy("doc_id").collect())}


def test_defined_results(spark, odd):
    rows = registry.QUERIES["op10_simhash"](spark, f"{odd}/some").collect()
    assert {r.component_id for r in rows if r.doc_id in (1, 9)} == {1}
    assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (2, 3, 4)} == {("0" * 16, 2)}
    rows = registry.QUERIES["op3_decontaminate"](spark, f"{odd}/some").collect()
    assert {(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows if r.doc_id == 1} == {(7, 7, 1, True)}
    assert {(r.n_words, r.n_hit, r.n_items) for r in rows if r.doc_id == 6} == {(60_002, 60_000, 1)}
    assert {(r.n_words, r.contaminated) for r in rows if r.doc_id in (2, 3, 4)} == {(0, False)}
    rows = registry.QUERIES["op7_secrets"](spark, f"{odd}/some").collect()
    assert {r.n_assign for r in rows if r.doc_id == 6} == {1}
    assert {r.spans for r in rows if r.doc_id != 6} == {""}
    rows = registry.QUERIES["op5_langid"](spark, f"{odd}/some").collect()
    assert {(r.lang_pred, r.score) for r in rows if r.doc_id in (2, 3, 4, 5)} == {("und", 0.0)}
    rows = registry.QUERIES["op1_tokens"](spark, f"{odd}/some").collect()
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert sorted(r.start for r in rows)[0] == 0
    assert max(r.start + r.n_tokens for r in rows) == sum(r.n_tokens for r in rows)
    rows = registry.QUERIES["op8_imatch"](spark, f"{odd}/some").collect()
    assert len({r.fingerprint for r in rows if r.doc_id == 6}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_stages_return_the_columns_of_documents(spark, odd):
    docs = spark.read.parquet(f"{odd}/some/documents.parquet")
    for module in (langid, simhash, decontaminate, secrets):
        assert module.stage(spark, docs, f"{odd}/some").columns == docs.columns
    kept = simhash.stage(spark, docs, f"{odd}/some").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 5, 6, 7, 8]
    assert sum(r.doc_id is None for r in kept) == 2
    assert bpe.stage(spark, docs, f"{odd}/some").columns == ["doc_id", "ids", "n_tokens"]
    assert secrets.stage(spark, docs, f"{odd}/some").where("doc_id = 6").first().text.endswith(secrets.MARK)


def test_benchmark_in_blocks_gives_the_same(spark, odd):
    docs, bench = (spark.read.parquet(f"{odd}/some/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontaminate.contamination(docs, bench)
    many = decontaminate.contamination(docs, bench, block_words=8)
    key = lambda df: sorted(str(r) for r in df.select("id", "n_words", "n_hit", "items", "spans").collect())
    assert key(one) == key(many)


def test_token_files_read_back(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd}/some/documents.parquet")
    tokenfile.write(docs, str(tmp_path / "f"), ranges=3)
    back = tokenfile.read(spark, str(tmp_path / "f")).collect()
    assert len(back) == len(ROWS)
    assert all(len(r.ids) == 4 * r.n_tokens for r in back)


def test_large_rule_sets_join_by_shuffle(spark, odd, monkeypatch):
    pages = spark.read.parquet(f"{odd}/some/pages.parquet").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame([*urlfilter.RULES, (None, "/", "block"), ("org", "/", "block")], "host string, path string, verdict string")
    few = sorted(str(r) for r in urlfilter.judge(pages, rules).collect())
    monkeypatch.setattr(urlfilter, "FEW", 0)
    assert sorted(str(r) for r in urlfilter.judge(pages, rules).collect()) == few


def test_revisits(spark):
    full = lambda i, ts, tag, url="http://x.org/a": (i, url, ts, "response", tag, "d1", f"sha{i}", {"A": "1", "Date": "old"})
    again = lambda i, ts, tag, lm=None, url="http://X.org:80/a#f": (i, url, ts, "revisit", tag, lm, None, {"date": "new", "Set-Cookie": "no"})
    rows = [full(1, 10, '"a"'), full(2, 20, '"b"'), again(3, 15, 'W/"a"'), again(4, 20, '"b"'), again(5, 25, '"a"'), again(6, 5, '"a"'), again(7, 30, None, "d1"), again(8, 30, None), again(9, 30, '"b"', url=None), again(9, 30, '"b"', url=None), (10, "u", 1, "other", None, None, None, None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>")
    for slices in (1, 4):
        got = {(r.record_id, r.status, r.refers_to) for r in revisit.resolve(df, slices).collect()}
        assert got == {(3, "resolved", 1), (4, "resolved", 2), (5, "mismatch", None), (6, "orphan", None), (7, "resolved", 2), (8, "unverified", 2), (9, "orphan", None)}
    assert revisit.resolve(df).where("record_id = 3").first().headers == {"A": "1", "date": "new"}
    assert revisit.resolve(df).count() == 8


def test_quality_without_labels_keeps_all(spark, odd):
    out = quality.assess(*(spark.read.parquet(f"{odd}/some/{t}.parquet") for t in ("documents", "labels"))).collect()
    assert {(r.score, r.keep) for r in out} == {(0.5, True)}


@pytest.mark.parametrize("n", [1, 3, 40, 1100])
def test_key_ranges_ascend(spark, n):
    df = spark.range(3000).select((F.col("id") * F.col("id") - 50).alias("k")).unionByName(spark.createDataFrame([(None,), (5,), (5,)], "k long"))
    bucket, count = common.range_bucket(df, "k", n)
    rows = df.select("k", bucket.alias("b")).collect()
    assert all(0 <= r.b < count for r in rows)
    assert {r.b for r in rows if r.k is None} == {0}
    ordered = [r.b for r in sorted((r for r in rows if r.k is not None), key=lambda r: r.k)]
    assert ordered == sorted(ordered)
    assert len(set(ordered)) >= min(n, 1000) * 0.6
    assert common.range_bucket(df.limit(0), "k", n)[1] == 1


def test_likeness(spark):
    a = "abcdef" * imatch.SUBSETS
    b = imatch.NONE * imatch.SUBSETS
    half = "abcdef" + imatch.NONE * (imatch.SUBSETS - 1)
    rows = [(a, a, 1.0), (b, b, 1.0), (a, b, 0.0), (a, half, 1 / imatch.SUBSETS)]
    got = spark.createDataFrame(rows, "a string, b string, w double").select(imatch.likeness(F.col("a"), F.col("b")).alias("x"), "w").collect()
    assert all(abs(r.x - r.w) < 1e-9 for r in got)
