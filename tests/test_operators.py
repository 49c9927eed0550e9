"""Model-based tests: the Spark operators against naive loops written from the rules."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cupola.operators import audits, dedup, quota, splits
from cupola.operators.ordering import ranked, running


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def fold(events):
    cur = None
    for e in events:
        if cur is None or (e[1] and not cur[1]) or cur[2] is None or (e[2] is not None and e[2] < cur[2]):
            cur = e
    return cur


@pytest.mark.parametrize("events,want", [([(0, None, 1990), (1, "3.1", 2000)], 1), ([(0, "3.1", 2000), (1, None, 1990)], 1), ([(0, "3.1", None), (1, None, None)], 1), ([(0, "a", 5), (1, "b", 5)], 0)])
def test_fold_cases(spark, events, want):
    df = spark.createDataFrame([("k", *e) for e in events], "k string, ord long, name string, year int")
    assert [r.ord for r in dedup.survivors(df, "k", "ord", "name", "year").collect()] == [want]


def test_fold_against_the_loop(spark):
    rnd = random.Random(5)
    rows, ord_ = [], 0
    for k in range(120):
        for _ in range(rnd.randint(1, 12)):
            rows.append((f"k{k}", ord_, rnd.choice([None, "a"]), rnd.choice([None, 1, 2, 3])))
            ord_ += 1
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, ord long, name string, year int").repartition(5)
    by = {}
    for r in sorted(rows, key=lambda r: r[1]):
        by.setdefault(r[0], []).append((r[1], r[2] is not None, r[3]))
    want = sorted(fold(v)[0] for v in by.values())
    assert sorted(r.ord for r in dedup.survivors(df, "k", "ord", "name", "year").collect()) == want
    assert sorted(r.ord for r in dedup.survivors(dedup.shrunk(df, "k", "ord", "name", "year", 20), "k", "ord", "name", "year").collect()) == want


def naive_fill(counts, targets):
    """counts: (doc, n) in order; returns rows of each document that each level takes."""
    out, level, have = [], 0, 0
    for doc, n in counts:
        if level == len(targets):
            break
        take = min(n, max(0, targets[level] - have))
        out.append((level, doc, take))
        have += take
        if have >= targets[level]:
            level, have = level + 1, 0
    return out


def test_fill_against_the_loop(spark):
    rnd = random.Random(8)
    for _ in range(6):
        docs = [(f"d{i}", rnd.randint(1, 6)) for i in range(rnd.randint(1, 14))]
        targets = [rnd.randint(0, 9) for _ in range(rnd.randint(1, 3))]
        rows = spark.createDataFrame([(d, f"{d}-{j}") for d, n in docs for j in range(n)], "doc string, key string")
        table = quota.document_order(rows, "doc", 3)
        levels = spark.createDataFrame(list(enumerate(targets)), "level int, target long")
        limits = {r.level: r for r in quota.fill(table, levels).collect()}
        got = []
        for r in sorted(table.collect(), key=lambda r: r.cum):
            for k, lim in limits.items():
                if lim.base < r.cum <= lim.end:
                    got.append((k, r.doc, max(0, min(r.cnt, lim.target - (r.cum - r.cnt - lim.base)))))
        order = sorted(docs, key=lambda d: (md5(f"{d[0]}:3:doc"), d[0]))
        assert got == naive_fill(order, targets)


def test_overflowing_document_is_cut_and_its_rest_dropped(spark):
    rows = spark.createDataFrame([(f"US{d}", f"US{d}-{j}") for d in range(3) for j in range(3)], "doc string, key string")
    out = quota.split_documents(rows, "key", "doc", [[("a", 4)], [("b", 2)]], 1, jurisdiction="US").collect()
    docs = {s: {r.doc for r in out if r.split == s} for s in "ab"}
    assert (len(out), len(docs["a"]), len(docs["b"])) == (6, 2, 1)
    assert not docs["a"] & docs["b"]
    again = quota.split_documents(rows.repartition(7), "key", "doc", [[("a", 4)], [("b", 2)]], 1).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_quota_errors(spark):
    rows = spark.createDataFrame([("US1", "a"), ("EP1", "b"), (None, "c")], "doc string, key string")
    with pytest.raises(quota.QuotaError, match="falls short"):
        quota.split_documents(rows, "key", "doc", [[("a", 9)]], 1)
    with pytest.raises(quota.QuotaError, match="expected documents of US"):
        quota.split_documents(rows, "key", "doc", [[("a", 1)]], 1, jurisdiction="US")
    with pytest.raises(quota.QuotaError, match="no documents"):
        quota.split_documents(rows.where("doc is null"), "key", "doc", [[("a", 1)]], 1)
    with pytest.raises(ValueError, match="twice"):
        quota.levels_of([[("a", 1)], [("a", 1)]])
    with pytest.raises(ValueError, match="negative"):
        quota.levels_of([[("a", -1)]])
    assert quota.split_documents(rows, "key", "doc", [[("a", 9)]], 1, leeway=7).count() == 2


def test_ranks_and_running_sums(spark):
    keys = [f"k{i}" for i in range(300)]
    df = spark.createDataFrame([(k, i % 3, i) for i, k in enumerate(keys)], "key string, g int, v long").withColumn("h", F.md5(F.col("key").cast("binary")))
    got = {r.key: r["rank"] for r in ranked(df, "h", "key").collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(keys, key=md5)
    sums = {r.key: r.s for r in running(df, "h", "key", F.col("v"), "s", ("g",)).collect()}
    for g in range(3):
        total = 0
        for k in sorted((k for i, k in enumerate(keys) if i % 3 == g), key=md5):
            total += int(k[1:])
            assert sums[k] == total


def reactions(spark, n=600):
    rnd = random.Random(4)
    rows = [(f"r{i}", f"US{rnd.randint(0, 90)}_{rnd.choice('AB')}" if i % 20 else None, [f" A{rnd.randint(0, 25)} "], f"{rnd.randint(1, 4)}.{rnd.randint(1, 3)}" if i % 15 else "0.0", "Chloro Suzuki" if i % 2 else "other", 1995 + i % 5) for i in range(n)]
    return spark.createDataFrame(rows, "key string, title string, authors array<string>, name_rxn string, name_rxn_def string, year int")


def test_author_split_keeps_claimants_apart(spark):
    rows = reactions(spark)
    spec = [[[("od", 60)]], [[("doc_od", 40)], [("train", 120), ("valid", 30)]]]
    out = splits.split_author_documents(rows, spec, 3, overbuffer=10, jurisdiction="US").persist()
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"od": 60, "doc_od": 40, "train": 120, "valid": 30}
    assert audits.shared(out, "doc", "author_level").count() == 0
    assert audits.repeats(out, "key").count() == 0
    _, used = splits.split_authors(rows, spec, 3, overbuffer=10)
    assert [u["author_level"] for u in used] == [0, 1] and 0 < used[0]["n_authors_used"] < used[1]["n_authors_used"] <= 26
    held = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = held()
    splits.split_author_documents(rows, spec, 3, overbuffer=10).count()
    assert held() == before  # the splits keep nothing in the executors
    with pytest.raises(quota.QuotaError, match="authors run out"):
        splits.split_author_documents(rows, [[[("a", 10_000)]]], 3)


def test_class_split_shares_no_document_or_class(spark):
    out = splits.split_classes(reactions(spark), ["2"], 5, 5, 40, 30, 5, seed=2).persist()
    side = F.when(F.col("split").isin("ft", "od_test"), "od").otherwise("id")
    assert audits.shared(out.withColumn("side", side), "doc", "side").count() == 0
    assert audits.shared(out.withColumn("side", side), "name_rxn", "side").count() == 0
    assert audits.shared(out, "key").count() == 0
    none = splits.split_classes(reactions(spark), ["9"], 5, 5, 40, 30, 5, seed=2)
    assert {r.split for r in none.select("split").distinct().collect()} == {"valid", "id_test", "train"}


def test_class_split_keeps_repeated_rows_and_only_drawn_documents(spark):
    rows = reactions(spark)
    twice = rows.unionByName(rows.where("year = 1995"))
    out = splits.split_classes(twice, ["2"], 5, 5, 40, 30, 5, seed=2, exclude_all_docs=False)
    got = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert got == {"ft": 5, "od_test": 30, "valid": 5, "id_test": 5, "train": 40}
    side = F.when(F.col("split").isin("ft", "od_test"), "od").otherwise("id")
    assert audits.shared(out.withColumn("side", side), "doc", "side").count() == 0
    with pytest.raises(quota.QuotaError, match="fine-tuning"):
        splits.split_classes(rows.withColumn("title", F.lit(None).cast("string")), ["2"], 5, 5, 40, 30, 5, seed=2)
    with pytest.raises(quota.QuotaError, match="want"):
        splits.split_classes(rows, ["2"], 5_000, 5, 40, 30, 5, seed=2)


def test_year_sizes(spark):
    rows = spark.range(8001).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") < 4001, 2000).when(F.col("id") < 8000, 2001).otherwise(1850).alias("year"))
    got = {r.year: (r.n, r.test, r.train, r.valid) for r in splits.year_sizes(rows, 2000, 0.05).collect()}
    assert got == {2000: (4001, 2000, 1900, 101), 2001: (3999, 0, 3799, 200)}


def test_terms_and_bespoke(spark):
    rows = reactions(spark)
    assert splits.term_warnings(rows, [["chloro", "SUZUKI"], ["absent"]]).select("term_group").distinct().collect()[0][0] == "chloro+SUZUKI"
    every, kept = splits.bespoke(rows, ["1"], [rows.where("year = 1995")])
    assert kept.count() == every.where("year <> 1995").count() < every.count()
    assert splits.missing_keys(rows, rows).count() == 0


def test_author_containment(spark):
    train = spark.createDataFrame([("t", ["Ann", "bob "])], "key string, authors array<string>")
    ood = spark.createDataFrame([("a", ["ANN"]), ("b", ["Bob", "Cy"])], "key string, authors array<string>")
    assert [r.key for r in audits.covered_by(ood, train).collect()] == ["a"]
