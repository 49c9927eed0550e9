"""Toxicity by nearest examples: exact neighbours, held-out figures, what is never looked at, odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from cupola.llm import registry
from cupola.llm import toxicity as T

FAR = "/root/testdata/sf0.1"


def test_nearest_are_exact():
    rng = random.Random(3)
    idf = np.array([1 + rng.random() * 5 for _ in range(60)])
    made = lambda: zip(*sorted((t, rng.choice([1, 1, 2, 9])) for t in rng.sample(range(60), rng.randint(1, 6))))
    rows = [(str(i), i % 3 == 0, rng.getrandbits(60), *map(list, made())) for i in range(700)]
    index = T.Index(idf, rows)
    dense = np.zeros((len(index.ids), 60))
    for i, (ids, tfs) in enumerate(index.rows):
        dense[i, ids] = index.weigh(ids, tfs)
    for q in range(200):
        ids, tfs = map(list, made())
        without = q if q % 2 else -1
        near = dense[:, ids] @ index.weigh(ids, tfs)
        near[without if without >= 0 else []] = 0
        best = [i for i in np.lexsort((index.marks, -np.round(near, 9)))[: T.NEAR] if near[i] > 0]
        got, found = index.nearest(ids, tfs, T.NEAR, without)
        assert got.tolist() == best
        assert np.allclose(found, near[best], atol=1e-8)


def test_isotonic_ascends_and_pools():
    p = T.isotonic([(0, 100, 1), (1, 10, 4), (2, 10, 2), (5, 20, 19)], 0.1)
    assert p[0] < p[1] == p[2] < p[5]
    assert p[1] == (6 + 0.1) / 21


def test_held_out_documents(spark):
    labels = spark.read.parquet(f"{FAR}/labels.parquet")
    rows = registry.QUERIES["op13_toxicity"](spark, FAR)
    both = rows.where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    hits = sum(r.toxic and r.predicted for r in both)
    # one label in twenty or so is wrong in this table
    assert hits > 0.8 * sum(r.toxic for r in both)
    assert hits > 0.85 * sum(r.predicted for r in both)


def _tables(spark, n=400):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        docs.append((i, " ".join([*[word() for _ in range(30)], *(["vilest", "nastiness"] if bad else [])]), f"l{i % 3}", f"s{i}", 0.5, "z"))
        labels.append((i, int(bad)))
    docs += [(5000, None, None, None, None, None), (5001, "", "l1", "s", 1.0, "q"), (None, "a vilest thing", "l1", "s", 1.0, "q"), (5002, "vilest " * 30_000, "l1", "s", 1.0, "q"), (7, "vilest nastiness again", "l1", "s", 1.0, "q")]
    labels += [(3, None), (None, 1), (8, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double, evidence string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_odd_rows_and_inputs_that_don_t_count(spark):
    docs, labels = _tables(spark)
    rows = T.scored(docs.repartition(3), labels).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[5000][0].predicted == by[5001][0].predicted == 0
    assert by[None][0].predicted == by[5002][0].predicted == 1 and not by[None][0].held_out
    assert sorted(r.predicted for r in by[7]) == [0, 1]
    assert all(0 <= r.score <= 1 for r in rows)
    # other languages, sources and held-out labels change nothing
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(str, T.scored(other, turned).collect())) == sorted(map(str, rows))


def test_no_labels_or_one_class(spark):
    docs, labels = _tables(spark, 40)
    assert {r.score for r in T.scored(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in T.scored(docs, labels.withColumn("toxic", F.lit(1))).collect()} == {1.0}
    assert T.scored(docs.limit(0), labels).count() == 0


def test_group_of_copies_gives_no_terms(spark):
    docs, labels = _tables(spark)
    copies = spark.createDataFrame([(9000 + i, "some words that only this text has among all " * 3 + ("x" if i % 2 else "y")) for i in range(200)], "doc_id long, text string")
    more = docs.unionByName(copies, allowMissingColumns=True)
    marked = labels.unionByName(copies.select("doc_id", F.lit(1).alias("toxic")))
    chosen = T.space(T.examples(more, marked))
    assert "vilest" in chosen and "among" not in chosen


def test_vectors_are_the_counts_of_the_terms_in_the_space(spark):
    docs, _ = _tables(spark, 40)
    numbers = {t: i for i, t in enumerate(["abcd", "nast~", "nasti~", "nastiness", "vilest", "vile~", "agai~"])}
    for r in T.vectors(docs, numbers).join(docs.select("doc_id", "text"), "doc_id").where("doc_id <> 7").collect():
        assert dict(zip(r.ids, r.tfs)) == {numbers[t]: n for t, n in T.terms(r.text).items() if t in numbers}


def test_words_of_all_texts_stay_out_of_the_space(spark):
    rng = random.Random(1)
    # "common" stands in more toxic rows than chance explains, and tells next to nothing
    rows = [(str(i), int(i % 10 == 0), i, i, ["common"] * (rng.random() < (0.75 if i % 10 == 0 else 0.6)) + ["vilest"] * (i % 20 == 0), [1]) for i in range(8000)]
    learning = spark.createDataFrame(rows, "doc_id string, toxic int, mark long, alike long, terms array<string>, tfs array<int>")
    assert T.space(learning) == ["vilest"]
    assert T.space(learning, telling=1.0) == ["common", "vilest"]
