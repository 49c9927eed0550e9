"""Rows that share an id, and shards of fingerprints that stay bounded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cupola.llm import simhash


@pytest.mark.parametrize("parts", [1, 3])
def test_rows_are_chosen_not_ids(spark, parts):
    a, b = "alpha beta gamma", "quite another text here"
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (5, b, "x"), (7, b.upper(), "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").repartition(parts)
    assert sorted(tuple(r) for r in simhash.stage(spark, docs, "").collect()) == [(1, a, "x"), (5, b, "x")]


def test_shards_stay_bounded_when_the_input_grows(spark):
    rng, largest = np.random.default_rng(1), {}
    for n in (300, 30_000):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
        points = np.unique(np.concatenate([base, near]))
        df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
        dealt = simhash.shards(df, 2, 300, 900, 500, 2000)
        largest[n] = dealt.groupBy("shard").count().agg(F.max("count")).first()[0]
        # every planted pair meets in some shard
        a, b = (x.view(np.int64).tolist() for x in (base[:200], near))
        pairs = spark.createDataFrame(list(zip(a, b, strict=True)), "a long, b long")
        met = dealt.select("shard", F.col("fp").alias("a")).join(pairs, "a").join(dealt.select("shard", F.col("fp").alias("b")), ["shard", "b"])
        assert met.select("a", "b").distinct().count() == 200
    assert max(largest.values()) <= 900
