"""I-Match where copies abound, and token edits near their place only."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from cupola.llm import bpe, imatch


def test_groups_of_copies_keep_their_terms(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    one, two, junk = (" ".join(word() for _ in range(60)) for _ in range(3))
    rows = [(i, one) for i in range(30)] + [(100 + i, two) for i in range(30)] + [(200, junk), (201, ""), (202, None), (203, "+++")]
    rows += [(300 + i, " ".join([*rng.sample(one.split(), 3), *rng.sample(two.split(), 3), *(word() for _ in range(20))])) for i in range(36)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in imatch.op8_imatch(spark, str(tmp_path)).collect()}
    assert len({got[i].fingerprint for i in range(30)}) == 1
    prints = [got[i].fingerprint for i in (0, 100, 200)]
    pairs = spark.createDataFrame([(a, b) for a in prints for b in prints if a < b] + [(prints[2], got[201].fingerprint)], "a string, b string")
    assert all(r[0] < 1 for r in pairs.select(imatch.likeness(F.col("a"), F.col("b"))).collect())
    assert got[201].fingerprint == got[202].fingerprint == got[203].fingerprint


def test_edits_of_long_texts_take_little_time():
    rng = random.Random(8)
    b = bpe.encoder()
    some = ["the", "Zürich", "x1y2", "...", "don't", "\n\n", "naïve", "日本語", "1234567", "   "]
    took = {}
    for size in (20_000, 1_400_000):
        text = " ".join(rng.choice(some) for _ in range(size // 6))
        ids = b.encode(text)
        spans = [(rng.randrange(len(text)), rng.choice(["abc", "", " ", "\n", "ß 12"])) for _ in range(6)]
        began = time.perf_counter()
        made = [b.edit(text, ids, at, min(len(text), at + 3), new) for at, new in spans]
        took[size] = (time.perf_counter() - began) / 6
        for (at, new), x in zip(spans[:3], made):
            assert np.array_equal(x, b.encode(text[:at] + new + text[at + 3 :]))
        assert np.array_equal(b.append(text, ids, "s and more"), b.encode(text + "s and more"))
    assert took[1_400_000] < 0.1  # what is left is copying ids


def test_edits_anywhere():
    rng = random.Random(9)
    b = bpe.encoder()
    alphabet = ["a", "b", " ", " ", "é", "1", ".", "\n", "'s", "Ω", "  ", "word", "the "]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        at = rng.randint(0, len(text))
        end = rng.randint(at, min(len(text), at + 5))
        new = "".join(rng.choice(alphabet) for _ in range(rng.randrange(4)))
        assert np.array_equal(b.edit(text, b.encode(text), at, end, new), b.encode(text[:at] + new + text[end:]))
