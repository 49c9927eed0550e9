"""Ranked search: NRA against complete scores, shards and blocks of any size, odd rows."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cupola.llm import nra

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def plain(docs, items, most):
    """Rows by complete scoring, in plain Python."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(LETTERS, LETTERS.lower())))
    bags = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, b, sum(b.values())) for i, b in bags if b]
    n_all, length, out = len(held), sum(n for _, _, n in held), []
    for item, text in set(items):
        scores = []
        for i, b, n in held:
            m = 50 + (50 * n * n_all) // length
            score = sum(nra.weight(n_all, sum(t in x for _, x, _ in held)) * ((10**9 * b[t]) // (1000 * b[t] + 20 * m)) for t in set(split(text)) if t in b)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, k + 1, x[2], -x[0]) for k, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:most])]
    return sorted(out, key=str)


DOCS = [
    (1, "The cat sat on the mat"), (2, "the CAT"), (3, None), (4, ""), (5, "... --- !!"), (6, "dog dog dog straße Über"), (None, "the cat"), (2, "the CAT"), (7, "Ünder das über cat é"),
    *[(100 + i, " ".join(["cat", "hat", f"w{i % 3}", "the"] * (1 + i % 4))) for i in range(40)], (900, "hat " * 20_000 + "cat"),
]
ITEMS = [(1, "the cat"), (1, "the cat"), (2, "hat w1 W2 unknown"), (3, None), (4, "straße über"), (None, "dog"), (5, "?!")]


def frames(spark):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in DOCS], "doc_id long, text string, q string, score int, rank int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_search_by_complete_scores(spark, monkeypatch):
    docs, items = frames(spark)
    for most, shard, first, block in ((5, 1 << 15, 128, 2048), (5, 7, 1, 2), (50, 16, 2, 3)):
        for name, value in (("SHARD", shard), ("FIRST", first), ("ITEMS", block)):
            monkeypatch.setattr(nra, name, value)
        got = sorted([tuple(r) for r in nra.search(docs.repartition(3), items, most).collect()], key=str)
        assert got == plain(DOCS, ITEMS, most)


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert nra.search(docs.limit(0), items).count() == 0
    assert nra.search(docs, items.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(1, 8), st.randoms(use_true_random=False))
def test_first_k_is_exact(size, n_lists, k, random):
    whole, lists = np.zeros(size, np.int64), []
    for _ in range(n_lists):
        places = np.array(sorted(random.sample(range(size), random.randint(1, size))), np.int64)
        own = np.array([random.choice([1, 2, 3, 50, 1000]) for _ in places], np.int64)
        order = np.argsort(-own, kind="stable")
        lists.append((places[order], own[order]))
        whole[places] += own
    at, score, _ = nra.first_k(lists, size, k)
    assert (whole[at] == score).all()
    wanted = sorted(((-s, i) for i, s in enumerate(whole.tolist()) if s > 0))
    assert sorted((-s, i) for i, s in zip(at.tolist(), score.tolist()))[:k] == wanted[:k]
    # every document that ties with the last one is there as well
    if len(wanted) > k:
        assert {i for s, i in wanted if s <= wanted[k - 1][0]} <= set(at.tolist())


def test_reading_ends_early():
    rng = np.random.default_rng(1)
    size = 20_000
    strong = np.sort(rng.integers(1, 10, size))[::-1].copy()
    strong[:10] = 10_000
    lists = [(rng.permutation(size), strong), (rng.permutation(size)[:10], np.full(10, 5))]
    _, _, read = nra.first_k(lists, size, 5)
    assert read < 1000
