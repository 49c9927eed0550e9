"""Near copies of the pipeline, by brute force over all pairs."""

import random

import numpy as np

from cupola.llm import resemblance, simhash


def plain_components(texts):
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for k, t in texts.items()}
    top = {k: k for k in texts}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {k: root(k) for k in texts}


def edited(words, n, rnd):
    """The words with n of them replaced, far from each other."""
    out, step = list(words), len(words) // n
    for i in range(n):
        out[i * step + step // 2] = f"new{rnd.random()}"
    return out


def test_edited_copies_are_linked_and_others_stay(spark):
    rnd = random.Random(1)
    texts = {}
    for k in range(12):
        words = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        # 3 edits of 300 words: similarity about 0.9; 20 edits: about 0.5
        for copy in (words, [w.upper() for w in words], edited(words, 3, rnd), edited(words, 20, rnd)):
            texts[len(texts)] = " ".join(copy)
    texts |= {len(texts): "", len(texts) + 1: "  ", len(texts) + 2: "one two", len(texts) + 3: "one three"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = plain_components(texts)
    got = {r.id: r.component for r in resemblance.near_copies(docs).collect()}
    assert got == want
    assert sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect()) == sorted(set(want.values()))
    assert want[2] == 0 and want[3] == 3


def test_chains_inside_a_bucket(spark):
    """Each text follows from the one before by one edit: neighbours are near, the ends are not."""
    rnd = random.Random(2)
    words, texts = [f"w{i}" for i in range(200)], {}
    for k in range(40):
        texts[k] = " ".join(words)
        words[5 * k] = f"new{k}"
    order = list(texts)
    rnd.shuffle(order)
    got = {r.id: r.component for r in resemblance.near_copies(spark.createDataFrame([(k, texts[k]) for k in order], "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}


def test_recall_at_the_limit():
    """Share of pairs of similarity 0.80 to 0.82 that agree in a band."""
    rng, hit = np.random.default_rng(7), 0
    for _ in range(1000):
        pool = rng.integers(0, 2**64, 224, np.uint64)
        a, b = np.unique(pool[:202]), np.unique(np.concatenate([pool[:180], pool[202:]]))
        assert 0.80 <= resemblance.similarity(a, b) < 0.82
        hit += bool(set(resemblance.bands(a)) & set(resemblance.bands(b)))
    print("recall", hit / 1000)
    assert hit >= 970


def test_a_group_whose_members_drift_apart(spark):
    """Copies of one text with 1 to 7 edits: many share bands and aren't near any other; a few share their edits with one other."""
    rnd = random.Random(3)
    base, texts = [f"w{i}" for i in range(150)], {}
    for k in range(60):
        one = edited(base, 1 + k % 7, rnd)
        texts[len(texts)] = " ".join(one)
        if k % 5 == 0:
            texts[len(texts)] = " ".join([*one[:-1], f"end{k}"])
    want = plain_components(texts)
    got = {r.id: r.component for r in resemblance.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want
    assert len(set(want.values())) > 20
