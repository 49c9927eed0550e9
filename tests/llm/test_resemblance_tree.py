"""Near copies come through the SimHash tree first; the pipeline's encoder keeps small stores."""

import random

import numpy as np

from cupola.llm import bpe, resemblance, simhash
from tests.llm.test_resemblance import edited, plain_components


def test_the_tree_alone_links_close_copies(spark, monkeypatch):
    """Without any band, copies with one edit of 300 words are linked by the fingerprints, and nothing else is."""
    whole = resemblance._members
    monkeypatch.setattr(resemblance, "_members", lambda distinct: whole(distinct).limit(0))
    rnd, texts = random.Random(5), {}
    for _ in range(20):
        words = [f"w{rnd.randrange(5000)}" for _ in range(600)]
        for copy in (words, [w.upper() for w in words], edited(words, 1, rnd)):
            texts[len(texts)] = " ".join(copy)
    got = {r.id: r.component for r in resemblance.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    prints = {k: simhash.folded(resemblance.shingles(resemblance.words_of(t))) for k, t in texts.items()}
    close = {k for k in texts if k % 3 == 2 and int(prints[k] ^ prints[k - 2]).bit_count() <= resemblance.RADIUS}
    assert len(close) > 10
    assert got == {k: k - k % 3 if k % 3 < 2 or k in close else k for k in texts}
    assert plain_components(texts) == {k: k - k % 3 for k in texts}


def test_small_stores_give_the_same_ids():
    texts = [" ".join(f"word{i * k} naïve{k}" for i in range(200)) for k in range(20)]
    small, large = bpe.PrefixBpe.load(most=300), bpe.PrefixBpe.load()
    for t in texts:
        assert np.array_equal(small.encode(t), large.encode(t))
    assert len(large.stored) > 1500 and len(small.stored) < 700 and len(small.pieces) < 700
