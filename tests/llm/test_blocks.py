"""A benchmark in several blocks and word groups gives what one pass gives, and documents are indexed once a group."""

import random

import pytest

from cupola.llm import decontaminate


@pytest.mark.parametrize("vocabulary,builds", [(10_000, 1), (100, None)])
def test_blocks_and_groups(spark, monkeypatch, vocabulary, builds):
    rnd = random.Random(6)
    word = lambda: f"{rnd.choice(['W', 'é', 'x'])}{rnd.randrange(40)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 2, 5, 13, 20])))) for i in range(30)] + [(None, None), (1, "again W1")]
    docs = []
    for i in range(120):
        own = [word() for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(own))
            own[at:at] = (rnd.choice(items)[1] or "").split()
        docs.append((i // 2, " - ".join(own)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    calls = []
    indexed = decontaminate._indexed
    monkeypatch.setattr(decontaminate, "_indexed", lambda *a: calls.append(1) or indexed(*a))
    key = lambda df: sorted(str(r) for r in df.select("id", "n_words", "n_hit", "items", "spans").collect())
    one = key(decontaminate.contamination(frame, bench))
    many = key(decontaminate.contamination(frame, bench, block_words=300, vocabulary=vocabulary))
    assert one == many
    assert len(calls) == builds if builds else len(calls) > 1
    bare = decontaminate.contamination(frame, bench, block_words=300, spans=False)
    assert sorted((r.id, r.n_words, r.n_hit, str(r["items"])) for r in bare.collect()) == sorted((r.id, r.n_words, r.n_hit, str(r["items"])) for r in decontaminate.contamination(frame, bench).collect())
