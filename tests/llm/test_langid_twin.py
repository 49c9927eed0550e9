"""Language ID against a small version in plain Python: sets of strings, one system of equations a language."""

import random
import struct

import numpy as np
import pytest
import xxhash

from cupola.llm import langid


def plain_grams(text):
    """Letter n-grams of up to three characters; other characters are one blank a run."""
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in t:
        t = t.replace("  ", " ")
    return {g for n in (1, 2, 3) for i in range(len(t) - n + 1) if (g := t[i : i + n]).strip() and not (n == 1 and g == " ")} | ({" " + c for c in ()})


def plain_model(rows, landmarks):
    sets = [(lang, plain_grams(t)) for lang, t in rows if any(c.isalpha() for c in t)]
    langs = sorted({lang for lang, _ in sets})
    each = max(1, landmarks // len(langs))
    marks = [x for lang in langs for x in [s for other, s in sets if other == lang][:each]]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    own = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(own)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    phi = np.array([[kernel(x, m) for m in marks] for _, x in sets]) @ root
    number = {lang: sum(other == lang for other, _ in sets) for lang in langs}
    solved = []
    for lang in langs:
        left, right = langid.RIDGE * np.eye(phi.shape[1]), np.zeros(phi.shape[1])
        for (other, _), row in zip(sets, phi, strict=True):
            left += np.outer(row, row) / number[other]
            right += row * (1 if other == lang else -1) / number[other]
        solved.append(root @ np.linalg.solve(left, right))

    def predict(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        x = plain_grams(text)
        f = [sum(kernel(x, m) * w for m, w in zip(marks, ws, strict=True)) for ws in solved]
        return langs[int(np.argmax(f))], min(1.0, max(0.0, (max(f) + 1) / 2))

    return predict


def test_predictions_equal_the_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.sample(docs, 40)
    predict = plain_model(rows, 24)
    got = langid.identify(docs, langid.learn(rows, 24)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        lang, score = predict(texts[r.id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6


def test_the_sample_is_the_first_of_a_hash_order(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(3000), "".join(rnd.choices("abcd ", k=rnd.randint(1, 30))), rnd.choice(["x", "x", "y", None])) for _ in range(2000)]
    rows += rows[:500]  # repeated rows are learned once
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    import zlib

    hash_of = lambda r: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(r[1].encode(), xxhash.xxh64_intdigest(struct.pack("<q", r[0]), 42))))[0]
    want = []
    usable = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    for lang in ("x", "y"):
        own = [r for r in usable if r[2] == lang]
        near = sorted({(hash_of(r), r[1]) for r in own if ((hash_of(r) % 2**64) >> 1) / 2**63 < 2 * 50 / len(own)})
        want += [(lang, t) for _, t in near[:50]]
    assert langid.sample(docs.repartition(3), 50) == want
    assert sum(len(t) for _, t in langid.sample(docs, 50, most_bytes=400)) <= 400
    assert len(langid.sample(docs, 50, most_rows=20)) == 20


def test_more_than_a_hundred_letters_are_told_apart(spark):
    """Two languages whose letters are 400 ideographs each, and share none: one symbol for all of them would know nothing."""
    rnd = random.Random(2)
    pools = {"a": [chr(0x4E00 + i) for i in range(400)], "b": [chr(0x5E00 + i) for i in range(400)]}
    text = lambda k: "".join(rnd.choices(pools[k], k=60))
    model = langid.learn([(k, text(k)) for k in "ab" for _ in range(60)], 40)
    langs, _, _ = model.score([text(k) for k in "ab" * 20])
    assert langs == list("ab" * 20)
    assert len({c for g in model.known.tolist() if g < 1 << 21 for c in [g]}) > 126 * 2


@pytest.mark.parametrize("text", ["", "a", "Ab c", "--", "ß é 中文字", "x" * 5000, "the quick brown fox 123 jumps"])
def test_grams_are_those_of_the_text(text):
    found = langid.Grams().distinct(text)
    if found is None:
        assert not any(c.isalpha() for c in text)
        return
    def shown(g):
        out = ""
        while g:
            out = (" " if g & 0x1FFFFF == 1 else chr(g & 0x1FFFFF)) + out
            g >>= 21
        return out
    assert len(found) == len(set(found.tolist()))
    assert {shown(g) for g in found.tolist()} == plain_grams(text)
