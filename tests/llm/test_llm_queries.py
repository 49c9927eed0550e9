"""The package's queries on the smallest tables: against SQL, or against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from cupola.llm import bpe, decontaminate, langid, registry, rans, secrets, simhash, tokenfile
from tests.llm.test_resemblance import plain_components
from tests.oracle import same


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_its_sql(spark, sf, name):
    same(spark, sf, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if re.match(r"op\d+_", n)} == {f"op{i}" for i in range(1, 14)}


def test_op1_against_the_library(spark, sf, docs):
    got = {r.doc_id: r for r in registry.QUERIES["op1_tokens"](spark, sf).collect()}
    lib, start = Tokenizer.from_file(tokenfile.TOKENIZER), 0
    assert set(got) == set(docs)
    for k in sorted(docs):
        ids = np.array([*lib.encode(docs[k].text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op2_against_tiktoken(spark, sf, docs):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder().ranks, special_tokens={})
    got = {r.doc_id: r for r in registry.QUERIES["op2_bpe"](spark, sf).collect()}
    for k, d in docs.items():
        ids = enc.encode_ordinary(d.text or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_op5_held_out_accuracy(spark, sf, docs):
    got = registry.QUERIES["op5_langid"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_op7_base_kinds_against_re(spark, sf, docs):
    got = {r.doc_id: r for r in registry.QUERIES["op7_secrets"](spark, sf).collect()}
    for k, d in docs.items():
        t, found = d.text or "", []
        for kind, pattern, group, least in (("assign", secrets.BASE[0][1], 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)):
            found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, t, re.A) if len(m[group]) >= least]
        order = {"assign": 0, "access": 1, "hex": 2}
        listed = ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(found, key=lambda x: (x[0], order[x[1]])))
        assert got[k].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(sum(x[1] == kind for x in found) for kind in order)
        assert set(filter(None, listed.split(","))) <= set(got[k].spans.split(","))


def brute_components(fps):
    """{fingerprint: smallest fingerprint reachable} by comparing all pairs."""
    values = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 2
    label = np.arange(len(values))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(values))])
        if (new == label).all():
            return {int(v): int(values[i]) for v, i in zip(values, label, strict=True)}
        label = new


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_op10_against_all_pairs(spark, sf, docs):
    got = {r.doc_id: r for r in registry.QUERIES["op10_simhash"](spark, sf).collect()}
    fps = {k: plain_fingerprint(d.text) for k, d in docs.items()}
    root = brute_components(set(fps.values()))
    least = {}
    for k, fp in fps.items():
        least[root[fp]] = min(k, least.get(root[fp], k))
    for k, fp in fps.items():
        assert got[k].fingerprint == f"{fp:016x}"
        assert got[k].component_id == least[root[fp]]


def test_op9_agrees_with_the_labels(spark, sf):
    got = registry.QUERIES["op9_quality"](spark, sf.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet")
    both = got.join(labels, "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in both) >= 0.95 * len(both)


def test_pipeline_against_plain_python(spark, sf, docs):
    """Near-dedup, decontamination, redaction and BPE repeated by brute force on what the language stage kept."""
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in langid.stage(spark, frame, sf).select("doc_id").collect()}
    least = plain_components({k: docs[k].text or "" for k in kept})  # five words, similarity 0.8: the stage's rule
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        words = (r.text or "").encode().translate(decontaminate.LOWERED).split()
        windows |= {tuple(words[i : i + 13]) for i in range(max(1, len(words) - 12))} if words else set()
    sizes = {len(w) for w in windows}
    want = {}
    for k in sorted(set(least.values())):
        words = (docs[k].text or "").encode().translate(decontaminate.LOWERED).split()
        hit = [False] * len(words)
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
        if not (sum(hit) and 20 * sum(hit) >= len(words)):
            want[k] = docs[k].text
    clean = spark.createDataFrame(list(want.items()), "doc_id long, text string")
    scanned = secrets.scan(clean).select("doc_id", secrets.redacted(F.col("text"), F.col("_spans")).alias("text")).collect()
    final = {r.doc_id: bpe.encoder().encode(r.text or "").tolist() for r in scanned}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == final


def test_rans_round_trips_and_checks():
    rng = np.random.default_rng(1)
    for n in (0, 1, 31, 1000, 70_001):
        for sigma in (1, 2, 40_000):
            ids = (rng.zipf(1.4, n) % sigma).astype(np.uint32)
            seg = rans.encode(ids)
            assert (rans.decode(seg) == ids).all()
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (rans.decode_range(seg, a, b) == ids[a:b]).all()
    seg.crcs[0] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        rans.decode(seg)


def test_prefix_bpe_appends_and_edits():
    import random

    bpe_, rnd = bpe.encoder(), random.Random(0)
    letters = list("abcdeéß 12.,'\n\t") + ["  ", "'s", "中"]
    for _ in range(300):
        t = "".join(rnd.choices(letters, k=rnd.randint(0, 40)))
        a = rnd.randint(0, len(t))
        b = rnd.randint(a, len(t))
        new = "".join(rnd.choices(letters, k=rnd.randint(0, 5)))
        assert bpe_.edit(t, bpe_.encode(t), a, b, new).tolist() == bpe_.encode(t[:a] + new + t[b:]).tolist()
        assert bpe_.append(t, bpe_.encode(t), new).tolist() == bpe_.encode(t + new).tolist()
        assert bpe_.decode(bpe_.encode(t)) == t.encode()


def test_fm_index_against_search():
    from cupola.llm.fmindex import FMIndex

    rng = np.random.default_rng(2)
    for sigma, n in ((2, 300), (7, 500), (50, 400), (3, 1)):
        s = rng.integers(0, sigma, n)
        index = FMIndex(s, sigma)
        patterns = np.array([rng.integers(0, sigma, 5) for _ in range(80)])
        lengths = rng.integers(1, 6, 80)
        lo, hi = index.search(patterns, lengths)
        for p, k, a, b in zip(patterns, lengths, lo, hi, strict=True):
            want = [i for i in range(n - k + 1) if (s[i : i + k] == p[:k]).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_vantage_point_links_lose_nothing():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = base[:200, None] ^ (np.uint64(1) << rng.integers(0, 64, (200, 6)).astype(np.uint64))
    points = np.unique(np.concatenate([base, near.ravel()]))
    nodes = simhash.grow(points[::3], 2, 64)
    dealt, shard = simhash.deal(points, nodes, 2)
    links = []
    for s in np.unique(shard):
        own = np.unique(dealt[shard == s])
        links += list(zip(own.tolist(), own[simhash.linked(own, 2)].tolist(), strict=True))
    parent = {int(p): int(p) for p in points}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    assert {p: top(p) for p in parent} == brute_components(set(parent))
    assert len(nodes) > 3


def test_entropy_by_counting(spark):
    import math
    import random

    rnd = random.Random(5)
    chars = "ABCDEFghijkl0123456789abcdef+/_-"
    texts = ["".join(rnd.choices(chars, k=rnd.randint(15, 60))) for _ in range(40)] + ["a1B2" * 12, "0123456789abcdef" * 3]
    rows = secrets.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).collect()
    for r in rows:
        got = {x.kind for x in r._spans if x.kind >= 3}
        want = set()
        for m in re.finditer(secrets.CANDIDATE, r.text):
            v = m[0]
            if not re.search("[0-9]", v) or any(re.search(p, v) for p in secrets.ALLOWED):
                continue
            for i in range(len(v) - 19):
                w = v[i : i + 20]
                h = -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())
                is_hex = all(c in "0123456789abcdef" for c in w)
                mixed = re.search("[0-9]", w) and re.search("[a-z]", w) and (is_hex or re.search("[A-Z]", w))
                if mixed and h >= secrets.THRESHOLDS["hex" if is_hex else "base64"] - 1e-9:
                    want.add(3 if is_hex else 4)
        assert got == want
