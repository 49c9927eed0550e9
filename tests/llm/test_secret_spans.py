"""Positions of the entropy spans and redaction against plain Python; cost in proportion to the matches."""

import math
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from cupola.llm import secrets


def kind_of(w):
    h = -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())
    has = lambda p: re.search(p, w) is not None
    reaches = lambda name: h >= secrets.THRESHOLDS[name] - 1e-7
    if not has("[0-9]"):
        return None
    if re.fullmatch("[0-9a-f]*|[0-9A-F]*", w):
        return 3 if has("[a-fA-F]") and reaches("hex") else None
    if not (has("[a-z]") and has("[A-Z]")):
        return 4 if has("[a-zA-Z]") and not has("[+/_=-]") and reaches("single") else None
    return 4 if reaches("base64") else None


def plain_spans(text):
    """Every window by itself; windows of one kind that follow each other or touch make one span."""
    out = []
    for m in re.finditer(secrets.CANDIDATE, text):
        v = m[0]
        spared = [x.span() for p in secrets.ALLOWED for x in re.finditer(p, v)]
        last = None
        for i in range(len(v) - 19):
            kind = kind_of(v[i : i + 20])
            if kind is None or any(a < i + 20 and b > i for a, b in spared):
                continue
            if last and last[2] == kind and i <= last[1]:
                last[1] = i + 20
            else:
                last = [i, i + 20, kind]
                out.append((m.start(), last))
    return sorted(((a + x[0], x[2], a + x[1]) for a, x in out))


def test_entropy_positions_by_brute_force(spark):
    rnd = random.Random(11)
    pools = ["abcdef0123456789", "ABCDEF0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", secrets.ALPHABET, "aaaaab1", "example0", "0123456789"]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            parts.append("".join(rnd.choices(rnd.choice(pools), k=rnd.randint(5, 60))))
            parts.append(rnd.choice(["", " ", " é中 ", "\n", "example", "xxxxxxxx"]))
        texts.append("".join(parts))
    # candidates longer than a block, with changing kinds
    texts.append("".join("".join(rnd.choices(rnd.choice(pools[:5]), k=70)) for _ in range(60)))
    texts.append("".join(rnd.choices(secrets.ALPHABET, k=3 * secrets.BLOCK + 5)))
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    for r, text in zip(rows, texts, strict=True):
        assert [(x.start, x.kind, x.end) for x in r._spans if x.kind >= 3] == plain_spans(text)


def test_redaction_against_slices(spark):
    rnd, cases = random.Random(12), []
    for _ in range(60):
        n = rnd.choice([5, 300, secrets.CHUNK, 3 * secrets.CHUNK + 7])
        text = "".join(rnd.choices("abé中 ", k=n))
        spans = []
        for _ in range(rnd.randint(0, 40)):
            a = rnd.randrange(n)
            spans.append((a, min(n, a + rnd.choice([1, 3, 50, 5000])), 0))
        cases.append((text, sorted(spans)))
    df = spark.createDataFrame(cases, f"text string, spans {secrets.SPAN}").select(secrets.redacted(F.col("text"), F.col("spans")).alias("out"))
    for (text, spans), r in zip(cases, df.collect(), strict=True):
        out, at = "", 0
        for a, b, _ in spans:
            if a >= at:
                out += text[at:a] + secrets.MARK
            at = max(at, b)
        assert r.out == out + text[at:]


def test_running_values(spark):
    sizes = [0, 1, 63, 64, 65, 5000]
    df = spark.createDataFrame([([i % 7 for i in range(n)],) for n in sizes], "v array<int>").select("v", secrets.scanned(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), secrets.scanned(F.col("v"), lambda a, b: F.greatest(a, b), F.lit(0)).alias("m"))
    for r in df.collect():
        assert r.s == [sum(r.v[: i + 1]) for i in range(len(r.v))] and r.m == [max(r.v[: i + 1]) for i in range(len(r.v))]


def test_cost_follows_the_matches(spark):
    """Four times the matches may cost little more than four times the time."""
    def took(n):
        df = spark.createDataFrame([(1, "token=abcdefgh12 " * n, n)], "doc_id int, text string, n_chars int")
        best = math.inf
        for _ in range(2):
            began = time.perf_counter()
            rows = secrets.stage(spark, df, "").collect()
            best = min(best, time.perf_counter() - began)
        assert rows[0].text == "[SECRET] " * n
        return best

    took(100)
    few, many = took(8_000), took(32_000)
    print("seconds", few, many)
    assert many < 7 * few


def test_stage_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "password = hunter2x", 19, "a", "b", "c", "d")], "doc_id int, text string, n_chars long, _base string, _spans string, row string, found string")
    out = secrets.stage(spark, df, "")
    assert out.schema == df.schema
    assert tuple(out.first()) == (1, "[SECRET]", 8, "a", "b", "c", "d")
