"""Keys of one letter case, and keys next to placeholders."""

import random

import pytest

from cupola.llm import secrets

ALPHABETS = {"base36": "abcdefghijklmnopqrstuvwxyz0123456789", "BASE36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "HEX": "0123456789ABCDEF"}


def spans(spark, texts):
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    return [[(x.start, x.end, x.kind) for x in r._spans] for r in rows]


@pytest.mark.parametrize("name", ALPHABETS)
def test_keys_of_one_case_are_found(spark, name):
    rnd = random.Random(9)
    keys = ["".join(rnd.choices(ALPHABETS[name], k=40)) for _ in range(30)]
    for found, key in zip(spans(spark, [f"see {k} here" for k in keys]), keys, strict=True):
        assert found and sum(b - a for a, b, _ in found) >= 30, key
        assert {k for _, _, k in found} == {3 if name == "HEX" else 4}


def test_only_windows_over_a_placeholder_are_spared(spark):
    key = "kQ7xZp2LmV9sTb4RwY8nHc3F"
    found = spans(spark, [f"example/{key}", f"{key}-placeholder", "example/example/example/1", "0123456789abcdef" * 3, "d41d8cd98f00b204e9800998ecf8427e", "your-api-key-goes-1n-here"])
    assert any(a <= 8 and b == 32 for a, b, k in found[0] if k == 4)
    assert any(a == 0 and b >= 24 for a, b, k in found[1] if k == 4)
    assert [[x for x in f if x[2] > 2] for f in found[2:]] == [[], [], [], []]


def test_slugs_and_numbers_stay(spark):
    found = spans(spark, ["/2023/10/the-quick-brown-fox-jumps-over", "12345678901234567890123456", "section_12_of_the_long_manual"])
    assert [[x for x in f if x[2] > 2] for f in found] == [[], [], []]
