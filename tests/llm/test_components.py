"""Components: the same ones by tasks and by rounds, few tables, no work where nothing is found."""

import random

import pytest

from cupola.llm import resemblance, simhash


def roots(edges):
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        top[b] = a
    return {x: root(x) for x in top if root(x) != x}


def graph(n):
    rnd = random.Random(n)
    path = [(k, k + 1) for k in range(n)]
    hub = [(-5, 1_000 + k) for k in range(n)]
    loose = [(10_000 + rnd.randrange(2 * n), 10_000 + rnd.randrange(2 * n)) for _ in range(n)]
    edges = path + hub + loose + path[:20] + [(7, 7)]
    rnd.shuffle(edges)
    return edges


@pytest.fixture
def tables(monkeypatch):
    """The names of the tables that are written."""
    names, write = [], simhash.stored
    for module in (simhash, resemblance):
        monkeypatch.setattr(module, "stored", lambda df, name: names.append(name) or write(df, name))
    return names


@pytest.mark.parametrize("chunk", [7, 60, 100_000])
def test_components_of_any_chunk(spark, tables, chunk):
    edges = graph(90)
    got = simhash.components(spark.createDataFrame(edges, "u long, v long"), "star", chunk).collect()
    assert len(got) == len({r.u for r in got}) and {r.u: r.v for r in got} == roots(edges)
    if chunk > len(edges):  # rounds of large and small stars wrote five tables or more, four more a round
        assert len(tables) <= 2


def test_components_of_keys(spark):
    edges = [(bytes([a % 256, 255 - a % 7]), bytes([b % 256, 255 - b % 7])) for a, b in graph(50)]
    for chunk in (9, 1_000):
        got = simhash.components(spark.createDataFrame([(bytearray(u), bytearray(v)) for u, v in edges], "u binary, v binary"), "star", chunk).collect()
        assert {bytes(r.u): bytes(r.v) for r in got} == roots(edges)


def test_no_edges(spark):
    assert simhash.components(spark.createDataFrame([(3, 3)], "u long, v long")).count() == 0


def test_near_copies_write_few_tables(spark, tables):
    """Tables, each of a file a task at least, and tasks are what a large group of near copies costs; 61 tables before, 25 now."""
    rnd, texts = random.Random(4), []
    base = [f"w{k}" for k in range(120)]
    for k in range(60):
        words = list(base)
        words[rnd.randrange(120)] = f"new{k}"
        texts.append((k, " ".join(words)))
    found = resemblance.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.component for r in found} == {0}
    assert len(tables) <= 28, tables
