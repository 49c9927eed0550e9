"""Readable molecules, brackets that may go, reaction tokens, days, and a hot key's fold in slices."""

import random

import pytest
from pyspark.sql import functions as F

from cupola.functions import columns as C
from cupola.functions import molecules as M
from cupola.operators import dedup
from cupola.plans import jobs
from tests.test_columns import NITRO, R1, one
from tests.test_operators import fold

GOOD = [NITRO, "CCO", "[CH3:1][OH:2]", "C1CC1", "C%12CC%12", "c1ccccc1", "F/C=C/F", "[Na+].[Cl-]", "*C", "[13C@@H](F)(Cl)Br", "C(C)(C)C", "[nH]1cccc1", "[O-][N+](=O)C", "C=1CC1"]
BAD = ["", "Chelloworldonion", "wonderfulCocoon", "C(C", "C)C", "C1CC", "C==C", "C=", "=C", "C()C", "(C)C", "C..C", "[Xx]", "[C", "C(=)C", "C>C", "1CC1", "C@C", "C+", "C((C))C", "[CHx]"]


def test_readable(spark):
    df = spark.createDataFrame([(x,) for x in [*GOOD, *BAD, None]], "x string")
    got = {r.x: r.y for r in df.select("x", M.readable(F.col("x")).alias("y")).collect()}
    assert [x for x in GOOD if not got[x]] == []
    assert [x for x in [*BAD, None] if got[x]] == []


@pytest.mark.parametrize("text,want", [
    ("[O]", "[O]"), ("[OH]", "[OH]"), ("[OH2]", "O"), ("[CH2]", "[CH2]"), ("[C]", "[C]"), ("[CH4]", "C"), ("C[CH2]C", "CCC"), ("C[CH]C", "C[CH]C"), ("[CH2]=[CH2]", "C=C"),
    ("[19F][13C@H]([16OH])[35Cl]", "F[C@H](O)Cl"), ("[cH:1]1[cH:2][cH:3][cH:4][cH:5][c:6]1[Cl:7]", "c1ccccc1Cl"), ("c1cc[nH]c1", "c1cc[nH]c1"), ("C[N]C", "C[N]C"), ("C[NH]C", "CNC"),
    ("CS(=O)(=O)[OH]", "CS(=O)(=O)O"), ("[C:1]#[N:2]", "[C]#N"), ("[CH:1]#[N:2]", "C#N"), ("nonsense", "nonsense"),
])
def test_brackets_that_say_something_stay(spark, text, want):
    assert one(spark, text, M.normal_form) == want


def test_reaction_tokens_and_long_days(spark):
    assert one(spark, "C>>O", C.token_text) == "C > > O"
    assert one(spark, "20190704" + "0" * 2000, lambda c: C.date_parts(c)[2]) is None
    assert one(spark, "2019070", lambda c: C.date_parts(c)[2]) == 0


def test_unreadable_reactions_get_no_key(spark):
    rows = ["Chelloworldonion>>wonderfulCocoon", R1, "CC.[O]>>CCO", "CC.O>>CCO", "C1CC>>C", "CC>O>CCO |x|", "O.C[CH3:4]>>OCC", ">>", None, "no reaction"]
    made = jobs.canonical(spark.createDataFrame([(x, 1) for x in rows], "smiles string, left int"))
    assert made.columns == ["smiles", "left", "reactants", "products", "key", "first_failure"]
    by = {r.smiles: r for r in made.collect()}
    got = [by[x].key for x in rows]
    assert got[6] == got[3]  # other spellings of the same molecules
    assert got[7:] == [">>", None, None] and by[">>"].first_failure and by["no reaction"].first_failure is None
    assert got[0] is None and got[4] is None
    assert got[1].endswith("NC") and ":" not in got[1]
    assert got[2] == "CC.[O]>>CCO" and got[3] == got[5] == "CC.O>>CCO"


@pytest.mark.parametrize("span", [1, 3, 50, 10_000])
def test_fold_of_a_hot_key_in_slices(spark, span):
    rnd, rows, ord_ = random.Random(span), [], 0
    for k, n in [(f"k{i}", rnd.randint(1, 9)) for i in range(40)] + [("hot", 900), ("early", 300)]:
        for _ in range(n):
            rows.append((k, ord_, rnd.choice([None, None, "a"]), rnd.choice([None, 1, 2, 3, 4, 5]) if k != "early" else rnd.choice([9, 9, 9, 8 - (ord_ % 7)])))
            ord_ += rnd.randint(1, 3)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2] is not None, r[3]))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, ord long, name string, year int").repartition(5)
    assert sorted(r.ord for r in dedup.survivors(df, "k", "ord", "name", "year", span).collect()) == sorted(fold(v)[0] for v in by.values())
