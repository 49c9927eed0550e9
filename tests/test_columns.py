"""Golden vectors (fixed values: what any implementation must give) and small cases of the column functions."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cupola.functions import columns as C
from cupola.functions import molecules as M
from cupola.functions import structure as S

R1 = "[CH3:14][NH2:15].[N+:1](=[O:2])([O-:3])[c:4]1[cH:5][c:6]([C:7](=[O:8])[OH:9])[cH:10][cH:11][c:12]1[Cl:13].[OH2:16]>>[N+:1](=[O:2])([O-:3])[c:4]1[cH:5][c:6]([C:7](=[O:8])[OH:9])[cH:10][cH:11][c:12]1[NH:15][CH3:14]"
NITRO = "O=C(O)c1cc([N+](=O)[O-])c(Sc2c(Cl)cncc2Cl)s1"


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("code,want", [(c, True) for c in ("3.1", "3.1.2", "6.3.4.2", "2.1", "2.1.3", "3.1.4", "2.1.127.21342")] + [(c, False) for c in ("3.2", "2.2", "6.3.4.1", "5", "3.10", None)])
def test_class_set_is_hierarchical(spark, code, want):
    assert one(spark, code, lambda c: C.in_class_set(c, ["3.1", "3.1.2", "6.3.4.2", "2.1", "2.1.3"])) is want


@pytest.mark.parametrize("text,want", [("3", 3), ("unk", None), ("3.7", None), (None, None), ("", None), ("1_99", None)])
def test_cast_int(spark, text, want):
    assert one(spark, text, C.cast_int) == want


def test_strict_cast_fails_the_job(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, "3.7", lambda c: C.cast_int(c, strict=True))


@pytest.mark.parametrize("d,want", [("2019", (2019, None, None)), ("201907", (2019, 7, None)), ("20190704", (2019, 7, 4)), ("", (None, None, None)), (None, (None, None, None)), ("199", (None, None, None))])
def test_date_parts(spark, d, want):
    assert tuple(one(spark, d, lambda c: F.array(*C.date_parts(c)))) == want


def test_core_title(spark):
    assert one(spark, "US123_A1_x", C.core_title) == "US123"
    assert one(spark, "unk", C.core_title) is None
    assert one(spark, "", C.core_title) is None


def test_multisets_match_counters(spark):
    rnd = random.Random(3)
    cases = [[rnd.choice(["C", "CC", "", "Cl", "é"]) for _ in range(rnd.randint(0, 9))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x array<string>").select("i", C.multiset(F.col("x")).alias("m"), C.expand(C.multiset(F.col("x"))).alias("e"), C.multiset_add(C.multiset(F.col("x")), C.multiset(F.col("x"))).alias("d"))
    for r in df.collect():
        want = Counter(x for x in cases[r.i] if x)
        assert {m.smi: m.n for m in r.m} == want
        assert r.e == sorted(want.elements())
        assert {m.smi: m.n for m in r.d} == want + want


def test_multisets_less_others_and_repeats(spark):
    rnd = random.Random(5)
    pick = lambda: [rnd.choice(["C", "CC", "", "Cl", "é"]) for _ in range(rnd.randint(0, 9))]
    cases = [(i, pick(), pick()) for i in range(60)] + [(60, ["C"], None), (61, None, ["C"])]
    ms = lambda c: C.multiset(F.col(c))
    df = spark.createDataFrame(cases, "i int, x array<string>, y array<string>").select("i", C.multiset_minus(ms("x"), ms("y")).alias("d"), C.has_repeats(C.expand(ms("x"))).alias("r"))
    for r, (_, x, y) in zip(sorted(df.collect()), cases, strict=True):
        if x is None or y is None:
            assert r.d is None
            continue
        one, other = Counter(v for v in x if v), Counter(v for v in y if v)
        assert [(m.smi, m.n) for m in r.d] == sorted((one - other).items())
        assert r.r == any(n > 1 for n in one.values())


def test_jsonl_round_trip(spark):
    text = "C1COCCO1.C[C@H](N[S@](=O)C(C)(C)C)c1cc2cc(Cl)ccc2nc1Cl.Cl.Cl>>C[C@H](N)c1cc2cc(Cl)ccc2[nH]c1=O.Cl.Cl"
    df = spark.createDataFrame([(text,)], "x string").select(F.split("x", ">>").alias("s")).select(C.side(F.col("s")[0]).alias("r"), C.side(F.col("s")[1]).alias("p"))
    df = df.withColumn("key", C.reaction_key(F.col("r"), F.col("p"))).withColumn("line", C.to_jsonl(F.col("r"), F.col("p"), F.col("key"), 1))
    row = df.select("*", C.reaction_key(*C.from_jsonl(F.col("line"))).alias("back"), C.to_smiles(F.col("r"), F.col("p"), F.col("key"), 1).alias("s2")).first()
    assert row.back == row.key
    assert sorted(json.loads(row.line)["translation"]["reactants"].split(".")) == sorted(text.split(">>")[0].split("."))
    assert [sorted(x.split(".")) for x in row.s2.split(">>")] == [sorted(x.split(".")) for x in text.split(">>")]


@pytest.mark.parametrize("text", ["", "unk", "A>B", None, "   "])
def test_bad_reactions_are_null(spark, text):
    assert one(spark, text, lambda c: C.clean_reaction(c)[0]) is None


def test_reagents_join_the_reactants(spark):
    got = spark.createDataFrame([("CC.O>Cl.O>CCO |f:1|",)], "x string").select(C.reaction_key(*C.clean_reaction(F.col("x"))).alias("k")).first().k
    assert got == "CC.Cl.O.O>>CCO"


def test_tokens(spark):
    assert one(spark, NITRO, C.token_text).startswith("O = C ( O ) c 1 c c ( [N+]")
    assert one(spark, NITRO, C.token_text).replace(" ", "") == NITRO
    assert one(spark, "CXC", C.token_text) is None
    assert one(spark, "C%12C%(123)C", C.tokenizes) is True


def test_atom_maps(spark):
    assert set(one(spark, "[C:14][C:12](C)([C:1])", C.atom_maps)) == {1, 12, 14}


def test_molecule_measures(spark):
    assert one(spark, NITRO, M.heavy_atoms) + one(spark, "CCC(=O)O", M.heavy_atoms) == 25
    assert max(one(spark, s, M.bonds) for s in ("CC", NITRO, "CCC(=O)O")) == 21
    assert [one(spark, s, M.has_carbon) for s in (NITRO, "Cl", "O=O", "[Ca+2]", "[13cH]")] == [True, False, False, False, True]


def test_normal_form(spark):
    assert one(spark, "[19F][13CH2:3][35Cl]", M.normal_form) == "FCCl"


def test_fingerprint(spark):
    # fixed values: 2048 places, some set
    found = S.with_summed_bits(spark.createDataFrame([(NITRO,)], "s string"), "s").select(S.dense(F.col("bits")).alias("v")).first().v
    assert len(found) == 2048
    assert 0 < sum(found) < 2048
    total = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "v array<array<float>>").select(M.vector_sum(F.col("v"), 2).alias("t")).first().t
    assert total == [4.0, 6.0]
