"""Structure from strings: bonds, keys over shuffled spellings, neutral forms, reagents, environments, the dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from cupola.functions import structure as S
from cupola.operators import dictionary

# fixed values: reactions and results that any implementation must repeat
MAPPED = "[CH3:14][NH2:15].[N+:1](=[O:2])([O-:3])[c:4]1[cH:5][c:6]([C:7](=[O:8])[OH:9])[cH:10][cH:11][c:12]1[Cl:13].[OH2:16]>>[N+:1](=[O:2])([O-:3])[c:4]1[cH:5][c:6]([C:7](=[O:8])[OH:9])[cH:10][cH:11][c:12]1[NH:15][CH3:14]"
CHANGED = [(12, 13, 0.0), (12, 15, 1.0)]


def molecules(spark, strings):
    return S.with_molecules(spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string"), m="s")


def keys(spark, strings):
    rows = molecules(spark, strings).select("i", "m", S.neutral(F.col("m")).alias("n")).select("i", S.key_of(F.col("m")).alias("k"), S.key_of(F.col("n")).alias("nk"))
    return [(r.k, r.nk) for r in rows.orderBy("i").collect()]


# --- a writer of spellings: a molecule is (symbols, {(a, b): order sign}) ---------------------------------------


def spelled(atoms, bonds, rng):
    """A spelling by a random walk, with random ring labels."""
    near = {i: [] for i in range(len(atoms))}
    for (a, b), sign in bonds.items():
        near[a].append((b, sign))
        near[b].append((a, sign))
    seen, labels, out, free = set(), {}, [], list(range(1, 100))
    rng.shuffle(free)
    order, parent = [], {}

    def visit(i, up):
        seen.add(i)
        order.append(i)
        parent[i] = up
        kids = near[i][:]
        rng.shuffle(kids)
        near[i] = kids
        for j, _ in kids:
            if j not in seen:
                visit(j, i)

    visit(rng.randrange(len(atoms)), None)
    children = {i: [j for j, _ in near[i] if parent.get(j, -1) == i and j != parent[i]] for i in order}
    closures = {frozenset(k) for k in bonds} - {frozenset((i, parent[i])) for i in order if parent[i] is not None}
    text = lambda n: str(n) if n < 10 else f"%{n}"

    def write(i):
        out.append(atoms[i])
        for c in sorted((c for c in closures if i in c), key=lambda c: rng.random()):
            if c not in labels:
                labels[c] = free.pop()
                (j,) = c - {i}
                out.append(bonds.get((i, j), bonds.get((j, i), "")))
            out.append(text(labels[c]))
        kids = children[i]
        for n, j in enumerate(kids):
            branch = n < len(kids) - 1
            out.append("(" * branch + bonds.get((i, j), bonds.get((j, i), "")))
            write(j)
            out.append(")" * branch)

    write(order[0])
    return "".join(out)


def built(rng):
    """A random molecule: rings of six, aromatic or not, and chains, joined at random."""
    atoms, bonds = [], {}
    for _ in range(rng.randint(1, 4)):
        start = len(atoms)
        kind = rng.random()
        if kind < 0.4:
            atoms += ["c"] * 5 + [rng.choice("cn")]
            bonds |= {(start + k, start + (k + 1) % 6): "" for k in range(6)}
        elif kind < 0.6:
            atoms += ["C"] * 5
            bonds |= {(start + k, start + (k + 1) % 5): "" for k in range(5)}
        else:
            atoms += [rng.choice(["C", "O", "N", "S", "C"]) for _ in range(rng.randint(1, 5))]
            bonds |= {(k, k + 1): "" for k in range(start, len(atoms) - 1)}
        if start:
            # to a carbon of what is there that has room
            degree = lambda i: sum(i in k for k in bonds)
            room = [i for i in range(start) if (atoms[i] == "C" and degree(i) < 4) or (atoms[i] == "c" and degree(i) < 3)]
            if not room:
                return built(rng)
            bonds[rng.choice(room), start] = "-" if atoms[start] == "c" else ""
    atoms += ["[O-]", "[13CH3:7]"] if rng.random() < 0.3 and atoms[0] in "C" and sum(0 in k for k in bonds) < 3 else []
    if atoms[-1] == "[13CH3:7]":
        bonds |= {(0, len(atoms) - 2): "", (0, len(atoms) - 1): ""}
    return atoms, bonds


def test_shuffled_spellings_of_1000_molecules_have_one_key(spark):
    rng = random.Random(11)
    made = [built(rng) for _ in range(1000)]
    strings = [spelled(a, b, rng) for a, b in made for _ in range(3)]
    found = [k for k, _ in keys(spark, strings)]
    assert None not in found
    assert all(len(set(found[i : i + 3])) == 1 for i in range(0, len(found), 3))
    # and other molecules have others: sizes and elements never agree under one key
    shape = {}
    for i, k in enumerate(found[::3]):
        shape.setdefault(k, set()).add((len(made[i][1]), tuple(sorted(a.strip("[]:713H+-") or "H" for a in made[i][0]))))
    assert all(len(v) == 1 for v in shape.values()) and len(shape) > 600


@pytest.mark.parametrize(
    "same",
    [
        ["CCO", "OCC", "C(O)C"], ["N[C@@H](C)C(=O)O", "C[C@H](N)C(=O)O", "OC(=O)[C@@H](N)C"], ["F/C=C/F", "F\\C=C\\F", "C(\\F)=C/F"], ["C1CC1", "C%12CC%12", "C-1CC1"], ["[CH3:4][OH:1]", "CO", "O[13CH3]"],
        ["C[C@]1(F)CCO1", "C1CO[C@]1(F)C", "F[C@@]1(C)CCO1"],
    ],
)
def test_spellings_of_one_molecule(spark, same):
    assert len({k for k, _ in keys(spark, same)}) == 1


def test_molecules_apart(spark):
    apart = ["CCO", "COC", "C[C@H](N)C(=O)O", "C[C@@H](N)C(=O)O", "CC(N)C(=O)O", "F/C=C/F", "F/C=C\\F", "FC=CF", "C1CCC2CCCCC2C1", "C1CCC(C1)C1CCCC1", "c1ccccc1", "C1CCCCC1", "CC(=O)[O-]", "CC(=O)O", "[Na+]", "[NaH]"]
    found = [k for k, _ in keys(spark, apart)]
    assert len(set(found)) == len(apart)


def test_neutral_forms(spark):
    pairs = [("CC(=O)[O-]", "CC(=O)O", True), ("[NH3+]CC(=O)[O-]", "NCC(=O)O", True), ("C[N+](=O)[O-]", "CN(O)O", False), ("C[N+](C)(C)C", "CN(C)C", False), ("C[NH+]([O-])C", "CN(O)C", False), ("[O-2]", "O", False), ("c1cc[nH+]cc1", "c1ccncc1", True)]
    found = [nk for _, nk in keys(spark, [s for a, b, _ in pairs for s in (a, b)])]
    assert [found[2 * i] == found[2 * i + 1] for i in range(len(pairs))] == [w for *_, w in pairs]


def test_aromatic_bonds_lie_in_rings(spark):
    rows = molecules(spark, ["c1ccccc1c1ccccc1", "c1ccccc1-c1ccccc1", "c1ccc2ccccc2c1", "Cc1ccccc1"]).orderBy("i").collect()
    orders = [sorted(b.ord for b in r.m.bonds) for r in rows]
    assert orders[0] == orders[1] == [1.0] + [1.5] * 12
    assert orders[2] == [1.5] * 11 and orders[3] == [1.0] + [1.5] * 6


def test_changed_bonds_and_reagents(spark):
    rows = spark.createDataFrame([(MAPPED,), (">>",), ("CCO>>CCO",), ("[CH3:1]O>>[CH3:1]O",), ("(((>x>]]",)], "rxn string")
    left, _, right = S.sides_of(F.col("rxn"))
    got = S.with_molecules(rows.select("rxn", left.alias("l"), right.alias("r")), a="l", b="r").select("rxn", S.changed_bonds(F.col("a"), F.col("b")).alias("c")).collect()
    assert {r.rxn: [tuple(x) for x in r.c] for r in got} == {MAPPED: CHANGED, ">>": [], "CCO>>CCO": [], "[CH3:1]O>>[CH3:1]O": [], "(((>x>]]": []}
    split = {r.rxn: r for r in S.with_reagents(rows, "rxn").collect()}
    assert split[MAPPED].reagents == "[OH2:16]" and split[MAPPED].products == MAPPED.split(">")[2]
    assert split[MAPPED].reactants == MAPPED.split(".[OH2")[0]
    # no centre, and what stands on both sides is a reagent once
    assert tuple(split["CCO>>CCO"])[1:] == ("", "CCO", "")
    assert tuple(split[">>"])[1:] == ("", "", "")


def test_products_are_lost_once(spark):
    rxn = "[CH2:1]=[CH2:2].O.[OH2:9].[OH2:9]>N>[CH3:1][CH3:2].[OH2].O.[OH2:9]"
    r = S.with_reagents(spark.createDataFrame([(rxn, 5)], "rxn string, _x int"), "rxn").first()
    # unmapped water has no atom in the products; of two waters of one number one is the product's, the next takes an unmapped one, the last written first
    assert (r["_x"], r.reactants, r.reagents, r.products) == (5, "[CH2:1]=[CH2:2]", "N.O.[OH2:9].[OH2:9]", "[CH3:1][CH3:2].[OH2]")


def test_mapping_faults(spark):
    rows = spark.createDataFrame([("[C:1][C:1]>>C",), ("C>>[C:2].[C:2]",), ("[C:1]>[C:3]>[C:3][C:1]",), (MAPPED,)], "rxn string")
    steps = S.with_molecules(rows.select("rxn", *[c.alias(n) for c, n in zip(S.sides_of(F.col("rxn")), "lmr")]), a="l", b="m", c="r")
    found = [r[0] for r in steps.select(S.mapping_fault(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert [x and x.split()[0] for x in found] == ["repeated", "repeated", "atoms", None]


def environments(atoms, bonds, radius):
    """Circular environments as nested tuples, in plain Python."""
    near = {i: [(s, b if a == i else a) for (a, b), s in bonds.items() if i in (a, b)] for i in range(len(atoms))}
    now = [(atoms[i], len(near[i])) for i in near]
    all_ = set(now)
    for _ in range(radius):
        now = [(now[i], tuple(sorted((s, now[j]) for s, j in near[i]))) for i in near]
        all_ |= set(now)
    return all_


def test_environments_by_brute_force(spark):
    rng = random.Random(2)
    made = []
    while len(made) < 60:
        n = rng.randint(1, 12)
        atoms = [rng.choice(["C", "O", "N", "S"]) for _ in range(n)]
        bonds = {(rng.randrange(i), i): "" for i in range(1, n)}
        # hydrogens follow from element and degree while no atom is over its valence
        if all(sum(i in k for k in bonds) <= {"C": 4, "N": 3, "O": 2, "S": 2}[a] for i, a in enumerate(atoms)):
            made.append((atoms, bonds))
    for radius in (0, 1, 2):
        rows = molecules(spark, [spelled(a, b, rng) for a, b in made]).select("i", F.size(S.environments(F.col("m"), radius)).alias("n")).orderBy("i").collect()
        assert [r.n for r in rows] == [len(environments(a, b, radius)) for a, b in made]


def test_summed_fingerprints(spark):
    rows = spark.createDataFrame([("CCO.OCC.O",), ("CCO",), ("O",), ("",)], "s string")
    found = {r.s: {x.bit: x.n for x in r.bits} for r in S.with_summed_bits(rows, "s").collect()}
    assert found[""] == {}
    assert found["CCO.OCC.O"] == {b: 2 * found["CCO"].get(b, 0) + found["O"].get(b, 0) for b in found["CCO"] | found["O"]}
    vector = S.with_summed_bits(rows, "s").where("s = 'CCO.OCC.O'").select(S.dense(F.col("bits")).alias("v")).first().v
    assert len(vector) == 2048 and sum(vector) == sum(found["CCO.OCC.O"].values())


def test_dictionary(spark):
    strings = ["OCC", "CCO", "C(O)C", "CCO", "O", "O", "[13CH4]", "C1CC", "", None, "OCC", "CC(=O)[O-]"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, smi string")
    known = dictionary.measured(rows)
    by = {r.smi: r for r in known.collect()}
    assert {s: r.n for s, r in by.items()} == {"OCC": 2, "CCO": 2, "C(O)C": 1, "O": 2, "[13CH4]": 1, "C1CC": 1, "": 1, "CC(=O)[O-]": 1}
    assert {by[s].form for s in ("OCC", "CCO", "C(O)C")} == {"CCO"} and len({by[s].number for s in ("OCC", "CCO", "C(O)C")}) == 1
    assert by["[13CH4]"].form == "C" and by["C1CC"].form is None and by[""].key is None
    assert (by["CC(=O)[O-]"].heavy, by["CC(=O)[O-]"].bonds, by["CC(=O)[O-]"].carbon, by["CC(=O)[O-]"].n_tokens) == (4, 3, True, 7)
    want = sorted((r.i, by[r.smi].form if r.smi is not None else None) for r in rows.collect())
    rows = rows.withColumnRenamed("smi", "text")
    for few, hot in ((100, 100), (0, 100), (0, 1), (0, 0)):
        assert sorted((r.i, r.form) for r in dictionary.joined(rows, known, "text", few, hot).collect()) == want
