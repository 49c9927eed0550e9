"""Molecule and reaction structure from strings, as Spark columns: atoms, bonds, hydrogens, charges, colours, keys.

A string is a depth-first walk of its molecule, so one pushdown pass over its tokens gives the bonds: the stack holds
where branches began, the open ring labels wait for their second end. A molecule is a struct of two arrays, which the
expressions below take and give; a row is one molecule or one side of a reaction, so nothing moves between tasks, and
`molecules.TOKEN` limits what a row holds. Values used twice are bound to lambda variables: an optimizer that merges
projections can't make them be computed again.

Aromaticity is what the string says (small letters); rings written with alternating double bonds aren't recognised as
aromatic. A bond without a sign between two aromatic atoms is aromatic (1.5) if it lies in a ring, else single.

Keys are colour refinements. Atoms begin with a hash of element, aromaticity, charge and hydrogens, rounds add the sorted
(order, in a ring, colour) of the neighbours until the number of colours stays; the key hashes the sorted colours, with the
turn of every stereocentre by its neighbours' colours and the side of every double bond's marked ends. Each step looks
at colours only, never at positions, so all spellings of a molecule have one key. Where refinement ends with equal
colours the atoms are alike as far as rounds of neighbours and rings tell; molecules that differ beyond that (regular cages of
equal atoms) share a key, and centres whose neighbours have equal colours are read as having no turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cupola.functions.columns import bound, tokens
from cupola.functions.molecules import ORDERS, VALENCES, is_atom

#: Element, turn, hydrogens, charge and map of a bracket atom.
PARTS = r"^\[[0-9]*([A-Z][a-z]?|[a-z][a-z]?|\*)(@{0,2})(H[0-9]*)?([+]+[0-9]*|-+[0-9]*)?(:[0-9]+)?\]$"
#: Bond orders by sign; an aromatic bond counts one and a half.
SIGNS = {k: 1.5 if k == ":" else float(v) for k, v in ORDERS.items()}
ATOM = "struct<element:string,aromatic:boolean,charge:int,h:int,map:int,turn:int>"
#: Of a bond: its atoms in reading order, its order, the places in the string where each end names it, whether a ring label made it, its mark (/ is 1, \ is -1).
BOND = "struct<a:int,b:int,ord:double,at_a:int,at_b:int,label:boolean,mark:int>"
#: The same of a molecule, with whether the bond lies in a ring.
RINGED = BOND.replace("label", "ring")
MOLECULE = f"struct<atoms:array<{ATOM}>,bonds:array<{RINGED}>>"
_STATE = f"struct<at:int,n:int,prev:int,stack:array<int>,ord:double,mark:int,rings:array<struct<label:int,atom:int,ord:double,at:int>>,roots:array<int>,bonds:array<{BOND}>>"
#: Rounds of an environment of radius 2, as circular fingerprints use, and their bits.
RADIUS, BITS = 2, 2048


def _each(n: Column, body: Callable[[Column], Column]) -> Column:
    """body(i) for i from 0 to n - 1; an empty array for 0."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n), body)


def _at(values: Column, i: Column) -> Column:
    return F.get(values, i)


# --- parsing ----------------------------------------------------------------------------------------------------


def _atom(token: Column) -> Column:
    bracket = token.startswith("[")
    name, turn, hydrogens, sign, number = (F.regexp_extract(token, PARTS, k) for k in range(1, 6))
    symbol, digits = F.when(bracket, name).otherwise(token), F.regexp_extract(sign, "[0-9]+$", 0)
    charge = F.when(sign == "", 0).otherwise(F.when(digits != "", digits.try_cast("int")).otherwise(F.length(sign)) * F.when(sign.startswith("-"), -1).otherwise(1))
    held = F.when(hydrogens == "", 0).when(hydrogens == "H", 1).otherwise(F.substring(hydrogens, 2, 4).try_cast("int"))
    return F.struct(
        F.initcap(symbol).alias("element"), symbol.rlike("^[a-z]").alias("aromatic"), F.when(bracket, charge).otherwise(0).alias("charge"), F.when(bracket, held).alias("h"),
        F.when(bracket, F.substring(number, 2, 9).try_cast("int")).alias("map"), F.when(bracket & (turn != ""), F.when(turn == "@", 1).otherwise(-1)).otherwise(0).alias("turn"),
    ).cast(ATOM)


def _step(s: Column, t: Column) -> Column:
    """One token of the pushdown pass."""
    atom, label, sign = is_atom(t), t.rlike("^[0-9%]"), t.isin(*SIGNS)
    order = F.element_at(F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv]), t)
    number = F.regexp_replace(t, "[%()]", "").try_cast("int")
    open_at = _at(F.filter(s["rings"], lambda r: r["label"] == number), F.lit(0))
    closing = label & open_at.isNotNull()
    made = F.when(atom & (s["prev"] >= 0), F.struct(s["prev"].alias("a"), s["n"].alias("b"), s["ord"].alias("ord"), s["at"].alias("at_a"), F.lit(-1).alias("at_b"), F.lit(False).alias("label"), s["mark"].alias("mark")).cast(BOND))
    made = made.when(closing, F.struct(open_at["atom"].alias("a"), s["prev"].alias("b"), F.coalesce(s["ord"], open_at["ord"]).alias("ord"), open_at["at"].alias("at_a"), s["at"].alias("at_b"), F.lit(True).alias("label"), F.lit(0).alias("mark")).cast(BOND))
    waits = F.struct(number.alias("label"), s["prev"].alias("atom"), s["ord"].alias("ord"), s["at"].alias("at"))
    rings = F.when(closing, F.filter(s["rings"], lambda r: r["label"] != number)).when(label, F.concat(s["rings"], F.array(waits))).otherwise(s["rings"])
    return F.struct(
        (s["at"] + 1).alias("at"), (s["n"] + F.when(atom, 1).otherwise(0)).alias("n"),
        F.when(atom, s["n"]).when(t == ")", F.coalesce(_at(s["stack"], F.size(s["stack"]) - 1), F.lit(-1))).when(t == ".", -1).otherwise(s["prev"]).alias("prev"),
        F.when(t == "(", F.concat(s["stack"], F.array(s["prev"]))).when((t == ")") & (F.size(s["stack"]) > 0), F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)).otherwise(s["stack"]).alias("stack"),
        F.when(sign, order).when(~(atom | label), s["ord"]).alias("ord"), F.when(t == "/", 1).when(t == "\\", -1).when(atom | label | sign, 0).otherwise(s["mark"]).alias("mark"),
        rings.alias("rings"), F.when(atom & (s["prev"] < 0), F.concat(s["roots"], F.array(s["n"]))).otherwise(s["roots"]).alias("roots"),
        F.when(made.isNotNull(), F.concat(s["bonds"], F.array(made))).otherwise(s["bonds"]).alias("bonds"),
    ).cast(_STATE)


def _start() -> Column:
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return F.struct(
        F.lit(1).alias("at"), F.lit(0).alias("n"), F.lit(-1).alias("prev"), none("int").alias("stack"), F.lit(None).cast("double").alias("ord"), F.lit(0).alias("mark"),
        none("struct<label:int,atom:int,ord:double,at:int>").alias("rings"), none("int").alias("roots"), none(BOND).alias("bonds"),
    ).cast(_STATE)


def in_ring(bond: Column, bonds: Column, roots: Column, n: Column) -> Column:
    """Whether a bond lies in a ring: a label made it, or a labelled bond leaves the branch that it leads to.

    Atoms of a branch are numbered without a gap, from its first to the one before the next that hangs on something earlier.
    """
    first = bond["b"]
    after = F.concat(F.transform(F.filter(bonds, lambda x: ~x["label"] & (x["b"] > first) & (x["a"] < first)), lambda x: x["b"]), F.filter(roots, lambda r: r > first), F.array(n))
    inside = lambda v, stop: (v >= first) & (v < stop)
    return bond["label"] | bound(F.array_min(after), lambda stop: F.exists(bonds, lambda x: x["label"] & (inside(x["a"], stop) != inside(x["b"], stop))))


def molecule(smiles: Column) -> Column:
    """The molecule of a readable string (one side of a reaction may hold several, parted by dots); hydrogens of atoms without brackets are not filled in yet. Unreadable strings give what their tokens say."""

    def solved(atoms: Column, s: Column) -> Column:
        both = lambda x: _at(atoms, x["a"])["aromatic"] & _at(atoms, x["b"])["aromatic"]
        ringed = F.transform(s["bonds"], lambda x: F.struct(x.alias("x"), in_ring(x, s["bonds"], s["roots"], s["n"]).alias("ring")))
        order = lambda x, ring: F.coalesce(x["ord"], F.when(both(x) & ring, 1.5).otherwise(1.0))
        bonds = F.transform(ringed, lambda y: F.struct(y["x"]["a"], y["x"]["b"], order(y["x"], y["ring"]).alias("ord"), y["x"]["at_a"], y["x"]["at_b"], y["ring"].alias("ring"), y["x"]["mark"]).cast(RINGED))
        return F.struct(atoms.alias("atoms"), bonds.alias("bonds")).cast(MOLECULE)

    return bound(tokens(smiles), lambda ts: bound(F.transform(F.filter(ts, is_atom), _atom), lambda atoms: bound(F.aggregate(ts, _start(), _step), lambda s: solved(atoms, s))))


def with_hydrogens(mol: Column) -> Column:
    """The molecule with the hydrogens of atoms without brackets filled in: what the lowest valence that their bonds fit leaves free."""
    valences = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in VALENCES.items() for x in kv])

    def filled(m: Column, i: Column) -> Column:
        a = _at(m["atoms"], i)
        used = F.aggregate(F.filter(m["bonds"], lambda x: (x["a"] == i) | (x["b"] == i)), F.when(a["aromatic"], 1).otherwise(0), lambda s, x: s + F.floor(x["ord"]).cast("int"))
        known = F.try_element_at(valences, a["element"])
        # an aromatic atom takes its first valence or none
        free = bound(used, lambda u: F.coalesce(F.when(a["aromatic"], F.greatest(_at(known, F.lit(0)) - u, F.lit(0))).otherwise(F.array_min(F.filter(known, lambda v: v >= u)) - u), F.lit(0)))
        return F.struct(a["element"], a["aromatic"], a["charge"], F.coalesce(a["h"], free).alias("h"), a["map"], a["turn"]).cast(ATOM)

    return bound(mol, lambda m: F.struct(_each(F.size(m["atoms"]), lambda i: filled(m, i)).alias("atoms"), m["bonds"].alias("bonds")).cast(MOLECULE))


# --- neighbourhoods ---------------------------------------------------------------------------------------------


def neighbours(mol: Column) -> Column:
    """For each atom an array of (at, ord, ring, atom): where it names the neighbour, the bond's order, whether in a ring, the neighbour."""
    own = lambda i: F.transform(
        F.filter(mol["bonds"], lambda x: (x["a"] == i) | (x["b"] == i)),
        lambda x: F.struct(F.when(x["a"] == i, x["at_a"]).otherwise(x["at_b"]).alias("at"), x["ord"].alias("ord"), x["ring"].alias("ring"), F.when(x["a"] == i, x["b"]).otherwise(x["a"]).alias("atom")),
    )
    return _each(F.size(mol["atoms"]), own)


def neutral(mol: Column) -> Column:
    """A molecule (hydrogens filled in) with charges removed that a proton balances: +1 on an atom with hydrogen and no negative neighbour, -1 on one without a positive neighbour. All are judged before any changes."""

    def done(m: Column, near: Column, i: Column) -> Column:
        a = _at(m["atoms"], i)
        beside = lambda sign: F.exists(_at(near, i), lambda x: _at(m["atoms"], x["atom"])["charge"] * sign > 0)
        free = ((a["charge"] == 1) & (a["h"] >= 1) & ~beside(-1)) | ((a["charge"] == -1) & ~beside(1))
        return F.struct(a["element"], a["aromatic"], F.when(free, 0).otherwise(a["charge"]).alias("charge"), F.when(free, a["h"] - a["charge"]).otherwise(a["h"]).alias("h"), a["map"], a["turn"]).cast(ATOM)

    return bound(mol, lambda m: bound(neighbours(m), lambda near: F.struct(_each(F.size(m["atoms"]), lambda i: done(m, near, i)).alias("atoms"), m["bonds"].alias("bonds")).cast(MOLECULE)))


def _first_colours(m: Column, near: Column) -> Column:
    return _each(F.size(m["atoms"]), lambda i: bound(_at(m["atoms"], i), lambda a: F.xxhash64(a["element"], a["aromatic"], a["charge"], a["h"], F.size(_at(near, i)))))


def _round(colours: Column, near: Column) -> Column:
    around = lambda i: F.array_sort(F.transform(_at(near, i), lambda x: F.struct(x["ord"].alias("o"), x["ring"].alias("r"), _at(colours, x["atom"]).alias("c"))))
    return F.transform(colours, lambda c, i: F.xxhash64(c, around(i)))


def colours(m: Column, near: Column) -> Column:
    """The atoms' colours after rounds until their number stays."""
    start = bound(_first_colours(m, near), lambda c: F.struct(c.alias("c"), F.lit(False).alias("done")))

    def step(s: Column, _: Column) -> Column:
        turned = bound(_round(s["c"], near), lambda c: F.struct(c.alias("c"), (F.size(F.array_distinct(c)) <= F.size(F.array_distinct(s["c"]))).alias("done")))
        return F.when(s["done"], s).otherwise(turned)

    return F.aggregate(_each(F.size(m["atoms"]), lambda i: i), start, step, lambda s: s["c"])


def _turns(m: Column, near: Column, own: Column) -> Column:
    """(colour, turn) of stereocentres whose neighbours all differ: the turn seen with the neighbours in the order of their colours."""

    def turn(a: Column, i: Column) -> Column:
        hydrogen = F.when(a["h"] == 1, F.array(F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("c")))).otherwise(F.array().cast("array<struct<at:int,c:bigint>>"))
        around = F.transform(F.array_sort(F.concat(hydrogen, F.transform(_at(near, i), lambda x: F.struct(x["at"].alias("at"), _at(own, x["atom"]).alias("c"))))), lambda x: x["c"])

        def sign(seq: Column) -> Column:
            swaps = F.aggregate(_each(F.size(seq), lambda p: p), F.lit(0), lambda n, p: n + F.size(F.filter(F.slice(seq, p + 2, F.size(seq)), lambda y: y < _at(seq, p))))
            clear = (F.size(seq) >= 3) & (F.size(F.array_distinct(seq)) == F.size(seq))
            return F.when(clear, F.struct(_at(own, i).alias("c"), F.when(swaps % 2 == 0, a["turn"]).otherwise(-a["turn"]).alias("t")))

        return F.when(a["turn"] != 0, bound(around, sign))

    found = _each(F.size(m["atoms"]), lambda i: bound(_at(m["atoms"], i), lambda a: turn(a, i)))
    return F.array_sort(F.filter(found, lambda x: x.isNotNull()))


def _sides(m: Column, own: Column) -> Column:
    """(colour, colour, side) of double bonds with marks at both ends: 1 if the ends' foremost neighbours (by colour) lie on one side, -1 if not."""
    other = lambda x, i: F.when(x["a"] == i, x["b"]).otherwise(x["a"])

    def end(i: Column, j: Column) -> Column:
        """The side of i's foremost neighbour other than j, NULL if no mark tells."""
        near = F.filter(m["bonds"], lambda x: ((x["a"] == i) & (x["b"] != j)) | ((x["b"] == i) & (x["a"] != j)))
        seen = F.array_sort(F.transform(near, lambda x: F.struct(_at(own, other(x, i)).alias("c"), F.when(x["a"] == i, x["mark"]).otherwise(-x["mark"]).alias("s"))))

        def told(s: Column) -> Column:
            last, first = F.element_at(s, -1), _at(s, F.lit(0))
            alone = F.when(last["s"] != 0, last["s"])
            return F.when(F.size(s) == 1, alone).when((F.size(s) == 2) & (first["c"] != last["c"]), F.coalesce(alone, F.when(first["s"] != 0, -first["s"])))

        return F.when(F.size(near) > 0, bound(seen, told))

    def side(x: Column) -> Column:
        both = end(x["a"], x["b"]) * end(x["b"], x["a"])
        pair = F.array_sort(F.array(_at(own, x["a"]), _at(own, x["b"])))
        return F.struct(_at(pair, F.lit(0)).alias("c"), _at(pair, F.lit(1)).alias("d"), both.alias("s"))

    # small: only double bonds of molecules with marks are looked at
    double = F.filter(m["bonds"], lambda x: (x["ord"] == 2.0) & F.exists(m["bonds"], lambda y: y["mark"] != 0))
    return F.array_sort(F.filter(F.transform(double, side), lambda x: x["s"].isNotNull()))


def key_of(mol: Column) -> Column:
    """The key of a molecule with its hydrogens filled in: 32 hexadecimal digits, equal for all spellings; maps and isotopes don't count. A molecule without atoms has none."""

    def hashed(m: Column, near: Column, own: Column) -> Column:
        bonds = F.array_sort(F.transform(m["bonds"], lambda x: F.struct(F.least(_at(own, x["a"]), _at(own, x["b"])).alias("a"), F.greatest(_at(own, x["a"]), _at(own, x["b"])).alias("b"), x["ord"].alias("o"))))
        return F.md5(F.to_json(F.struct(F.array_sort(own).alias("atoms"), bonds.alias("bonds"), _turns(m, near, own).alias("turns"), _sides(m, own).alias("sides"))).cast("binary"))

    return bound(mol, lambda m: F.when(F.size(m["atoms"]) > 0, bound(neighbours(m), lambda near: bound(colours(m, near), lambda own: hashed(m, near, own)))))


def environments(mol: Column, radius: int = RADIUS) -> Column:
    """The distinct colours of a molecule's atoms after 0 to `radius` rounds: its circular environments."""

    def rounds(near: Column, now: Column, left: int) -> Column:
        return now if not left else bound(_round(now, near), lambda c: F.concat(now, rounds(near, c, left - 1)))

    return bound(mol, lambda m: bound(neighbours(m), lambda near: bound(_first_colours(m, near), lambda c: F.array_distinct(rounds(near, c, radius)))))


def environment_bits(mol: Column, bits: int = BITS, radius: int = RADIUS) -> Column:
    """The set bits of a molecule's circular fingerprint, ascending."""
    return F.array_sort(F.array_distinct(F.transform(environments(mol, radius), lambda c: F.pmod(c, F.lit(bits)).cast("int"))))


# --- reactions --------------------------------------------------------------------------------------------------


def sides_of(reaction: Column) -> tuple[Column, Column, Column]:
    """(reactants, reagents, products) of a reaction string; what follows a blank is left out."""
    parts = F.split(F.split_part(reaction, F.lit(" "), F.lit(1)), ">")
    return tuple(F.coalesce(F.get(parts, F.lit(k)), F.lit("")) for k in range(3))


def _items(side: Column) -> Column:
    """The molecules of one side, as they are written."""
    return F.filter(F.split(side, r"\."), lambda x: x != "")


def maps_of(mol: Column) -> Column:
    """The atom map numbers of a molecule, repeats included."""
    return F.filter(F.transform(mol["atoms"], lambda a: a["map"]), lambda x: x.isNotNull())


def mapped_bonds(mol: Column) -> Column:
    """(a, b, ord) of bonds between mapped atoms, a <= b; of repeated bonds the last read counts."""
    num = lambda i: _at(mol["atoms"], i)["map"]
    found = F.transform(mol["bonds"], lambda x: F.struct(F.least(num(x["a"]), num(x["b"])).alias("a"), F.greatest(num(x["a"]), num(x["b"])).alias("b"), x["ord"].alias("ord"), (num(x["a"]).isNotNull() & num(x["b"]).isNotNull()).alias("ok")))
    return bound(F.filter(found, lambda x: x["ok"]), lambda all_: F.transform(F.filter(all_, lambda x, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda y: (y["a"] == x["a"]) & (y["b"] == x["b"]))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["ord"].alias("ord"))))


def changed_bonds(reactants: Column, products: Column) -> Column:
    """(a, b, ord) of bonds between mapped atoms whose order after the reaction differs, 0.0 if gone, of those with an atom that stands in the products; sorted."""

    def differing(was: Column, now: Column, held: Column) -> Column:
        new = F.array_except(now, was)
        gone = F.filter(F.array_except(was, now), lambda x: ~F.exists(now, lambda y: (y["a"] == x["a"]) & (y["b"] == x["b"])))
        left = F.transform(gone, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.lit(0.0).alias("ord")))
        return F.array_sort(F.filter(F.concat(new, left), lambda x: F.array_contains(held, x["a"]) | F.array_contains(held, x["b"])))

    return bound(mapped_bonds(reactants), lambda was: bound(mapped_bonds(products), lambda now: bound(maps_of(products), lambda held: differing(was, now, held))))


def mapping_fault(reactants: Column, reagents: Column, products: Column) -> Column:
    """What is inconsistent in the molecules of a reaction's sides, NULL if nothing: repeated map numbers, or atoms of reagents that end up in products."""
    twice = lambda m: bound(maps_of(m), lambda x: F.size(F.array_distinct(x)) < F.size(x))
    return F.when(twice(reactants), "repeated map numbers in reactants").when(twice(products), "repeated map numbers in products").when(F.arrays_overlap(maps_of(reagents), maps_of(products)), "atoms of reagents end up in products")


_LEFT = "array<struct<smi:string,maps:array<int>,key:string,place:int>>"
_SPLIT = f"struct<left:{_LEFT},reactants:array<string>,reagents:array<string>>"


def with_molecules(rows: DataFrame, **strings: str | Column) -> DataFrame:
    """rows with columns of molecules, hydrogens filled in, of string columns or of arrays of strings (arrays of molecules then).

    One step a projection: an expression that nests all steps takes the analyzer far longer, and more rounds than it allows.
    """
    parsed = rows.select("*", *[F.col(c).alias(f"_s_{n}") if isinstance(c, str) else c.alias(f"_s_{n}") for n, c in strings.items()])
    many = {n: parsed.schema[f"_s_{n}"].dataType.typeName() == "array" for n in strings}
    for step, source in ((molecule, "_s_"), (with_hydrogens, "_m_")):
        made = {n: F.transform(f"{source}{n}", step) if many[n] else step(F.col(f"{source}{n}")) for n in strings}
        parsed = parsed.select(*rows.columns, *[c.alias(f"_m_{n}") for n, c in made.items()])
    return parsed.select(*rows.columns, *[F.col(f"_m_{n}").alias(n) for n in strings])


def _listed(strings: str, molecules: str, keys: str) -> Column:
    """(smi, maps, key, place) of the molecules of one side, from three arrays; place is where a molecule's string stands first."""
    all_ = F.col(strings)
    return F.transform(all_, lambda s, i: F.struct(s.alias("smi"), maps_of(_at(F.col(molecules), i)).alias("maps"), _at(F.col(keys), i).alias("key"), (F.array_position(all_, s).cast("int") - 1).alias("place"))).cast(_LEFT)


def _dealt(s: Column, c: Column, held: Column, centre: Column) -> Column:
    """Puts one molecule of the reactants' side where it belongs."""
    changes = F.arrays_overlap(centre, c["maps"])
    spare = (F.size(centre) > 0) & ~F.arrays_overlap(held, c["maps"]) & ~changes
    same = F.filter(s["left"], lambda x: x["key"] == c["key"])
    mapped = F.array_min(F.transform(F.filter(same, lambda x: F.arrays_overlap(x["maps"], c["maps"])), lambda x: x["place"]))
    unmapped = F.array_max(F.transform(F.filter(same, lambda x: F.size(x["maps"]) == 0), lambda x: x["place"]))
    taken = F.when(~spare & ~changes, F.coalesce(mapped, unmapped))
    at = F.array_position(F.transform(s["left"], lambda x: x["place"]), taken)
    without = F.when(taken.isNotNull(), F.filter(s["left"], lambda x, i: i + 1 != at)).otherwise(s["left"])
    reagent = spare | taken.isNotNull()
    add = lambda name, wanted: F.when(wanted, F.concat(s[name], F.array(c["smi"]))).otherwise(s[name]).alias(name)
    return F.struct(without.alias("left"), add("reactants", ~reagent), add("reagents", reagent)).cast(_SPLIT)


def with_reagents(rows: DataFrame, reaction: str) -> DataFrame:
    """rows with (reactants, reagents, products) of their mapped reactions, the spectators told apart by the reaction centre, the atoms of bonds that change.

    Reagents are those named so; in a reaction with a centre, molecules of the reactants' side with no atom in the products or
    the centre; and molecules outside the centre that stand unchanged (same key) among the products, which lose them: one with
    a map number in common, else one without map numbers, the last written first. A product is lost once. Each step is a
    column of the row, so no row moves.
    """
    own = [F.col(c) for c in rows.columns]
    parts = dict(zip(("_left", "_middle", "_right"), sides_of(F.col(reaction)), strict=True))
    steps = rows.select(*own, *[c.alias(n) for n, c in parts.items()]).select("*", *[_items(F.col(n)).alias(f"{n}s") for n in parts])
    steps = with_molecules(steps, _r="_left", _p="_right", _rs="_lefts", _ps="_rights")
    steps = steps.select("*", *[F.transform(n, key_of).alias(f"{n}k") for n in ("_rs", "_ps")], maps_of(F.col("_p")).alias("_held"), changed_bonds(F.col("_r"), F.col("_p")).alias("_changed"))
    steps = steps.select(*own, "_middles", "_held", F.array_distinct(F.flatten(F.transform("_changed", lambda x: F.array(x["a"], x["b"])))).alias("_centre"), _listed("_lefts", "_rs", "_rsk").alias("_in"), _listed("_rights", "_ps", "_psk").alias("_out"))
    start = F.struct(F.col("_out").alias("left"), F.array().cast("array<string>").alias("reactants"), F.col("_middles").alias("reagents")).cast(_SPLIT)
    done = steps.select(*own, bound(F.col("_centre"), lambda c: bound(F.col("_held"), lambda held: F.aggregate("_in", start, lambda s, m: _dealt(s, m, held, c)))).alias("_s"))
    # what is left of the products keeps the order in which their strings stand first
    kept = F.transform(F.array_sort(F.transform("_s.left", lambda x: F.struct(x["place"].alias("place"), x["smi"].alias("smi")))), lambda x: x["smi"])
    return done.select(*own, F.array_join("_s.reactants", ".").alias("reactants"), F.array_join("_s.reagents", ".").alias("reagents"), F.array_join(kept, ".").alias("products"))


def with_summed_bits(rows: DataFrame, side: str, name: str = "bits", bits: int = BITS, radius: int = RADIUS) -> DataFrame:
    """rows with (bit, n), ascending: the sum of the circular fingerprints of the molecules of one side of a reaction."""
    own = [F.col(c) for c in rows.columns]
    steps = with_molecules(rows.select("*", _items(F.col(side)).alias("_items")), _mols="_items")
    steps = steps.select(*own, F.flatten(F.transform("_mols", lambda m: environment_bits(m, bits, radius))).alias("_all"))
    return steps.select(*own, bound(F.col("_all"), lambda found: F.transform(F.array_sort(F.array_distinct(found)), lambda b: F.struct(b.alias("bit"), F.size(F.filter(found, lambda x: x == b)).alias("n")))).alias(name))


def dense(counts: Column, bits: int = BITS) -> Column:
    """A sum of fingerprints as a vector of floats."""
    return bound(F.map_from_entries(counts), lambda m: F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0)).cast("float")))
