"""Molecule measures from reaction-string tokens, as Spark columns.

A molecule's token list is enough for its atoms, bonds and elements: a fragment of n atoms is a tree of n - 1
bonds plus one bond for each ring closure, whose label stands twice. The normal form drops atom maps and isotopes
and the brackets that then say no more than the bare symbol would; it is a string form, equal for equal spelling; keys that
are equal for all spellings are in `structure`. It needs each atom's bonds, so it is a small function of one molecule, run on
Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cupola.functions.columns import TOKEN, bound, tokens

#: Elements that need no bracket, aromatic ones included.
PLAIN = "B|C|N|O|S|P|F|Cl|Br|I|b|c|n|o|s|p"


def is_atom(token: Column) -> Column:
    return token.rlike(rf"^(\[.+\]|{PLAIN}|\*)$")


def element(token: Column) -> Column:
    """The element symbol of an atom token."""
    return F.when(token.startswith("["), F.regexp_extract(token, r"^\[\d*([A-Z][a-z]?|[a-z][a-z]?|\*)", 1)).otherwise(token)


def atoms(smiles: Column) -> Column:
    return F.filter(tokens(smiles), is_atom)


def heavy_atoms(smiles: Column) -> Column:
    """Atoms other than explicit hydrogen."""
    return F.size(F.filter(atoms(smiles), lambda t: element(t) != "H"))


def has_carbon(smiles: Column) -> Column:
    """Aromatic carbon counts; two-letter elements that begin with C don't."""
    return F.exists(atoms(smiles), lambda t: element(t).isin("C", "c"))


def bonds(smiles: Column) -> Column:
    """Bonds between heavy atoms: tree bonds and ring closures. Bracketed hydrogens are merged into their atoms."""
    rings = F.size(F.filter(tokens(smiles), lambda t: t.rlike(r"^(\d|%\d\d|%\(\d{3}\))$")))
    fragments = F.size(F.filter(F.split(smiles, r"\."), lambda x: x != ""))
    return F.greatest(F.lit(0), heavy_atoms(smiles) - fragments) + F.floor(rings / 2).cast("int")


def strip_maps(smiles: Column) -> Column:
    return F.regexp_replace(smiles, r":\d+\]", "]")


def strip_isotopes(smiles: Column) -> Column:
    return F.regexp_replace(smiles, r"\[\d+([A-Za-z*])", "[$1")


#: The valences of elements that need no bracket, and the orders of bond signs.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}
ORDERS = {"-": 1, "/": 1, "\\": 1, "=": 2, "#": 3, "$": 4, ":": 1, "~": 1}
_TOKEN = re.compile(TOKEN)
_BARE = re.compile(r"\[(Cl|Br|[BCNOSPFIbcnosp])(?:H(\d?))?\]")


def plain_brackets(smiles: str) -> str:
    """Brackets that hold an element and hydrogens only go where those hydrogens are what the element has there without a bracket; radicals and the like keep theirs."""
    tokens = _TOKEN.findall(smiles)
    if "".join(tokens) != smiles or not _BARE.search(smiles):
        return smiles
    bonds, open_rings, branches, last, order = [0] * len(tokens), {}, [], None, None
    for i, t in enumerate(tokens):
        if t in ORDERS:
            order = ORDERS[t]
        elif t == "(":
            branches.append(last)
        elif t == ")":
            last = branches.pop() if branches else None
        elif t == ".":
            last = None
        elif t[0] == "%" or t.isdigit():
            other = open_rings.pop(t, None)
            if other is None:
                open_rings[t] = (last, order)
            elif last is not None and other[0] is not None:
                n = order or other[1] or 1
                bonds[last] += n
                bonds[other[0]] += n
            order = None
        elif t[0] == "[" or t in VALENCES or t.upper() in VALENCES or t == "*":
            if last is not None:
                bonds[last] += order or 1
                bonds[i] += order or 1
            last, order = i, None
    for i, t in enumerate(tokens):
        if m := _BARE.fullmatch(t):
            symbol, hydrogens = m[1], 0 if "H" not in t else int(m[2] or 1)
            used = bonds[i] + symbol.islower()  # an aromatic atom gives one more to its ring
            free = [v - used for v in VALENCES[symbol.capitalize()] if v >= used][:1] if symbol[0].isupper() else [max(0, VALENCES[symbol.upper()][0] - used)]
            if hydrogens == (free[0] if free else 0):
                tokens[i] = symbol
    return "".join(tokens)


def _stripped(smiles: str) -> str:
    return re.sub(r"\[\d+([A-Za-z*])", r"[\1", re.sub(r":\d+\]", "]", smiles))


@F.pandas_udf(StringType())
def normal_form(smiles: pd.Series) -> pd.Series:
    """The normal form of a molecule: no maps, no isotopes, no needless brackets."""
    return smiles.map(lambda x: plain_brackets(_stripped(x)), na_action="ignore")


#: The element symbols that a bracket can hold, aromatic ones last.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho "
    "Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og b c n o p s se as te si"
)
BRACKET = r"^\[[0-9]*([A-Z][a-z]?|[a-z][a-z]?|\*)(@[A-Z0-9@]*)?(H[0-9]*)?([+]+[0-9]*|-+[0-9]*)?(:[0-9]+)?\]$"


#: Before any bracket, a character that no token has: such a text isn't all tokens, which shows at its first words.
FOREIGN = r"^[BCNOSPFIbcnospr0-9l()=#+\\/:~@?>*$%.\-]*+[^\[BCNOSPFIbcnospr0-9l()=#+\\/:~@?>*$%.\-]"


def readable(smiles: Column) -> Column:
    """Whether a text has the structure of a molecule: it is all tokens; bracket atoms are well formed, of known elements; branches are balanced and begin after an atom; ring labels are in pairs; bonds join something. Valences and aromaticity aren't judged. NULL and empty texts are not readable."""
    kind = (
        lambda t: F.when(t.startswith("["), F.when(t.rlike(BRACKET) & F.array_contains(F.split(F.lit(ELEMENTS + " *"), " "), element(t)), "a").otherwise("x"))
        .when(t.rlike(rf"^({PLAIN}|\*)$"), "a").when(t.rlike("^[0-9%]"), "r").when(t.isin(*ORDERS), "b").when(t == "(", "o").when(t == ")", "c").when(t == ".", "d").otherwise("x")
    )
    return F.coalesce(~smiles.rlike(FOREIGN) & bound(tokens(smiles), lambda found: _sound(smiles, found, kind)), F.lit(False))


def _sound(smiles: Column, found: Column, kind: Callable[[Column], Column]) -> Column:
    """Whether the tokens found make up the text and stand in a molecule's order."""
    shape = F.array_join(F.transform(found, kind), "")
    # an atom first; an atom, ring label or closed branch last; nothing that hangs on nothing in between
    sound = shape.rlike("^a([abdrco]*[arc])?$") & ~shape.rlike("bb|oc|oo|or|od|bo|bc|bd|dd|do|db|dr|dc")
    depth = F.aggregate(found, F.struct(F.lit(0).alias("now"), F.lit(True).alias("good")), lambda a, t: F.struct((a["now"] + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)).alias("now"), (a["good"] & ~((t == ")") & (a["now"] == 0))).alias("good")), lambda a: a["good"] & (a["now"] == 0))
    rings = F.filter(found, lambda t: t.rlike("^[0-9%]"))
    paired = F.forall(F.array_distinct(rings), lambda r: F.size(F.filter(rings, lambda t: t == r)) % 2 == 0)
    return (F.array_join(found, "") == smiles) & sound & depth & paired


def vector_sum(vectors: Column, size: int) -> Column:
    """The element-wise sum of an array of vectors."""
    return F.aggregate(vectors, F.array_repeat(F.lit(0.0).cast("float"), size), lambda acc, v: F.zip_with(acc, v, lambda a, b: (a + b).cast("float")))
