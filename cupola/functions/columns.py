"""Scalar pieces of the splitting engine as Spark columns: titles, dates, multisets, export strings, tokens, class codes, seeded order.

Unknown values are NULL everywhere (the `unk` of the raw records is normalised at ingest).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unk"
#: Fixed value: the token pattern of reaction strings (Schwaller et al. 2018, Chemical Science 9, 6091, with ring labels of three digits), in its own order.
TOKEN = r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>|\*|\$|\%[0-9]{2}|\%\([0-9]{3}\)|[0-9])"
MULTISET = "array<struct<smi:string,n:int>>"


def known(c: Column) -> Column:
    """NULL for the unknown sentinel and the empty string."""
    return F.when((c != UNKNOWN) & (c != ""), c)


def cast_int(c: Column, strict: bool = False) -> Column:
    """An integer, NULL where unknown. Otherwise text that is no plain number is NULL, or fails the job if strict."""
    value = F.when(c != UNKNOWN, c)
    if strict:
        return value.cast("int")
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("int"))


def date_parts(c: Column) -> tuple[Column, Column, Column]:
    """(year, month, day) of a YYYY, YYYYMM or YYYYMMDD text; what is missing is NULL."""
    n = F.length(c)
    return (
        cast_int(F.when(n >= 4, F.substring(c, 1, 4))),
        cast_int(F.when(n >= 6, F.substring(c, 5, 2))),
        cast_int(F.when(n > 6, F.substring(c, F.lit(7), n))),
    )


def core_title(c: Column) -> Column:
    """The text before the first underscore; NULL for unknown titles."""
    return F.substring_index(known(c), "_", 1)


def author_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"^\s+|\s+$", "")


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it: a lambda's variable is a value, not an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def multiset(items: Column) -> Column:
    """Distinct non-empty items with their counts, sorted: equal multisets are equal values. NULL stays NULL."""
    count = lambda kept: F.transform(F.sort_array(F.array_distinct(kept)), lambda x: F.struct(x.alias("smi"), F.size(F.filter(kept, lambda y: y == x)).alias("n")))
    return bound(F.filter(items, lambda x: x != ""), count)


def multiset_add(a: Column, b: Column) -> Column:
    return multiset(F.concat(expand(a), expand(b)))


def multiset_minus(a: Column, b: Column) -> Column:
    """What is left of a when b is taken away, each item as often as it counts more in a than in b (the positive part). NULL if either is."""
    left = lambda held: F.filter(F.transform(a, lambda x: F.struct(x["smi"].alias("smi"), (x["n"] - F.coalesce(F.try_element_at(held, x["smi"]), F.lit(0))).alias("n"))), lambda x: x["n"] > 0)
    return F.when(b.isNotNull(), bound(F.map_from_entries(b), left))


def expand(ms: Column) -> Column:
    """The items of a multiset, each as often as it counts, in order."""
    return F.flatten(F.transform(ms, lambda x: F.array_repeat(x["smi"], x["n"])))


def side(text: Column) -> Column:
    """The multiset of one side of a reaction string."""
    return multiset(F.split(text, r"\."))


def reaction_key(reactants: Column, products: Column) -> Column:
    """The canonical key `a.a.b>>c` of two multisets."""
    return F.concat(F.array_join(expand(reactants), "."), F.lit(">>"), F.array_join(expand(products), "."))


def reaction_molecules(text: Column) -> tuple[Column, Column]:
    """(reactants, products) molecules, as arrays, of `reactants>reagents>products[ suffix]`; reagents join the reactants. NULL where the text isn't one."""
    first = F.get(F.split(F.regexp_replace(text, r"^\s+", ""), r"\s+"), F.lit(0))
    parts = F.split(first, ">")
    good = (first != "") & (F.size(parts) == 3)
    molecules = lambda i: F.filter(F.split(F.get(parts, F.lit(i)), r"\."), lambda x: x != "")
    return F.when(good, F.concat(molecules(0), molecules(1))), F.when(good, molecules(2))


def clean_reaction(text: Column) -> tuple[Column, Column]:
    """(reactants, products) as multisets of the molecules as they are written."""
    left, right = reaction_molecules(text)
    return multiset(left), multiset(right)


def order_key(key: Column, seed: int, salt: str = "") -> Column:
    """A seeded order that any engine can repeat: the MD5 of key:seed, or key:seed:salt."""
    return F.md5(F.concat(key, F.lit(f":{seed}" + (f":{salt}" if salt else ""))).cast("binary"))


def shuffled_join(ms: Column, key: Column, seed: int) -> Column:
    """The expanded items joined by `.` in a seeded order of their own for every key."""
    items = F.transform(expand(ms), lambda x, i: F.struct(F.md5(F.concat(x, F.lit(":"), i.cast("string"), F.lit(":"), key, F.lit(f":{seed}")).cast("binary")).alias("h"), x.alias("x")))
    return F.array_join(F.transform(F.sort_array(items), lambda e: e["x"]), ".")


def to_smiles(reactants: Column, products: Column, key: Column, seed: int) -> Column:
    return F.concat(shuffled_join(reactants, key, seed), F.lit(">>"), shuffled_join(products, key, seed))


def to_jsonl(reactants: Column, products: Column, key: Column, seed: int) -> Column:
    """The export record {"translation": {"reactants": ..., "products": ...}} as one line."""
    return F.to_json(F.struct(F.struct(shuffled_join(reactants, key, seed).alias("reactants"), shuffled_join(products, key, seed).alias("products")).alias("translation")))


def from_jsonl(line: Column) -> tuple[Column, Column]:
    parsed = F.from_json(line, "translation struct<reactants:string,products:string>")
    return side(parsed["translation"]["reactants"]), side(parsed["translation"]["products"])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def tokenizes(text: Column) -> Column:
    """Whether the tokens make up the whole text."""
    return F.array_join(tokens(text), "") == text


def token_text(text: Column) -> Column:
    """Tokens joined by blanks; NULL where they don't make up the text."""
    return F.when(tokenizes(text), F.array_join(tokens(text), " "))


def atom_maps(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r":(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def in_class_set(code: Column, codes: Iterable[str]) -> Column:
    """Whether the code or one of its dotted prefixes is in the set; only prefixes of lengths that the set has are looked at."""
    by_level: dict[int, list[str]] = {}
    for c in codes:
        by_level.setdefault(c.count(".") + 1, []).append(c)
    depth = F.size(F.split(code, r"\."))
    tests = [(depth >= k) & F.substring_index(code, ".", k).isin(v) for k, v in sorted(by_level.items())]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def matches_all(text: Column, terms: Iterable[str]) -> Column:
    """Whether all terms, as case-insensitive patterns, are found."""
    return F.coalesce(reduce(lambda a, b: a & b, [text.rlike(f"(?i){t}") for t in terms], F.lit(True)), F.lit(False))


def has_repeats(items: Column) -> Column:
    return F.size(items) != F.size(F.array_distinct(items))


def hash_split(key: Column, seed: int, parts: int) -> Column:
    """A number from 0 to parts - 1 from the seeded order key."""
    return F.conv(F.substring(order_key(key, seed), 1, 8), 16, 10).cast("long") % parts
