"""The ordered chain of quality checks on a reaction's molecules, and reaction-centre differences.

A check is a Column over two multisets; the chain keeps the first that fails. Nested `when` evaluates no later
check for a row that has failed, and a NULL (unknown) outcome counts as a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_LIMIT = 800


#: Multisets with the measures of each molecule, as operators.dictionary makes them once for every distinct one.
MEASURED = "array<struct<smi:string,n:int,key:string,neutral_key:string,heavy:int,carbon:boolean,bonds:int,n_tokens:int>>"


def registry(reactants: Column, products: Column, token_limit: int = TOKEN_LIMIT, least_heavy: int = 5) -> dict[str, Column]:
    """Checks by name (fixed values), in the order in which they run, over multisets of measured molecules."""
    count = lambda ms: F.aggregate(ms, F.lit(0), lambda acc, x: acc + x["n"])
    # the molecules of a side are joined by dots, one token each
    size = lambda ms: F.aggregate(ms, F.lit(0), lambda acc, x: acc + x["n"] * x["n_tokens"]) + F.greatest(count(ms) - 1, F.lit(0))
    every = lambda ms, name: F.transform(ms, lambda x: x[name])
    return {
        "at_least_5_heavy_atoms_in_reactants": F.aggregate(reactants, F.lit(0), lambda acc, x: acc + x["n"] * x["heavy"]) >= least_heavy,
        "at_least_one_carbon_in_reactants": F.exists(reactants, lambda x: x["carbon"]),
        "under_800_tokens": (size(reactants) < token_limit) & (size(products) < token_limit),
        "at_least_two_bonds_in_one_molecule": F.array_max(every(reactants, "bonds")) >= 2,
        "at_least_one_larger_product_different": F.exists(products, lambda x: ~F.array_contains(every(reactants, "key"), x["key"]) & (x["heavy"] >= 2)),
        "not_deprotonation": F.size(F.array_except(every(products, "neutral_key"), every(reactants, "neutral_key"))) > 0,
    }


def first_failure(checks: dict[str, Column]) -> Column:
    """The name of the first check that fails; NULL if all hold."""
    out = F.lit(None).cast("string")
    for name, good in reversed(checks.items()):
        out = F.when(F.coalesce(good, F.lit(False)), out).otherwise(F.lit(name))
    return out


def failure_counts(rows: DataFrame, column: str) -> DataFrame:
    """(first_failure, n) for every check, 0 where none failed it."""
    names = _names(rows)
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("first_failure")).agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, "first_failure", "left").select("first_failure", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _names(rows: DataFrame) -> DataFrame:
    empty = F.array().cast(MEASURED)
    return rows.sparkSession.createDataFrame([(n,) for n in registry(empty, empty)], "first_failure string")


def failures_by_smiles(rows: DataFrame, smiles: str, column: str) -> DataFrame:
    """(smiles, first_failure, n)."""
    return rows.where(F.col(column).isNotNull()).groupBy(smiles, column).agg(F.count("*").alias("n"))


def changed_bonds(sides: DataFrame, rid: str) -> DataFrame:
    """(rid, a, b, ord): bonds whose order after the reaction differs, 0.0 if gone, for bonds with an atom that stands after it.

    sides has (rid, bond struct<a, b>, ord, before); of repeated bonds of one side the largest order counts.
    """
    side = lambda c, name: sides.where(c).groupBy(rid, "bond").agg(F.max("ord").alias(name))
    was, now = side(F.col("before"), "was"), side(~F.col("before"), "now")
    atoms = sides.where(~F.col("before")).groupBy(rid).agg(F.flatten(F.collect_set(F.array("bond.a", "bond.b"))).alias("atoms"))
    both = was.join(now, [rid, "bond"], "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    held = both.join(atoms, rid).where(F.array_contains("atoms", F.col("bond.a")) | F.array_contains("atoms", F.col("bond.b")))
    return held.select(rid, F.col("bond.a").alias("a"), F.col("bond.b").alias("b"), F.coalesce("now", F.lit(0.0)).alias("ord"))
