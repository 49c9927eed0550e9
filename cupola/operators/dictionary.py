"""Distinct molecules, measured once: a dictionary of the strings that a corpus holds, joined back to where they stand.

A corpus names few molecules often, so parsing, keys and measures are made for distinct strings only. Spellings of one
molecule meet in its key; the shortest of them, the first in order of those, becomes the spelling of all. Strings are
counted before they move, so a solvent that stands in a third of all reactions is a row a task. Joined back, a dictionary of
up to FEW strings is sent to every task; a larger one is joined by a shuffle, in which strings that stand oftener
than HOT times are dealt to SALTS places each, so none of them fills a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cupola.functions import structure as S
from cupola.functions.columns import tokens
from cupola.functions.molecules import normal_form, readable
from cupola.sources.tables import spread, written

FEW = 500_000
#: The same of reactions, whose rows are wider.
FEW_REACTIONS = 100_000
HOT, SALTS = 1_000_000, 64
#: What is known of a molecule, in the order of the dictionary's columns.
MEASURES = ("key", "neutral_key", "heavy", "carbon", "bonds", "n_tokens")


def measured(strings: DataFrame) -> DataFrame:
    """(smi, n, number, form, key, neutral_key, heavy, carbon, bonds, n_tokens) of each distinct string of column smi. n counts it; number is that of its molecule, form its spelling; what isn't readable has no form and no measures."""
    distinct = spread(strings.where("smi is not null").groupBy("smi").agg(F.count("*").alias("n")), "smi")
    own = distinct.withColumn("_own", F.when(readable(F.col("smi")), normal_form("smi")))
    # the strings that aren't readable are parsed as none
    parsed = S.with_molecules(own, _m="_own").select("*", F.array("_m", S.neutral(F.col("_m"))).alias("_both"))
    parsed = parsed.select("smi", "n", "_own", "_m", F.transform("_both", S.key_of).alias("_keys"))
    m = F.col("_m")
    heavy = lambda i: F.get(m["atoms"], i)["element"] != "H"
    known = written(parsed.select(
        "smi", "n", F.monotonically_increasing_id().alias("number"), "_own", F.get("_keys", F.lit(0)).alias("key"), F.get("_keys", F.lit(1)).alias("neutral_key"), F.size(F.filter(m["atoms"], lambda a: a["element"] != "H")).alias("heavy"),
        F.exists(m["atoms"], lambda a: a["element"] == "C").alias("carbon"), F.size(F.filter(m["bonds"], lambda x: heavy(x["a"]) & heavy(x["b"]))).alias("bonds"),
    ), "molecules")
    # the spellings of one molecule are few, its occurrences were counted before
    shortest = known.where("key is not null").groupBy(F.col("key").alias("_k")).agg(F.min(F.struct(F.length("_own").alias("len"), F.col("_own").alias("form")))["form"].alias("form"), F.min("number").alias("_first"))
    joined = known.join(shortest, F.col("key") == F.col("_k"), "left")
    return joined.select("smi", "n", F.coalesce("_first", "number").alias("number"), "form", "key", "neutral_key", *[F.when(F.col("key").isNotNull(), F.col(c)).alias(c) for c in ("heavy", "carbon", "bonds")], F.when(F.col("form").isNotNull(), F.size(tokens(F.col("form")))).alias("n_tokens"))


def joined(rows: DataFrame, dictionary: DataFrame, column: str, few: int = FEW, hot: int = HOT, by: str = "smi") -> DataFrame:
    """rows with the dictionary's columns but n and `by`, found by rows' column; rows that it lacks have NULLs. rows has none of those columns but `column`."""
    known = dictionary.withColumnRenamed(by, "_by")
    if dictionary.count() <= few:
        return rows.join(F.broadcast(known.drop("n")), F.col(column) == F.col("_by"), "left").drop("_by")
    # at most (all occurrences) / HOT entries
    often = dictionary.where(F.col("n") > hot).select(F.col(by).alias("_hot"))
    dealt = rows.join(F.broadcast(often), F.col(column) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    copies = known.withColumn("_at", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > hot, SALTS - 1).otherwise(0)))).drop("n")
    return dealt.join(copies, (F.col(column) == F.col("_by")) & (F.col("_salt") == F.col("_at")), "left").drop("_by", "_salt", "_at")


def once(rows: DataFrame, column: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with the columns that make(strings) adds to the distinct values of a string column, each worked on once, by all tasks; NULL counts as the empty string. The column itself goes."""
    named = rows.withColumn(column, F.coalesce(column, F.lit("")))
    distinct = spread(named.groupBy(column).agg(F.count("*").alias("n")), column)
    known = written(make(distinct), "once")
    return joined(named, known, column, few=FEW_REACTIONS, by=column).select(*[c for c in rows.columns if c != column], *[c for c in known.columns if c not in (column, "n")])
