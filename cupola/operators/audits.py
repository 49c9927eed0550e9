"""Leakage audits. Each names what it found; an empty or false result means that the splits are clean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cupola.functions.columns import author_name


def shared(rows: DataFrame, value: str, split: str = "split") -> DataFrame:
    """(value, n_splits): values that stand in more than one split, in one shuffle for any number of splits."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def pairwise(rows: DataFrame, value: str, split: str = "split") -> DataFrame:
    """(split_a, split_b, n): how many values each two splits share."""
    sets = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.sort_array(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("n"))


def repeats(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(split, key, n): keys that stand in one split more than once."""
    return rows.groupBy(split, key).agg(F.count("*").alias("n")).where("n > 1")


#: Distinct authors of the audited rows up to which they are sent to every task.
FEW_AUTHORS = 1_000_000


def containment(ood: DataFrame, train: DataFrame, key: str = "key", authors: str = "authors", normalise: bool = True) -> DataFrame:
    """(key, n_authors, n_seen, covered) of every audited row with authors: how many distinct authors it has, how many of them also stand in training rows, and whether that is all of them.

    Division by counting. Only training authors that the audited rows name can matter: the training side is cut to these
    before it is made distinct, by a broadcast of the counted names or, beyond FEW_AUTHORS, a shuffled semi-join.
    """
    name = author_name if normalise else (lambda c: c)
    each = ood.select(key, F.explode(F.transform(authors, name)).alias("author")).where("author is not null").distinct()
    asked = each.select("author").distinct()
    if asked.count() <= FEW_AUTHORS:
        asked = F.broadcast(asked)
    seen = train.select(F.explode(F.transform(authors, name)).alias("author")).join(asked, "author", "left_semi").distinct().withColumn("seen", F.lit(1).cast("long"))
    counts = each.join(seen, "author", "left").groupBy(key).agg(F.count("*").alias("n_authors"), F.coalesce(F.sum("seen"), F.lit(0)).cast("long").alias("n_seen"))
    return counts.withColumn("covered", F.col("n_seen") == F.col("n_authors"))


def covered_by(ood: DataFrame, train: DataFrame, key: str = "key", authors: str = "authors", normalise: bool = True) -> DataFrame:
    """Keys of out-of-distribution rows all of whose authors also stand in the training rows."""
    return containment(ood, train, key, authors, normalise).where("covered").select(key)


def jurisdictions(rows: DataFrame, doc: str) -> DataFrame:
    """(jurisdiction, n_docs): first two characters of the documents; one row is right."""
    return rows.where(F.col(doc).isNotNull()).select(doc).distinct().groupBy(F.substring(doc, 1, 2).alias("jurisdiction")).agg(F.count("*").alias("n_docs"))


def documents_of_many_years(rows: DataFrame, doc: str = "doc", year: str = "year") -> DataFrame:
    """Documents that break the assumption of one year a document."""
    return rows.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.countDistinct(year).alias("n_years")).where("n_years > 1")


def claim_gaps(rows: DataFrame, claimed: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows of a claimed document that don't list its claiming author: the author split's guarantee rests on there being none."""
    owner = claimed.join(ranks, "author_rank").select("doc", "author")
    return rows.join(owner, "doc").where(~F.exists("authors", lambda a: author_name(a) == F.col("author"))).select("key", "doc", "author")
