"""Reaction-shaped views of the given tables, as DataFrames and as SQL.

The given tables hold no reactions, so an order stands for a reaction: its line items are the molecules, its
customer and status the title, its suppliers the authors, its customer's nation the class, its date the year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cupola.functions.columns import multiset, reaction_key

SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, reactants, products): multisets of part numbers modulo 20."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rid"), (F.col("l_partkey") % 20).cast("string").alias("smi"), (F.col("l_linenumber") <= 4).alias("left"))
    pick = lambda c: multiset(F.sort_array(F.collect_list(F.when(c, F.col("smi")))))
    return items.groupBy("rid").agg(pick(F.col("left")).alias("reactants"), pick(~F.col("left")).alias("products"))


def reactions(spark: SparkSession, sf_dir: str, authors: bool = False) -> DataFrame:
    """(key, rid, title, doc, name_rxn, year, [authors]); key is the order's number as text, so it is unique."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    unknown = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "4-NOT SPECIFIED")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(F.broadcast(nation.select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("rid"), F.when(~unknown, F.concat("c_name", F.lit("_"), "o_orderstatus")).alias("title"),
        F.when(~unknown, F.substring_index("c_name", "_", 1)).alias("doc"),
        F.when(F.col("o_orderkey") % 17 != 0, F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), (F.col("o_custkey") % 5).cast("string"))).alias("name_rxn"),
        F.when(F.col("o_orderkey") % 23 != 0, F.year("o_orderdate")).alias("year"),
    )
    if authors:
        names = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        lists = names.groupBy(F.col("l_orderkey").alias("rid")).agg(F.sort_array(F.collect_set("s_name")).alias("authors"))
        rows = rows.join(lists, "rid", "left").withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
    return rows


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, key, name_rxn, year): orders in ingest order under the canonical key of their reactants, which repeats."""
    rows = reactions(spark, sf_dir)
    left = sides(spark, sf_dir).select("rid", F.concat(F.lit("k"), F.coalesce(F.get(F.col("reactants.smi"), F.lit(0)), F.lit(""))).alias("k"), F.size("products").alias("p"))
    return rows.join(left, "rid").select(F.col("rid").alias("ord"), F.concat("k", F.lit("-"), F.col("p").cast("string")).alias("dkey"), "name_rxn", "year")


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, key, reactants, products) with the canonical key of both sides."""
    return sides(spark, sf_dir).withColumn("key", reaction_key(F.col("reactants"), F.col("products")))


#: The same views in SQL, to be put before a query.
RX = """rx AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey AS rid,
    CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED') THEN c_name || '_' || o_orderstatus END AS title,
    CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED') THEN split_part(c_name, '_', 1) END AS doc,
    CASE WHEN o_orderkey % 17 <> 0 THEN n_regionkey || '.' || n_nationkey || '.' || (o_custkey % 5) END AS name_rxn,
    CASE WHEN o_orderkey % 23 <> 0 THEN CAST(year(o_orderdate) AS INTEGER) END AS year
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
AUTHORS = """au AS (SELECT DISTINCT l_orderkey AS rid, s_name AS author FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
ITEMS = """items AS (SELECT l_orderkey AS rid, CAST(l_partkey % 20 AS VARCHAR) AS smi, l_linenumber <= 4 AS lft FROM lineitem),
sides AS (
  SELECT rid, coalesce(string_agg(smi, '.' ORDER BY smi) FILTER (WHERE lft), '') AS r, coalesce(string_agg(smi, '.' ORDER BY smi) FILTER (WHERE NOT lft), '') AS p,
    min(smi) FILTER (WHERE lft) AS first_r, count(DISTINCT smi) FILTER (WHERE NOT lft) AS n_p
  FROM items GROUP BY rid)"""
ARRIVALS = """arr AS (SELECT rx.rid AS ord, 'k' || coalesce(first_r, '') || '-' || n_p AS dkey, name_rxn, year FROM rx JOIN sides USING (rid))"""
