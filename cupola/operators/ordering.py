"""Seeded ranks and running sums over tables of any size.

An MD5 order is uniform, so its first three digits deal a table into 4096 even parts. A rank or running sum is
the part's offset, from a window over at most 4096 sums a group, plus the place inside the part. No window ever
takes a whole table into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3


def _offsets(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    parts = df.groupBy(*by, "_part").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before"))


def running(df: DataFrame, order: str, tie: str, value: Column, name: str, by: tuple[str, ...] = (), part: Column | None = None) -> DataFrame:
    """df with the running sum of value, own row included, by ascending (order, tie) inside the groups of `by`. `order` is a hexadecimal hash column, or else `part` gives even parts that ascend with it."""
    by = list(by)
    parted = df.withColumn("_part", F.substring(order, 1, DIGITS) if part is None else part)
    upto = Window.partitionBy(*by, "_part").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = parted.withColumn(name, F.sum(value).over(upto))
    same = [inside[c].eqNullSafe(F.col(f"_o.{c}")) for c in [*by, "_part"]]
    joined = inside.join(_offsets(parted, by, value).alias("_o"), same)
    return joined.select(*[inside[c] for c in df.columns if c != name], (inside[name] + F.col("_o._before")).alias(name))


def ranked(df: DataFrame, order: str, tie: str, name: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """df with a rank from 1 by ascending (order, tie) inside the groups of `by`."""
    return running(df, order, tie, F.lit(1).cast("long"), name, by)
