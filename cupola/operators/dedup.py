"""Displacement dedup: one surviving record per key by an ordered fold.

Arrivals are folded in ingest order. The newcomer displaces the survivor if it has a name and the survivor none;
else if the survivor's year is unknown; else if its own year is known and smaller. The rule is not associative, so
arrivals are folded one after another; only (order, has a name, year) takes part, and the payload is joined back.

A key may hold a third of all arrivals, so no key is folded in one place. Its arrivals are cut into slices of the
order. What a slice makes of any survivor that comes into it is known from few of its arrivals: its first, its first
with a name, and those whose year is below all before them. The first of these that displaces the incoming survivor is
where the slice's own fold begins, so each carries the survivor that the slice ends with from there. A key's slices are
then folded one after another; their summaries hold a year at most once.

A key with very many arrivals shrinks first (`shrunk`): in a run of arrivals that are alike in (has a name, year),
those after the first change nothing if the year is known; if it is unknown, the last one wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def displaces(cur: Column, new: Column) -> Column:
    return F.when(new["named"] & ~cur["named"], True).when(cur["year"].isNull(), True).when(new["year"].isNotNull() & (new["year"] < cur["year"]), True).otherwise(False)


def _fold(cur: Column, events: Column) -> Column:
    return F.aggregate(events, cur, lambda cur, new: F.when(displaces(cur, new), new).otherwise(cur))


def survivors(df: DataFrame, key: str, order: str, name: str, year: str, span: int = 100_000) -> DataFrame:
    """One row of df per key: the fold's survivor. `order` must be unique. A slice holds `span` of the order."""
    event = F.struct(F.col(order).alias("ord"), F.col(name).isNotNull().alias("named"), F.col(year).alias("year"))
    slices = df.select(key, F.floor(F.col(order) / span).alias("slice"), event.alias("e")).groupBy(key, "slice").agg(F.sort_array(F.collect_list("e")).alias("es"))
    kind = df.select(event.alias("e")).schema["e"].dataType.simpleString()
    # places of the arrivals that may be the first to displace a survivor from before the slice
    start = F.struct(F.lit(0).alias("i"), F.lit(False).alias("named"), F.lit(None).cast(df.schema[year].dataType).alias("low"), F.array().cast("array<int>").alias("at"))

    def look(acc: Column, e: Column) -> Column:
        below = e["year"].isNotNull() & (acc["low"].isNull() | (e["year"] < acc["low"]))
        opens = (acc["i"] == 0) | (e["named"] & ~acc["named"]) | below
        return F.struct((acc["i"] + 1).alias("i"), (acc["named"] | e["named"]).alias("named"), F.when(below, e["year"]).otherwise(acc["low"]).alias("low"), F.when(opens, F.concat(acc["at"], F.array(acc["i"]))).otherwise(acc["at"]).alias("at"))

    at = F.aggregate("es", start, look, lambda acc: acc["at"])
    ends = F.transform(at, lambda i: F.struct(F.get("es", i).alias("e"), _fold(F.get("es", i), F.slice("es", i + 2, F.size("es"))).alias("last")))
    summed = slices.select(key, "slice", ends.alias("ends")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("slice", "ends"))).alias("s"))

    def enter(cur: Column, x: Column) -> Column:
        return F.coalesce(F.get(F.filter(x["ends"], lambda c: cur.isNull() | displaces(cur, c["e"])), F.lit(0))["last"], cur)

    last = F.aggregate("s", F.lit(None).cast(kind), enter)
    return df.join(summed.select(last["ord"].alias(order)), order, "left_semi")


def shrunk(df: DataFrame, key: str, order: str, name: str, year: str, span: int = 100_000) -> DataFrame:
    """df without arrivals that can't change the fold, for keys with very many arrivals; survivors() of it are the same.

    Within a run of arrivals that are alike in (named, year), only the first counts if the year is known, and only
    the first and the last if it isn't. Runs are cut at every `span` of the order, so that no window takes a whole key.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order) / span))
    w = Window.partitionBy(key, "_slice").orderBy(order)
    state = F.struct(F.col(name).isNotNull().alias("a"), F.col(year).alias("b"))
    marked = sliced.withColumns({"_s": state, "_p": F.lag(state).over(w), "_n": F.lead(state).over(w)})
    first, last = ~F.col("_p").eqNullSafe(F.col("_s")), ~F.col("_n").eqNullSafe(F.col("_s"))
    return marked.where(first | (last & F.col(year).isNull())).drop("_slice", "_s", "_p", "_n")


def provenance(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n): how often each value was seen for a key, over all arrivals."""
    return df.groupBy(key, value).agg(F.count("*").alias("n"))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """One row: arrivals, distinct keys, duplicates."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), (F.sum("n") - F.count("*")).alias("n_duplicates"))
