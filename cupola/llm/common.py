"""Small helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, by Spark's own reader (the path may be in any store that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine in local mode, which has no others, and an error on a cluster."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cupola-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet into the shared folder and read back: cuts lineage, survives lost executors, keeps columns prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cupola-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns freed memory of a worker to the system; does nothing where the C library can't."""
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


#: Key ranges that quantiles bound; more are made by dividing each of them evenly.
QUANTILES = 512
#: Limits of a block: a row looks at the blocks' first limits, then at one block.
BLOCK = 24


def range_bucket(df: DataFrame, key: str, n: int) -> tuple[Column, int]:
    """(column, count): the number of the key range a row falls in, ascending with the whole-number key, nulls in range 0.

    The limits are quantiles of the key over all rows, fixed in the plan as literals, so a task that is run again
    after an executor is lost deals its rows exactly as before. At most QUANTILES limits reach the driver; if more
    ranges are wanted, each is divided into equal widths.
    """
    coarse, c = min(n, QUANTILES), F.col(key)
    limits, low, high = [], None, None
    if n > 1:
        at = F.array(*[F.lit(i / coarse) for i in range(1, coarse)])
        found = df.agg(F.percentile_approx(c, at, F.lit(max(10_000, 20 * coarse))).alias("q"), F.min(c).alias("low"), F.max(c).alias("high")).first()
        limits, low, high = sorted(set(found.q or [])), found.low, found.high
    if not limits:
        return F.lit(0), 1

    parts = -(-n // (len(limits) + 1))
    at = count_upto(F.array(*[F.array(*map(F.lit, limits[i : i + BLOCK])) for i in range(0, len(limits), BLOCK)]), c, F.lit(BLOCK))
    if parts == 1:
        return F.when(c.isNull(), 0).otherwise(at), len(limits) + 1
    ends = [low, *limits, high + 1]
    lows, widths = F.array(*map(F.lit, ends[:-1])), F.array(*[F.lit(max(1, b - a)) for a, b in zip(ends, ends[1:])])
    inside = bound(at, lambda k: k * parts + F.least(F.floor((c - F.get(lows, k)).cast("double") * parts / F.get(widths, k)).cast("int"), F.lit(parts - 1)))
    return F.when(c.isNull(), 0).otherwise(inside), (len(limits) + 1) * parts


def count_upto(blocks: Column, value: Column, size: Column) -> Column:
    """How many of the ascending values in `blocks` (arrays of `size`; the last may be shorter) are at most value: the block first, then the place in it.

    The limits are one array in the plan, however many they are; a nest of comparisons as long would fill the driver.
    """
    after = F.size(F.filter(blocks, lambda b: F.get(b, F.lit(0)) <= value))
    return bound(after, lambda k: F.when(k == 0, 0).otherwise((k - 1) * size + F.size(F.filter(F.get(blocks, k - 1), lambda x: x <= value))))


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it: a lambda's variable is a value, not an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
