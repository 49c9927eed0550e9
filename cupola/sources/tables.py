"""Intermediate tables in the folder that driver and executors share, and rows dealt evenly over the tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet below spark.checkpoint.dir and read back: what is read twice is computed once, and a lost executor loses nothing. In local mode without that setting, a folder of this machine."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="cupola-")
    path = f"{folder}/cupola-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt evenly by a hash of the columns. A small file is read by one task however much its rows cost, and adaptive execution makes one task of a few MB; parts of a given number stay as they are."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)
