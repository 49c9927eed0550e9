"""Writing splits: JSON lines per set, sizes, checksums, and the manifest."""

from __future__ import annotations

import getpass
import json
import platform
import subprocess
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cupola.functions.columns import order_key, to_jsonl


#: Rows of a file, about.
FILE_ROWS = 1_000_000
#: Hexadecimal digits of the order that deal rows to files.
DEALT = 12


def lines(rows: DataFrame, seed: int, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """(by, value): the export line of every row (key, reactants, products)."""
    return rows.select(*by, to_jsonl(F.col("reactants"), F.col("products"), F.col("key"), seed).alias("value"))


def shuffled(rows: DataFrame, seed: int, by: tuple[str, ...] = ("split",), file_rows: int | None = FILE_ROWS) -> DataFrame:
    """(by, value): the export lines, every set mixed as a whole by one seeded order that no partitioning changes.

    A set is cut into files (one for every file_rows of its rows, None: one in all) by even ranges of the order's hash. The
    ranges are fixed in the plan, not sampled, and each is one partition: partition numbers ascend with the set and, inside
    it, with the order, so a set's files by name are the order from its beginning, and a task that is run again writes the same.
    """
    counted = rows.groupBy(*by).agg(F.count("*").alias("_n")).orderBy(*by).collect()  # one row a set
    slots, first = [], 0
    for r in counted:
        files = 1 if file_rows is None else -(-r["_n"] // file_rows)
        slots.append((*[r[c] for c in by], first, files))
        first += files
    if not slots:
        return lines(rows, seed, by)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in by]
    known = rows.sparkSession.createDataFrame(slots, ", ".join([*kinds, "_first int, _files int"]))
    order = order_key(F.col("key"), seed, "file")
    made = rows.select(*by, to_jsonl(F.col("reactants"), F.col("products"), F.col("key"), seed).alias("value"), F.coalesce(order, F.lit("0" * 32)).alias("_h")).alias("r")
    met = made.join(F.broadcast(known.alias("k")), [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by])
    share = F.conv(F.substring("_h", 1, DEALT), 16, 10).cast("long") * F.lit(1.0) / F.lit(16**DEALT)
    slot = F.col("_first") + F.least(F.floor(share * F.col("_files")).cast("int"), F.col("_files") - 1)
    dealt = met.select(*[F.col(f"r.{c}").alias(c) for c in by], "value", "_h", slot.alias("_slot")).repartitionById(first, "_slot")
    return dealt.sortWithinPartitions(*by, "_h", "value").select(*by, "value")


def write_sets(rows: DataFrame, path: str, seed: int, by: tuple[str, ...] = ("split",), single_file: bool = False, file_rows: int = FILE_ROWS) -> None:
    """Writes `path/<by>=<value>/part-*`, mixed as `shuffled` says; fails if path exists. single_file makes one file a set, for small sets only."""
    shuffled(rows, seed, by, None if single_file else file_rows).write.mode("errorifexists").partitionBy(*by).text(path)


def combined(rows: DataFrame, names: list[str], into: str, by: str = "split") -> DataFrame:
    """rows of the named sets once more under one name, such as training and fine-tuning together."""
    return rows.where(F.col(by).isin(*names)).withColumn(by, F.lit(into))


def sizes(rows: DataFrame, by: str = "split") -> dict[str, int]:
    return {r[by]: r["count"] for r in rows.groupBy(by).count().collect()}


#: Bytes that a task holds of a file while it is digested.
HASHED = 1 << 16
#: Stores that a task's Python opens by itself; of others Spark reads whole files, of less than 2 GB each.
OPENED = ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def _opened(path: str):
    """A stream of the file's bytes."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    store, name = fs.FileSystem.from_uri(quote(path, safe=":/=@"))
    return store.open_input_stream(name)


def _digests(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """sha256 of each path, read in blocks."""
    import hashlib

    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            with _opened(path) as stream:
                while data := stream.read(block):
                    digest.update(data)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(found, pa.string())], names=["path", "length", "sha256"])


def file_hashes(spark: SparkSession, path: str, block: int = HASHED) -> DataFrame:
    """(path, length, sha256) of every file below path, of any size: files are dealt to tasks, which read them in blocks. No row holds a file. Empty files have none: Spark's readers leave them out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # names and lengths alone: contents aren't read. A path lies in one store
    listed = files.select("path", "length")
    if listed.where(~F.regexp_extract("path", "^([^:]*):", 1).isin(*OPENED)).limit(1).count():
        return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return listed.repartition("path").mapInArrow(lambda batches: _digests(batches, block), "path string, length long, sha256 string")


def content_hash(rows: DataFrame, value: str = "value", by: tuple[str, ...] = ("split",)) -> DataFrame:
    """(by, n, sha256): the SHA-256 of each set's lines, which no dealing to files changes.

    It is a tree of digests: the lines' own, in order, by their first five digits; those digests by the first two;
    and of these the set's. No list is longer than a 2^20th of a set's lines, or 4096.
    """
    joined = lambda place, value: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, value))), lambda x: x[value]), "").cast("binary"), 256)
    h = rows.select(*by, F.sha2(F.col(value).cast("binary"), 256).alias("_d"))
    low = h.groupBy(*by, F.substring("_d", 1, 5).alias("_p")).agg(F.count("*").alias("_n"), F.sha2(F.array_join(F.sort_array(F.collect_list("_d")), "").cast("binary"), 256).alias("_d"))
    mid = low.groupBy(*by, F.substring("_p", 1, 2).alias("_q")).agg(F.sum("_n").alias("_n"), joined("_p", "_d").alias("_d"))
    return mid.groupBy(*by).agg(F.sum("_n").alias("n"), joined("_q", "_d").alias("sha256"))


def stamp(spark: SparkSession) -> dict[str, str]:
    """Where and when a result was made."""
    try:
        git = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip()
    except (OSError, subprocess.TimeoutExpired):
        git = ""
    return {"host": platform.node(), "user": getpass.getuser(), "datetime": datetime.now().strftime("%Y-%m-%d_%H-%M-%S"), "git": git or "unknown", "application": spark.sparkContext.applicationId}


def jsonable(params: dict) -> dict:
    """Only those parameters that JSON can hold."""
    out = {}
    for k, v in params.items():
        try:
            json.dumps(v)
        except TypeError:
            continue
        out[k] = v
    return out


def write_manifest(spark: SparkSession, path: str, meta: dict) -> None:
    """meta as one JSON file in the folder path, through Spark's writer, so any store will do."""
    text = json.dumps(meta | {"stamp": stamp(spark)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(path)
