"""Reading raw reaction records (JSON lines in nested folders) and flattening them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cupola.functions.columns import date_parts, known

_TEXT = T.StringType()
#: Schema of a raw record; it is given, never inferred.
RAW = T.StructType([
    T.StructField("title", _TEXT),
    T.StructField("data", T.StructType([
        T.StructField("documentId", _TEXT), T.StructField("namerxn", _TEXT), T.StructField("namerxndef", _TEXT), T.StructField("date", _TEXT), T.StructField("smiles", _TEXT),
        T.StructField("assignees", T.ArrayType(_TEXT)), T.StructField("authors", T.ArrayType(_TEXT)),
    ])),
])
#: Files whose names contain this are read.
NAME_PART = "reactions_wbib"
BAD = "_corrupt"


def read_raw(spark: SparkSession, roots: str | Iterable[str], strict: bool = True) -> DataFrame:
    """All records below the roots, one JSON object a line, with `ingest_file` and `ingest_row`.

    A malformed line fails the job if strict; else it is kept in the column `_corrupt`. Spark skips files whose
    names begin with `.` or `_`, skips blank lines, and reads compressed files by their extension.
    """
    paths = [roots] if isinstance(roots, str) else list(roots)
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{NAME_PART}*")
    if strict:
        rows = reader.schema(RAW).option("mode", "FAILFAST").json(paths)
    else:
        rows = reader.schema(T.StructType([*RAW.fields, T.StructField(BAD, _TEXT)])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(paths)
    return rows.withColumns({"ingest_file": F.col("_metadata.file_path"), "ingest_block": F.col("_metadata.file_block_start"), "ingest_row": F.monotonically_increasing_id()})


def subfolder_paths(root: str, subfolders: str | Iterable[str]) -> list[str]:
    return [f"{root}/data/extract/{s}" for s in ([subfolders] if isinstance(subfolders, str) else subfolders)]


def ordered(rows: DataFrame) -> DataFrame:
    """rows with `ingest_ord`, ascending with file path, block and line: the order that the dedup fold follows.

    The row number of a task ascends with the lines of a block, so the three sort as the files do; ranks come from
    the parts' counts, and no window takes more than one block of a file.
    """
    from pyspark.sql import Window

    keys = ["ingest_file", "ingest_block"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # one row a block of a file
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy("ingest_row")
    return rows.join(offsets, keys).withColumn("ingest_ord", F.col("_before") + F.row_number().over(inside) - 1).drop("_before", "ingest_row", *keys)


def flatten(rows: DataFrame, extras: bool = True) -> DataFrame:
    """The flat row: title (or the document's id), name_rxn, name_rxn_def, year, month, day, smiles, and with extras assignees and authors. Unknown is NULL."""
    year, month, day = date_parts(F.col("data.date"))
    out = {
        "title": known(F.coalesce("title", F.col("data.documentId"))), "name_rxn": known(F.col("data.namerxn")), "name_rxn_def": known(F.col("data.namerxndef")),
        "year": year, "month": month, "day": day, "smiles": known(F.col("data.smiles")),
    }
    if extras:
        out |= {"assignees": F.col("data.assignees"), "authors": F.col("data.authors")}
    kept = [c for c in rows.columns if c in ("ingest_ord", BAD)]
    return rows.select(*kept, *[c.alias(n) for n, c in out.items()])


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """An exported split read back: (reactants, products, key)."""
    from cupola.functions.columns import reaction_key, side

    rows = spark.read.schema("translation struct<reactants:string,products:string>").json(path)
    sides = rows.select(side(F.col("translation.reactants")).alias("reactants"), side(F.col("translation.products")).alias("products"))
    return sides.withColumn("key", reaction_key(F.col("reactants"), F.col("products")))


__all__ = ["BAD", "RAW", "flatten", "ordered", "read_raw", "read_split", "subfolder_paths"]
