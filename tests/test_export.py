"""Sets mixed as a whole whatever the partitioning, and digests of files by blocks."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cupola.sources import export


def rows_of(spark, n=1000):
    item = lambda x: F.array(F.struct(x.alias("smi"), F.lit(1).alias("n")))
    split = F.when(F.col("id") % 10 == 0, "valid").otherwise("train")
    return spark.range(n).select(F.concat(F.lit("C"), "id").alias("key"), item(F.concat(F.lit("C"), "id")).alias("reactants"), item(F.lit("O")).alias("products"), split.alias("split"))


def files_of(path):
    return {d.name: [f.read_text() for f in sorted(d.glob("part-*"))] for d in sorted(Path(path).glob("split=*"))}


def test_files_are_slices_of_one_order(spark, tmp_path):
    rows = rows_of(spark)
    made = []
    for i, dealt in enumerate((rows.coalesce(1), rows.repartition(7), rows.repartition(3, "key").orderBy(F.desc("key")))):
        export.write_sets(dealt, str(tmp_path / f"o{i}"), 5, file_rows=250)
        made.append(files_of(tmp_path / f"o{i}"))
    assert made[0] == made[1] == made[2]
    assert {k: len(v) for k, v in made[0].items()} == {"split=train": 4, "split=valid": 1}
    assert all(150 < len(f.splitlines()) < 320 for f in made[0]["split=train"])
    # a set's files by name are the whole order
    lines = {r.key: r.value for r in rows.select("key", export.to_jsonl(F.col("reactants"), F.col("products"), F.col("key"), 5).alias("value")).collect()}
    own = sorted((k for k in lines if int(k[1:]) % 10), key=lambda k: hashlib.md5(f"{k}:5:file".encode()).hexdigest())
    assert "".join(made[0]["split=train"]).splitlines() == [lines[k] for k in own]
    export.write_sets(rows, str(tmp_path / "single"), 5, single_file=True)
    assert {k: "".join(v) for k, v in made[0].items()} == {k: v[0] for k, v in files_of(tmp_path / "single").items()}


def test_no_rows_write_no_file(spark, tmp_path):
    export.write_sets(rows_of(spark).limit(0), str(tmp_path / "o"), 5)
    assert files_of(tmp_path / "o") == {}


def test_files_are_digested_by_blocks(spark, tmp_path):
    (tmp_path / "f/a b=c").mkdir(parents=True)
    texts = {"f/x.bin": bytes(range(256)) * 50, "f/a b=c/y%20z.bin": b"abc", "f/empty.bin": b""}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, 2)  # a row that holds a file would fail
    try:
        with pytest.raises(Exception, match="maxLength|exceed"):
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "f")).select("content").collect()
        got = {(r.length, r.sha256) for r in export.file_hashes(spark, str(tmp_path / "f"), block=7).collect()}
    finally:
        spark.conf.unset(limit)
    assert got == {(len(d), hashlib.sha256(d).hexdigest()) for d in texts.values() if d}  # Spark lists no empty file
