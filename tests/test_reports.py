"""What the jobs report: rows lost by years, warnings of terms, hashes, combined sets, audits of written sets."""

import json

import pytest
from pyspark.sql import functions as F

from cupola.operators import quota, splits
from cupola.plans import configs, jobs
from cupola.sources import export
from tests.test_operators import reactions


def test_a_year_of_one_document_raises(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("key"), F.lit("US1_A").alias("title"), F.lit(2000).alias("year"))
    with pytest.raises(quota.QuotaError, match="year 2000 falls short by 855"):
        splits.split_years(rows, 100, 0.05, 1)
    assert splits.split_years(rows, 100, 0.05, 1, leeway=None).count() == 100
    got = {r.split: (r.target, r.n_rows, r.short) for r in splits.year_shortfalls(rows, 100, 0.05, 1).collect()}
    assert got == {"test": (100, 100, 0), "valid": (45, 0, 45), "train": (855, 0, 855)}


def test_cutoffs_rank_only_what_can_be_chosen(spark):
    import hashlib

    rows = [(f"k{i}", 1990 + i % 4, "train" if i % 5 else "valid") for i in range(4000)]
    out = splits.cutoff_sets(spark.createDataFrame(rows, "key string, year int, split string"), [1991, 1993], 40, 7, 3).collect()
    for cutoff in (1991, 1993):
        for split, most in (("train", 40), ("valid", 7)):
            own = sorted((k for k, y, s in rows if y <= cutoff and s == split), key=lambda k: hashlib.md5(f"{k}:3:{cutoff}".encode()).hexdigest())
            assert {r.key for r in out if r.cutoff == cutoff and r.split == split} == set(own[:most])


def test_hash_of_lines_by_plain_digests(spark):
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = [f"line {i % 90}" for i in range(300)]
    got = export.content_hash(spark.createDataFrame([("s", x) for x in lines], "split string, value string").repartition(7)).first()
    by: dict = {}
    for h in sorted(map(sha, lines)):
        by.setdefault(h[:5], []).append(h)
    mid: dict = {}
    for p in sorted(by):
        mid.setdefault(p[:2], []).append(sha("".join(by[p])))
    assert (got.n, got.sha256) == (300, sha("".join(sha("".join(mid[q])) for q in sorted(mid))))


def test_specs_warnings_hashes_and_audits(spark, tmp_path):
    rows = reactions(spark).withColumns({"reactants": F.array(F.struct(F.concat(F.lit("C"), F.col("key")).alias("smi"), F.lit(1).alias("n")))})
    rows = rows.withColumn("products", F.array(F.struct(F.lit("O").alias("smi"), F.lit(1).alias("n")))).withColumn("key", F.concat(F.lit("C"), F.col("key"), F.lit(">>O")))
    rows.write.parquet(str(tmp_path / "clean"))
    (tmp_path / "specs").mkdir()
    for name, codes in (("one", ["1"]), ("two", ["2"])):
        (tmp_path / f"specs/{name}.json").write_text(json.dumps({"name": name, "excluded_name_rxns": codes, "terms_to_check": [["chloro", "suzuki"]]}))
    params = configs.SplitParams(str(tmp_path / "clean"), "t", 1, valid_amount=3, id_test_amount=3, hard_limit_train=10, od_test_amount=5, finetune_amount=2, other_args={"exclude_all_relevant_docs": False})
    jobs.log_to(str(tmp_path / "log.txt"))
    made = jobs.run_class_specs(spark, params, str(tmp_path / "specs"), str(tmp_path / "out"))
    assert set(made) == {"one", "two"}
    for name, found in made.items():
        assert found["term_warnings"] and all(w["term_group"] == "chloro+suzuki" for w in found["term_warnings"])
        assert [s["split"] for s in found["combined"]] == ["train_and_ft"] and found["combined"][0]["n"] == "12"
        assert len(found["files_sha256"]) == len(found["input_sha256"]) == 64
    assert made["one"]["input_sha256"] == made["two"]["input_sha256"]
    sets = str(tmp_path / "out/one/sets/split=")
    got = jobs.audit_sets(spark, [(f"{sets}train", f"{sets}od_test"), (f"{sets}train", f"{sets}train")], str(tmp_path / "clean"))
    assert (got[0]["keys"], got[0]["classes"], got[0]["missing"]) == (0, 0, 0)
    assert got[1]["keys"] == 10
    log = (tmp_path / "log.txt").read_text()
    assert "holds the terms" in log and "od_test 5" in log
