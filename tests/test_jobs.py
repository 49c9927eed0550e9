"""Raw files to clean table to splits, end to end."""

import json

import pytest
from pyspark.sql import functions as F

from cupola.plans import configs, jobs
from cupola.sources import export, raw

RXN = "CCCCCC(=O)O.CO>>CCCCCC(=O)OC"


def record(i, **data):
    base = {"namerxn": f"{i % 3 + 1}.{i % 2}", "namerxndef": "x", "date": f"{2000 + i % 4}0102", "smiles": RXN.replace("CCCCCC", "C" * (6 + i)), "authors": [f"A{i % 7}"]}
    return {"title": f"US{i % 12}_A", "data": base | data}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    (root / "a/b").mkdir(parents=True)
    rows = [record(i) for i in range(80)]
    (root / "a/reactions_wbib_1.json").write_text("\n".join(map(json.dumps, rows[:40])))
    (root / "a/b/x_reactions_wbib").write_text("\n".join(map(json.dumps, [*rows[40:], record(0, date="1990"), record(5, smiles="nonsense"), record(6, smiles="C.C>>C"), {"data": {"documentId": "US99"}}])))
    (root / "a/other.json").write_text("not json")
    return str(root)


def test_raw_reading(spark, corpus):
    rows = raw.flatten(raw.ordered(raw.read_raw(spark, corpus)))
    got = rows.orderBy("ingest_ord").collect()
    assert [r.ingest_ord for r in got] == list(range(84))
    last = [r for r in got if r.title == "US99"][0]
    assert (last.name_rxn, last.year, last.smiles, last.authors) == (None, None, None, None)
    assert {r.month for r in got} == {1, None}


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "reactions_wbib").write_text(json.dumps(record(1)) + "\n{broken")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        raw.read_raw(spark, str(tmp_path)).count() or raw.read_raw(spark, str(tmp_path)).collect()
    loose = raw.read_raw(spark, str(tmp_path), strict=False)
    assert [r[raw.BAD] for r in loose.collect() if r[raw.BAD]] == ["{broken"]


@pytest.fixture(scope="module")
def cleaned(spark, corpus, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("clean") / "run")
    return out, jobs.clean(spark, corpus, out)


def test_cleaning(spark, corpus, cleaned):
    out, counts = cleaned
    assert counts == {"rows": 84, "unreadable": 2, "failed": 1, "kept": 80, "arrivals": 81}
    table = spark.read.parquet(f"{out}/clean")
    assert table.select("key").distinct().count() == 80
    assert table.where("year = 1990").count() == 1  # the earlier year displaced its copy
    years = spark.read.parquet(f"{out}/provenance/year")
    assert years.agg(F.sum("n")).first()[0] == 81
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        jobs.clean(spark, corpus, out)


def test_class_split_job(spark, cleaned, tmp_path):
    params = configs.SplitParams(f"{cleaned[0]}/clean", "t", 1, valid_amount=3, id_test_amount=3, hard_limit_train=10, od_test_amount=5, finetune_amount=1, other_args={"exclude_all_relevant_docs": False})
    found = jobs.run_split(spark, params, str(tmp_path / "o"), jobs.class_split(configs.ClassSpec("x", ["1"])))
    assert {s["split"]: s["n"] for s in found["sets"]} == {"valid": "3", "id_test": "3", "train": "10", "od_test": "5", "ft": "1"}
    back = raw.read_split(spark, str(tmp_path / "o/sets/split=train"))
    assert splits_keys(back) <= splits_keys(spark.read.parquet(f"{cleaned[0]}/clean"))
    hashes = export.file_hashes(spark, str(tmp_path / "o/sets")).collect()
    assert all(len(h.sha256) == 64 for h in hashes)
    manifest = json.loads(spark.read.text(str(tmp_path / "o/manifest")).first()[0])
    assert manifest["params"]["name"] == "t"
    assert manifest["amounts"] == {"n_rows": 80, "unknown_titles": 0, "unknown_authors": 0, "n_docs": 12, "n_authors": 7}


def splits_keys(df):
    return {r.key for r in df.select("key").collect()}


def test_time_and_bespoke_jobs(spark, cleaned, tmp_path):
    p = configs.TimeParams(f"{cleaned[0]}/clean", "t", 1, [2000, 2002], 3, 12, 4, document_split=False, control_for_training_size=True, valid_proportion=0.2)
    found = jobs.run_time_split(spark, p, str(tmp_path / "time"))
    sizes = {(s["cutoff"], s["split"]): int(s["n"]) for s in found["cutoffs"]["sets"]}
    assert sizes[("2002", "train")] <= 12
    assert {int(s["n"]) for s in found["test"]["sets"]} == {3}
    for a in found["cutoffs"]["amounts"]:
        assert a["selected"] == sizes[(str(a["cutoff"]), a["split"])] == a["possible"] - a["excluded"]
    train = str(tmp_path / "time/train_val_splits/sets/cutoff=2000/split=train")
    b = configs.BespokeParams("b", ["1"], f"{cleaned[0]}/clean", reactions_jsonl_datasets_to_exclude=[train])
    got = jobs.run_bespoke(spark, b, str(tmp_path / "b"))
    n = {s["split"]: int(s["n"]) for s in got["sets"]}
    assert n["all"] - n["filtered"] == got["overlaps"][train] > 0


def test_configs(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "n", "excluded_name_rxns": ["1"], "extra": 1}))
    assert configs.class_specs(str(tmp_path))[0].other_args == {"extra": 1}
    (tmp_path / "c.ini").write_text("[paths]\nroot = /x\n")
    assert configs.dataset_paths(str(tmp_path / "c.ini")) == {"root": "/x"}
    with pytest.raises(ValueError, match="valid_proportion"):
        configs.TimeParams("", "", 0, [], 1, 1, 1, valid_proportion=2.0)
