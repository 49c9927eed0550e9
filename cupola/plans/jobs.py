"""Whole jobs: cleaning a raw corpus, and splitting a clean table into files with a manifest."""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cupola.functions import columns as C
from cupola.functions.molecules import strip_isotopes, strip_maps
from cupola.operators import audits, checks, dedup, dictionary, quota, splits
from cupola.plans.configs import BespokeParams, ClassSpec, SplitParams, TimeParams, class_specs
from cupola.sources import export, raw
from cupola.sources.tables import written

LOG = logging.getLogger("cupola")


def log_to(path: str) -> None:
    """Sends counts and warnings of the jobs, and Python's warnings, to standard output and a file of the driver."""
    logging.captureWarnings(True)
    for name in ("cupola", "py.warnings"):
        log = logging.getLogger(name)
        log.setLevel(logging.INFO)
        for handler in (logging.StreamHandler(sys.stdout), logging.FileHandler(path)):
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            log.addHandler(handler)


def canonical(rows: DataFrame) -> DataFrame:
    """Flat rows with reactants, products, key and first_failure; all NULL where the text is no reaction, or one of its molecules isn't readable.

    Molecules are parsed, keyed and measured once for every distinct string; all spellings of a molecule become one, so
    equal reactions meet in one key. Only row numbers and molecules move for that; rows meet what was found once.
    """
    left, right = C.reaction_molecules(F.col("smiles"))
    plain = lambda ms, side: F.transform(ms, lambda x: F.struct(F.lit(side).alias("left"), strip_isotopes(strip_maps(x)).alias("text")))
    staged = written(rows.select("*", F.monotonically_increasing_id().alias("_row"), F.concat(plain(left, True), plain(right, False)).alias("_molecules")), "reactions")
    each = staged.select("_row", F.explode("_molecules").alias("x")).select("_row", "x.left", "x.text")
    known = written(dictionary.measured(each.select(F.col("text").alias("smi"))), "dictionary")
    item = F.struct(F.col("form").alias("smi"), *dictionary.MEASURES)
    pick = lambda c: F.collect_list(F.when(c, item))
    found = dictionary.joined(each, known, "text").groupBy("_row").agg(F.bool_or(F.col("form").isNull()).alias("_bad"), pick(F.col("left")).alias("_l"), pick(~F.col("left")).alias("_r"))
    fields = ", ".join(f"y.{c}" for c in dictionary.MEASURES)
    # of a row's molecules, each once with its count, in order
    counted = lambda c: F.expr(f"array_sort(transform(array_distinct({c}), y -> struct(y.smi as smi, size(filter({c}, z -> z.smi = y.smi)) as n, {fields})))").cast(checks.MEASURED)
    sided = staged.join(found, "_row", "left").withColumns({"_ok": F.col("_molecules").isNotNull() & ~F.coalesce("_bad", F.lit(False)), "_l": F.coalesce(counted("_l"), F.array().cast(checks.MEASURED)), "_r": F.coalesce(counted("_r"), F.array().cast(checks.MEASURED))})
    short = lambda c: F.when(F.col("_ok"), F.transform(c, lambda x: F.struct(x["smi"].alias("smi"), x["n"].alias("n"))))
    sided = sided.withColumns({"reactants": short("_l"), "products": short("_r"), "first_failure": F.when(F.col("_ok"), checks.first_failure(checks.registry(F.col("_l"), F.col("_r"))))})
    return sided.select(*rows.columns, "reactants", "products", C.reaction_key(F.col("reactants"), F.col("products")).alias("key"), "first_failure")


def clean(spark: SparkSession, roots: str | list[str], out: str, strict: bool = True, subfolders: str | list[str] | None = None) -> dict[str, int]:
    """Raw files (below a root's named extract subfolders, if given) to `out/clean`, with `out/failures` (raw text and first failing check), `out/unreadable` and `out/provenance` beside it. Returns the counts."""
    if subfolders is not None:
        roots = [p for r in ([roots] if isinstance(roots, str) else roots) for p in raw.subfolder_paths(r, subfolders)]
    checked = canonical(raw.flatten(raw.ordered(raw.read_raw(spark, roots, strict))))
    checked.write.mode("errorifexists").parquet(f"{out}/staged")  # read again by every step below
    staged = spark.read.schema(checked.schema).parquet(f"{out}/staged")
    staged.where("key is null").select("smiles").distinct().write.parquet(f"{out}/unreadable")
    checks.failures_by_smiles(staged, "smiles", "first_failure").write.parquet(f"{out}/failures")
    good = staged.where("key is not null and first_failure is null").drop("first_failure")
    for value in ("year", "name_rxn", "smiles"):
        dedup.provenance(good, "key", value).write.parquet(f"{out}/provenance/{value}")
    # a short hash deals the fold: the key itself may be long
    hashed = good.withColumn("_k", F.sha2(F.col("key").cast("binary"), 256))
    dedup.survivors(hashed, "_k", "ingest_ord", "name_rxn", "year").drop("_k").write.parquet(f"{out}/clean")
    count = lambda df: df.count()
    found = {"rows": count(staged), "unreadable": count(staged.where("key is null")), "failed": count(staged.where("first_failure is not null")), "kept": count(spark.read.parquet(f"{out}/clean")), "arrivals": count(good)}
    LOG.info("%s: %s", out, found)
    return found


def _publish(spark: SparkSession, split: DataFrame, out: str, params: dict, seed: int, by: tuple[str, ...] = ("split",), meta: dict | None = None) -> dict:
    """Audits, writes and describes a split. Raises if a key stands in two sets."""
    table = f"{out}/assigned"
    split.write.mode("errorifexists").parquet(table)
    rows = spark.read.schema(split.schema).parquet(table)
    if by == ("split",):
        _disjoint(rows)
    export.write_sets(rows, f"{out}/sets", seed, by)
    describe = lambda x: [{c: str(r[c]) for c in (*by, "n", "sha256")} for r in export.content_hash(export.lines(x, seed, by), by=by).collect()]
    found = {"params": export.jsonable(params), "sets": describe(rows), **(meta or {})}
    # training and fine-tuning sets once more as one
    tuned = sorted(s["split"] for s in found["sets"] if by == ("split",) and s["split"].startswith("ft"))
    if tuned:
        both = export.combined(rows, ["train", *tuned], f"train_and_{'_'.join(tuned)}")
        export.write_sets(both, f"{out}/combined", seed, by)
        found["combined"] = describe(both)
    # of every file written, and of the clean table's files: as a table, and its digest in the manifest
    hashes = {"files": [f"{out}/sets", *([f"{out}/combined"] if tuned else [])], "input": [params["clean_data_location"]] if params.get("clean_data_location") else []}
    for name, paths in hashes.items():
        for i, path in enumerate(paths):
            export.file_hashes(spark, path).write.mode("append" if i else "errorifexists").parquet(f"{out}/hashes/{name}")
        if paths:
            own = spark.read.parquet(f"{out}/hashes/{name}").select(F.lit(name).alias("split"), F.concat_ws(" ", F.col("sha256"), F.regexp_extract("path", "[^/]*$", 0)).alias("value"))
            found[f"{name}_sha256"] = export.content_hash(own).first().sha256
    export.write_manifest(spark, f"{out}/manifest", found)
    LOG.info("%s: %s", out, ", ".join(f"{'/'.join(s[c] for c in by)} {s['n']}" for s in found["sets"]))
    return found


def _disjoint(rows: DataFrame, by: tuple[str, ...] = ()) -> None:
    """Raises if a key stands twice in one set, or in two sets of a group of `by`."""
    grouped = rows.withColumn("_key", F.concat_ws("|", *by, "key"))
    if audits.shared(grouped, "_key").limit(1).count() or audits.repeats(grouped, "_key").limit(1).count():
        raise ValueError("a reaction stands in a split twice or in two splits")


#: The split rows, alone or with what the manifest is to say of them.
SplitFunction = Callable[[DataFrame, SplitParams], DataFrame | tuple[DataFrame, dict]]


def run_split(spark: SparkSession, params: SplitParams, out: str, split: SplitFunction) -> dict:
    """A split function applied to the clean table, its sets written to out."""
    rows = spark.read.parquet(params.clean_data_location)
    made = split(rows, params)
    found, meta = made if isinstance(made, tuple) else (made, {})
    return _publish(spark, found, out, asdict(params), params.random_seed, meta=_amounts(rows) | meta)


def _amounts(rows: DataFrame) -> dict:
    """Counts of the clean table for the manifest: rows, unknown titles and authors, documents and authors in all."""
    return {"amounts": quota.unknown_counts(rows.withColumn("doc", C.core_title(F.col("title")))).first().asDict()}


def class_split(spec: ClassSpec, jurisdiction: str | None = "US") -> SplitFunction:
    def split(rows: DataFrame, p: SplitParams) -> DataFrame:
        return splits.split_classes(rows, spec.excluded_name_rxns, p.valid_amount, p.id_test_amount, p.hard_limit_train, p.od_test_amount, p.finetune_amount, p.random_seed, p.other_args.get("exclude_all_relevant_docs", True), jurisdiction=jurisdiction)

    return split


def author_document_split(jurisdiction: str | None = "US", overbuffer: int = 200) -> SplitFunction:
    def split(rows: DataFrame, p: SplitParams) -> tuple[DataFrame, dict]:
        found, used = splits.author_document_sets(rows, p.od_test_amount_authors, p.od_test_amount_docs, p.train_amount, p.id_test_amount, p.valid_amount, p.random_seed, p.finetune_amount, overbuffer, jurisdiction=jurisdiction)
        return found, {"authors_used": used}

    return split


def run_class_specs(spark: SparkSession, params: SplitParams, folder: str, out: str, jurisdiction: str | None = "US") -> dict[str, dict]:
    """One class split for every specification file of a folder, each below out by its name, with the classes whose definitions hold its terms in the manifest and the log."""
    rows, made = spark.read.parquet(params.clean_data_location), {}
    amounts = _amounts(rows)
    for spec in class_specs(folder):
        warned = term_notes(rows, spec.terms_to_check, spec.excluded_name_rxns)
        split = class_split(spec, jurisdiction)(rows, params)
        made[spec.name] = _publish(spark, split, f"{out}/{spec.name}", asdict(params) | {"spec": asdict(spec)}, params.random_seed, meta=amounts | {"term_warnings": warned})
    return made


def term_notes(rows: DataFrame, terms: list[list[str]], codes: list[str]) -> list[dict]:
    """Classes outside the codes whose definitions hold all terms of a group, logged as warnings. One row a class."""
    outside = rows.where(~C.in_class_set(F.col("name_rxn"), codes) & F.col("name_rxn_def").isNotNull())
    found = [r.asDict() for r in splits.term_warnings(outside, terms).orderBy("term_group", "name_rxn", "name_rxn_def").collect()] if terms else []
    for r in found:
        LOG.warning("class %s (%s) holds the terms %s but isn't among the codes", r["name_rxn"], r["name_rxn_def"], r["term_group"])
    return found


def audit_sets(spark: SparkSession, pairs: list[tuple[str, str]], clean: str) -> list[dict]:
    """For each pair of written sets (training, out of distribution): how many keys, documents and classes they share, by the clean table's rows of their keys, and keys that the table lacks."""
    table, out = spark.read.parquet(clean).withColumn("doc", C.core_title(F.col("title"))).select("key", "doc", "name_rxn"), []
    for train, ood in pairs:
        both = raw.read_split(spark, train).select("key", F.lit("train").alias("split")).unionByName(raw.read_split(spark, ood).select("key", F.lit("ood").alias("split")))
        known = both.join(table, "key", "left").select("key", "split", "doc", "name_rxn")
        n = lambda value: audits.shared(known, value).count()  # noqa: B023, E731
        out.append({"train": train, "ood": ood, "keys": n("key"), "docs": n("doc"), "classes": n("name_rxn"), "missing": both.join(table, "key", "left_anti").count()})
        LOG.info("audit: %s", out[-1])
    return out


def run_time_split(spark: SparkSession, p: TimeParams, out: str) -> dict[str, dict]:
    """Test sets by year, and training and validation sets by cutoff."""
    rows = spark.read.parquet(p.clean_data_location)
    split = splits.split_years(rows, p.test_amount, p.valid_proportion, p.random_seed, p.document_split, p.leeway)
    split.write.mode("errorifexists").parquet(f"{out}/years")
    split = spark.read.schema(split.schema).parquet(f"{out}/years")
    _disjoint(split)
    if p.document_split:
        inside = split.withColumn("_doc", F.concat_ws("|", "year", "doc"))
        if audits.shared(inside, "_doc").limit(1).count():
            raise ValueError("a document stands in two sets of a year")
    used, usable = split.count(), rows.where("year is not null and year >= 1900").count()
    lost = {"rows": rows.count(), "of known year": usable, "in a set": used}
    if p.document_split:
        lost["short"] = [r.asDict() for r in splits.year_shortfalls(rows, p.test_amount, p.valid_proportion, p.random_seed).where("short > 0").orderBy("year", "split").collect()]
    LOG.info("%s: %s", out, lost)
    most = splits.controlled_size(split, p.years_to_break, p.max_training_size, p.control_for_training_size)
    tests = _publish(spark, split.where("split = 'test'"), f"{out}/test_years", asdict(p), p.random_seed, ("year",))
    amounts = [r.asDict() for r in splits.cutoff_amounts(split, p.years_to_break, most, p.max_val_size).orderBy("cutoff", "split").collect()]
    train = splits.cutoff_sets(split, p.years_to_break, most, p.max_val_size, p.random_seed)
    cutoffs = _publish(spark, train, f"{out}/train_val_splits", asdict(p), p.random_seed, ("cutoff", "split"), {"max_train": most, "counts": lost, "amounts": amounts})
    _disjoint(train, ("cutoff",))
    return {"test": tests, "cutoffs": cutoffs}


def run_bespoke(spark: SparkSession, p: BespokeParams, out: str) -> dict:
    """The classes' reactions, all and without those of earlier training sets, which must all be in the clean table."""
    rows = spark.read.parquet(p.clean_data_location)
    sets = {path: raw.read_split(spark, path) for path in p.reactions_jsonl_datasets_to_exclude}
    for path, x in sets.items():
        if splits.missing_keys(x, rows).limit(1).count():
            raise ValueError(f"{path} has reactions that the clean table lacks")
    warned = term_notes(rows, p.terms_to_check, p.namerxn_codes)
    every, kept = splits.bespoke(rows, p.namerxn_codes, list(sets.values()))
    both = kept.withColumn("split", F.lit("filtered"))
    if p.create_exclusion_ignored_set:
        both = both.unionByName(every.withColumn("split", F.lit("all")))
    overlaps = {r.dataset: r.n_overlap for r in splits.overlap_report(every, sets).collect()} if sets else {}
    # the two sets overlap by intent, so they are published by name and set together
    return _publish(spark, both.withColumn("name", F.lit(p.name)), out, asdict(p), p.random_seed, ("name", "split"), {"overlaps": overlaps, "term_warnings": warned})
