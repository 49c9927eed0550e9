"""The registered queries of the splitting engine, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cupola.functions import columns as C
from cupola.functions import molecules as M
from cupola.functions import structure as S
from cupola.operators import audits, checks, dedup, dictionary, quota, splits
from cupola.operators.ordering import ranked
from cupola.plans.surrogates import SEED, arrivals, keyed, reactions, table
from cupola.sources import export
from cupola.sources.tables import spread, written

CODES = ["1.3", "2.8", "3", "4.4.1", "1.2.0"]
SPEC = [[("test", 120)], [("valid", 80), ("extra", 40)], [("train", 500)]]
AUTHOR_SPEC = [[[("author_od_test", 60)]], [[("doc_od_test", 60), ("ft", 20)], [("train", 300), ("id_test", 60), ("valid", 40)]]]
CLASSES = {"valid": 60, "id_test": 60, "train_limit": 400, "od_test": 80, "finetune": 20}
TERMS = [["blue"], ["red", "bolt"], ["green", "n"]]
#: What is put after a part's molecule: nothing, whole pieces, open branches and rings, loose bonds.
SPOILT = ["", "C", "(", "C1CC", "=", "=O", ")", "(C)", "..C", "[Xx]", "[Na+]", "C1CC1"]
CUTOFFS = [1996, 1998, 2000]
TEST_AMOUNT, VALID_PROPORTION = 100, 0.05
MOST_TRAIN, MOST_VALID = 900, 60

#: A part as a molecule string, from its number and size; documents of the text table are the strings that don't tokenise.
MOLECULE = "concat(repeat('C', cast(1 + p_size % 7 as int)), case when p_partkey % 3 = 0 then '(=O)O' when p_partkey % 3 = 1 then 'c1ccccc1Cl' else '[N+](=O)[O-]' end)"


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(MOLECULE).alias("smiles"))


def hier_class_filter(spark, sf):
    return reactions(spark, sf).where(C.in_class_set(F.col("name_rxn"), CODES)).select("key", "name_rxn")


def core_title(spark, sf):
    return reactions(spark, sf).select("key", C.core_title(F.col("title")).alias("core"))


def date_parts(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("full"))
    d = d.select("o_orderkey", F.substring("full", F.lit(1), (2 * (F.col("o_orderkey") % 5)).cast("int")).alias("d"))
    y, m, day = C.date_parts(F.col("d"))
    return d.select("o_orderkey", *[c.cast("string").alias(n) for c, n in ((y, "year"), (m, "month"), (day, "day"))])


def json_extract_default(spark, sf):
    props = F.from_json("props", "k long")
    return table(spark, sf, "events").select("event_id", F.coalesce(props["k"], F.lit(-1).cast("long")).alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("unk")).alias("absent"))


def cast_unknown(spark, sf):
    text = F.when(F.col("o_orderkey") % 4 == 0, "unk").when(F.col("o_orderkey") % 4 == 1, F.concat(F.col("o_custkey").cast("string"), F.lit(".5"))).otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", C.cast_int(text).cast("string").alias("v"))


def multiset_key(spark, sf):
    return keyed(spark, sf).select("rid", "key")


def multiset_expand(spark, sf):
    k = keyed(spark, sf)
    return k.select("rid", F.explode("reactants").alias("m")).select("rid", "m.smi", "m.n")


def multiset_rest(spark, sf):
    return keyed(spark, sf).select("rid", F.explode(C.multiset_minus(F.col("reactants"), F.col("products"))).alias("m")).select("rid", "m.smi", "m.n")


def jsonl_export(spark, sf):
    k = keyed(spark, sf)
    return k.select("rid", C.to_jsonl(F.col("reactants"), F.col("products"), F.col("key"), SEED).alias("line"))


def jsonl_roundtrip(spark, sf):
    k = keyed(spark, sf).withColumn("line", C.to_jsonl(F.col("reactants"), F.col("products"), F.col("key"), SEED))
    r, p = C.from_jsonl(F.col("line"))
    return k.select("rid", C.reaction_key(r, p).alias("back"), (C.reaction_key(r, p) == F.col("key")).alias("same"))


def tokenize_count(spark, sf):
    parts = molecules(spark, sf).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), "smiles")
    texts = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("smiles"))
    return parts.unionByName(texts).select("id", F.size(C.tokens(F.col("smiles"))).cast("long").alias("n_tokens"), C.tokenizes(F.col("smiles")).alias("round_trip"))


def token_limit_filter(spark, sf):
    return molecules(spark, sf).where(F.size(C.tokens(F.col("smiles"))) < 9).select("p_partkey", "smiles")


def _checked(spark, sf):
    """Orders as reactions of part molecules, each distinct molecule measured once, with the first check that each order fails."""
    parts = molecules(spark, sf)
    found = dictionary.measured(parts.select(F.col("smiles").alias("smi")))
    numbered = dictionary.joined(parts, found.select("smi", "n", "number"), "smiles").select("p_partkey", "number")
    items = table(spark, sf, "lineitem").join(numbered, F.col("l_partkey") == F.col("p_partkey"))
    # numbers are counted and moved; what is known of a molecule comes last
    counted = items.groupBy(F.col("l_orderkey").alias("rid"), (F.col("l_linenumber") <= 3).alias("left"), "number").agg(F.count("*").cast("int").alias("n"))
    known = found.groupBy("number").agg(*[F.first(c).alias(c) for c in ("form", *dictionary.MEASURES)], F.sum("n").alias("n"))
    item = F.struct(F.col("form").alias("smi"), "n", *dictionary.MEASURES)
    pick = lambda c: F.sort_array(F.collect_list(F.when(c, item))).cast(checks.MEASURED)
    both = dictionary.joined(counted, known, "number", by="number").groupBy("rid").agg(pick(F.col("left")).alias("reactants"), pick(~F.col("left")).alias("products"))
    return both.withColumn("first_failure", checks.first_failure(checks.registry(F.col("reactants"), F.col("products"), token_limit=40)))


def first_failure_counts(spark, sf):
    return checks.failure_counts(_checked(spark, sf), "first_failure")


def first_failure_detail(spark, sf):
    return _checked(spark, sf).where("first_failure is not null").select("rid", "first_failure")


def dedup_displacement(spark, sf):
    return dedup.survivors(dedup.shrunk(arrivals(spark, sf), "dkey", "ord", "name_rxn", "year"), "dkey", "ord", "name_rxn", "year").select("dkey", "ord", "name_rxn", F.col("year").cast("string").alias("year"))


def dup_count(spark, sf):
    return dedup.duplicate_count(arrivals(spark, sf), "dkey")


def year_histogram(spark, sf):
    return reactions(spark, sf).where("year is not null and year >= 1900").groupBy("year").agg(F.count("*").alias("n"))


def provenance_histogram(spark, sf):
    a = arrivals(spark, sf)
    years = dedup.provenance(a, "dkey", "year").select("dkey", F.lit("year").alias("kind"), F.col("year").cast("string").alias("value"), "n")
    names = dedup.provenance(a, "dkey", "name_rxn").select("dkey", F.lit("name_rxn").alias("kind"), F.col("name_rxn").alias("value"), "n")
    return years.unionByName(names)


def seeded_topk(spark, sf):
    rows = reactions(spark, sf).where("year is not null").withColumn("h", C.order_key(F.col("key"), SEED))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("year").orderBy("h", "key"))).where("rn <= 50").select("year", "key", F.col("rn").cast("long").alias("rn"))


def seeded_permutation(spark, sf):
    rows = reactions(spark, sf).select("key").withColumn("h", C.order_key(F.col("key"), SEED))
    return ranked(rows, "h", "key").select("key", "rank")


def doc_quota_fill(spark, sf):
    return quota.split_documents(reactions(spark, sf), "key", "doc", SPEC, SEED, jurisdiction="Cu").select("key", "doc", "level", "split")


def doc_quota_meta(spark, sf):
    return quota.split_meta(reactions(spark, sf), "doc", SPEC, SEED)


def level_slices(spark, sf):
    return quota.split_documents(reactions(spark, sf), "key", "doc", SPEC, SEED).groupBy("level", "split").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("n_docs"))


def author_first_claim(spark, sf):
    rows = reactions(spark, sf, authors=True)
    pairs = splits.author_documents(rows)
    return splits.claims(pairs, splits.author_ranks(pairs, SEED)).select("doc", "author_rank")


def author_doc_split(spark, sf):
    return splits.split_author_documents(reactions(spark, sf, authors=True), AUTHOR_SPEC, SEED, 20, 0, "Cu").select("key", "doc", "author_level", "split")


def _classes(spark, sf):
    return splits.split_classes(reactions(spark, sf), CODES, seed=SEED, jurisdiction="Cu", **CLASSES)


def namerxn_split(spark, sf):
    return _classes(spark, sf).select("key", "doc", "name_rxn", "split")


def class_counts_by_split(spark, sf):
    return _classes(spark, sf).groupBy("split", "name_rxn").agg(F.count("*").alias("n"))


def id_doc_antijoin(spark, sf):
    od, rest = splits.class_pools(reactions(spark, sf), CODES)
    return splits.without_documents(rest, od).select("key", "doc")


def term_warnings(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_name").alias("name_rxn_def"), F.col("p_brand").alias("name_rxn"))
    return splits.term_warnings(parts, TERMS)


def time_split_sizes(spark, sf):
    return splits.year_sizes(reactions(spark, sf), TEST_AMOUNT, VALID_PROPORTION)


def _years(spark, sf):
    # orders without a title count in a year's sizes and can't be taken, so sets fall short in proportion to the table; time_split_shortfalls reports by how much
    return splits.split_years(reactions(spark, sf), TEST_AMOUNT, VALID_PROPORTION, SEED, leeway=None)


def time_split_assign(spark, sf):
    return _years(spark, sf).select("key", "year", "split")


def time_split_plain(spark, sf):
    return splits.split_years(reactions(spark, sf), TEST_AMOUNT, VALID_PROPORTION, SEED, by_document=False).select("key", "year", "split")


def time_split_shortfalls(spark, sf):
    return splits.year_shortfalls(reactions(spark, sf), TEST_AMOUNT, VALID_PROPORTION, SEED)


def time_set_sizes(spark, sf):
    return splits.set_sizes(_years(spark, sf))


def cutoff_training_sets(spark, sf):
    # read four times: the sizes, twice the counts, the rows
    split = written(_years(spark, sf).select("key", "year", "split"), "yearsplit")
    most = splits.controlled_size(split, CUTOFFS, MOST_TRAIN, control=True)
    return splits.cutoff_sets(split, CUTOFFS, most, MOST_VALID, SEED).select("cutoff", "split", "key")


def train_size_control(spark, sf):
    split = _years(spark, sf).where("split = 'train'")
    marks = spark.createDataFrame([(c,) for c in CUTOFFS], "cutoff int")
    return split.join(F.broadcast(marks), F.col("year") <= F.col("cutoff")).groupBy("cutoff").agg(F.count("*").alias("possible"), F.greatest(F.count("*") - MOST_TRAIN, F.lit(0)).cast("long").alias("excluded"))


def _excluded(rows):
    return {"even": rows.where("rid % 2 = 0"), "old": rows.where("year < 1998")}


def bespoke_filtered(spark, sf):
    rows = reactions(spark, sf)
    return splits.bespoke(rows, CODES, list(_excluded(rows).values()))[1].select("key", "name_rxn")


def bespoke_overlap_report(spark, sf):
    rows = reactions(spark, sf)
    return splits.overlap_report(splits.bespoke(rows, CODES, [])[0], _excluded(rows))


def bespoke_referential_check(spark, sf):
    rows = reactions(spark, sf)
    return splits.missing_keys(table(spark, sf, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).cast("string").alias("key")), rows)


def audit_pairwise_overlap(spark, sf):
    rows = reactions(spark, sf).withColumn("split", F.concat(F.lit("s"), C.hash_split(F.col("key"), SEED, 3).cast("string")))
    return audits.pairwise(rows, "doc")


def audit_author_containment(spark, sf):
    """The author split's own sets: its out-of-distribution rows against its training rows, with how many of their authors train."""
    split = splits.split_author_documents(reactions(spark, sf, authors=True), AUTHOR_SPEC, SEED, 20, 0, "Cu")
    split = written(split.where("split in ('author_od_test', 'doc_od_test', 'train')").select("key", "authors", "split"), "authorsplit")
    return audits.containment(split.where("split in ('author_od_test', 'doc_od_test')"), split.where("split = 'train'"))


def audit_doc_positive_control(spark, sf):
    split = _classes(spark, sf).where("split in ('train', 'id_test')")
    return audits.shared(split, "doc").agg(F.count("*").alias("n_shared"))


def audit_class_overlap(spark, sf):
    split = _classes(spark, sf).withColumn("side", F.when(F.col("split").isin("ft", "od_test"), "od").otherwise("id"))
    return audits.shared(split, "name_rxn", "side").agg(F.count("*").alias("n_shared"))


def audit_keys_disjoint(spark, sf):
    split = _classes(spark, sf)
    shared = audits.shared(split, "key").agg(F.count("*").alias("n_shared"))
    return shared.crossJoin(audits.repeats(split, "key").agg(F.count("*").alias("n_repeats")))


def audit_jurisdiction(spark, sf):
    return audits.jurisdictions(reactions(spark, sf), "doc")


def audit_document_years(spark, sf):
    return audits.documents_of_many_years(reactions(spark, sf))


def changed_bonds_fullouter(spark, sf):
    """Line items as bonds of mapped atoms before (odd lines) and after (even lines) a reaction."""
    rows = table(spark, sf, "lineitem")
    bond = F.struct(F.least(F.col("l_partkey") % 10, F.col("l_suppkey") % 10).alias("a"), F.greatest(F.col("l_partkey") % 10, F.col("l_suppkey") % 10).alias("b"))
    sides = rows.select(F.col("l_orderkey").alias("rid"), bond.alias("bond"), (F.col("l_linenumber") % 3 + 1).cast("double").alias("ord"), (F.col("l_linenumber") % 2 == 1).alias("before"))
    return checks.changed_bonds(sides, "rid").select("rid", "a", "b", "ord")


#: Mapped reactions over a part: k carbons in a row (2 to 8 by its size), what happens to them by its number.
_K = "cast(2 + p_size % 7 as int)"
_ROW = "array_join(transform(sequence({a}, {b}), i -> concat('[CH2:', i, ']')), '')"
_CHAIN = _ROW.format(a=1, b=_K)
_BENZENE = "[cH:61]1[cH:62][cH:63][cH:64][cH:65][c:66]1"
MAPPED = f"""case p_partkey % 6
  when 0 then concat({_CHAIN}, '[Cl:90].[CH3:91][NH2:92].[OH2:99]>CCO>[OH2:99].', {_CHAIN}, '[NH:92][CH3:91]')
  when 1 then concat('[CH2:31]=[CH:32]', {_CHAIN}, '[CH3:60].[HH]>>[CH3:31][CH2:32]', {_CHAIN}, '[CH3:60] |f|')
  when 2 then concat({_CHAIN}, '[CH2:50][Br:90]>>', replace({_CHAIN}, '[CH2:1]', '[CH2:1]%12'), '[CH2:50]%12.[BrH:90]')
  when 3 then concat('{_BENZENE}[Cl:90].[OH2:95].', {_CHAIN}, '>[Na+].[OH-]>{_BENZENE}[OH:95]')
  when 4 then concat('[OH:90]', {_CHAIN}, '[CH3:60].O.O>>[CH2:1]([OH:90])', {_ROW.format(a=2, b=_K)}, '[CH3:60].[OH2]')
  else concat({_CHAIN}, '[CH2:50][OH:90].O.OCC>>', {_CHAIN}, '[CH:50]=[O:90].O') end"""
#: Pairs of molecules over a part that a proton tells apart, or more than that.
CHARGED = """case p_partkey % 5
  when 0 then array(concat(c, 'C(=O)[O-]'), concat('OC(=O)', c)) when 1 then array(concat(c, 'C[NH3+]'), concat('NC', c))
  when 2 then array(concat(c, '[N+](=O)[O-]'), concat(c, '[NH+](O)[O-]')) when 3 then array(concat('[NH3+]C', c, 'C(=O)[O-]'), concat('OC(=O)', c, 'CN'))
  else array(concat(c, 'C[N+](C)(C)C'), concat(c, 'CN(C)C')) end"""
#: Spellings of an alcohol of so many carbons, and of an amino acid.
SPELLINGS = """case p_partkey % 4 when 0 then concat(c, 'O') when 1 then concat('O', c) when 2 then concat('C(O)', substr(c, 2)) else concat('N[C@@H](', c, ')C(=O)O') end"""


def _parts(spark, sf, *columns):
    return spread(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").withColumn("c", F.expr("repeat('C', cast(1 + p_size % 7 as int))")).select("p_partkey", *columns)


def mapped_reactions(spark, sf):
    return _parts(spark, sf, F.expr(MAPPED).alias("rxn"))


def changed_bonds_text(spark, sf):
    """Bonds that change, from mapped reaction strings."""

    def changed(strings):
        left, _, right = S.sides_of(F.col("rxn"))
        sides = S.with_molecules(strings.select("rxn", "n", left.alias("l"), right.alias("r")), before="l", after="r")
        return sides.select("rxn", "n", S.changed_bonds(F.col("before"), F.col("after")).alias("changed"))

    return dictionary.once(mapped_reactions(spark, sf), "rxn", changed).select("p_partkey", F.explode("changed").alias("x")).select("p_partkey", "x.a", "x.b", "x.ord")


def reagent_split(spark, sf):
    """Mapped reactions with their reagents told apart by the reaction centre."""
    return dictionary.once(mapped_reactions(spark, sf), "rxn", lambda strings: S.with_reagents(strings, "rxn"))


def neutral_pairs(spark, sf):
    """Whether two molecules are one, and one once protons have balanced their charges."""
    rows = _parts(spark, sf, F.expr(CHARGED).alias("pair"))
    known = dictionary.measured(rows.select(F.explode("pair").alias("smi"))).select("smi", "n", "key", "neutral_key")
    for side in range(2):
        own = dictionary.joined(rows.withColumn("s", F.get("pair", F.lit(side))), known, "s")
        rows = own.drop("s").withColumnsRenamed({"key": f"k{side}", "neutral_key": f"n{side}"})
    return rows.select("p_partkey", (F.col("k0") == F.col("k1")).alias("same"), (F.col("n0") == F.col("n1")).alias("same_neutral"))


def canonical_spellings(spark, sf):
    """The spelling that stands for a part's molecule in the whole table, and how often it is written as here."""
    rows = _parts(spark, sf, F.expr(SPELLINGS).alias("smi"))
    known = dictionary.measured(rows).select("smi", "n", "form")
    return rows.join(known, "smi").select("p_partkey", "smi", "form", "n")


def reaction_fingerprints(spark, sf):
    """Summed circular fingerprints of both sides of mapped reactions, reagents left out: (p_partkey, side, bit, n)."""
    rows = reagent_split(spark, sf).select("p_partkey", F.explode(F.array(F.struct(F.lit("reactants").alias("side"), F.col("reactants").alias("text")), F.struct(F.lit("products").alias("side"), F.col("products").alias("text")))).alias("s"))
    summed = dictionary.once(rows.select("p_partkey", "s.side", "s.text"), "text", lambda strings: S.with_summed_bits(strings, "text"))
    return summed.select("p_partkey", "side", F.explode("bits").alias("x")).select("p_partkey", "side", "x.bit", "x.n")


def atom_map_numbers(spark, sf):
    mapped = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("[C:"), F.col("p_size").cast("string"), F.lit("][N:"), (F.col("p_partkey") % 7).cast("string"), F.lit("]C")).alias("s"))
    return mapped.select("p_partkey", F.array_join(F.transform(C.atom_maps(F.col("s")), lambda x: x.cast("string")), ",").alias("maps"))


def molecule_measures(spark, sf):
    m = molecules(spark, sf)
    s = F.col("smiles")
    return m.select("p_partkey", M.heavy_atoms(s).cast("long").alias("heavy"), M.has_carbon(s).alias("carbon"), M.bonds(s).cast("long").alias("bonds"))


def fp_sum(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return e.groupBy("label", "pos").agg(F.round(F.sum(F.round(F.col("v").cast("double") * 1_000_000).cast("long")) / 1_000_000, 4).alias("total"))


def sha256_manifest(spark, sf):
    """Per split: rows, and the SHA-256 of its lines, which does not depend on how they are dealt to files."""
    lines = _classes(spark, sf).select("split", F.concat_ws("|", "key", "name_rxn").alias("value"))
    return export.content_hash(lines)


def unknown_counts(spark, sf):
    return quota.unknown_counts(reactions(spark, sf, authors=True))


def unreadable_filter(spark, sf):
    """Parts as molecules, some of them spoilt by their number, and texts: those that aren't readable."""
    parts = spread(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.expr(MOLECULE).alias("smiles"))
    parts = parts.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat("smiles", F.element_at(F.array(*map(F.lit, SPOILT)), (F.col("p_partkey") % len(SPOILT) + 1).cast("int"))).alias("smiles"))
    texts = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("smiles"))
    return parts.unionByName(texts).where(~M.readable(F.col("smiles"))).select("id")


def rxn_dedup_text(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.md5(F.col("text").cast("binary")).alias("dkey"), F.when(F.col("source") != "src0", F.col("lang")).alias("name"), F.when(F.col("doc_id") % 9 != 0, F.col("n_chars") % 50).cast("int").alias("year"))
    return dedup.survivors(dedup.shrunk(d, "dkey", "ord", "name", "year"), "dkey", "ord", "name", "year").select("dkey", "ord")


NAMES = (
    "hier_class_filter", "class_counts_by_split", "core_title", "date_parts", "json_extract_default", "cast_unknown", "multiset_key", "multiset_expand", "multiset_rest", "jsonl_export", "jsonl_roundtrip",
    "tokenize_count", "token_limit_filter", "first_failure_counts", "first_failure_detail", "dedup_displacement", "dup_count", "year_histogram", "provenance_histogram", "seeded_topk",
    "seeded_permutation", "doc_quota_fill", "doc_quota_meta", "level_slices", "author_first_claim", "author_doc_split", "namerxn_split", "id_doc_antijoin", "term_warnings", "time_split_sizes",
    "time_split_assign", "time_split_plain", "time_split_shortfalls", "time_set_sizes", "unknown_counts", "unreadable_filter", "cutoff_training_sets", "train_size_control", "bespoke_filtered", "bespoke_overlap_report", "bespoke_referential_check",
    "audit_pairwise_overlap", "audit_author_containment", "audit_doc_positive_control", "audit_class_overlap", "audit_keys_disjoint", "audit_jurisdiction", "audit_document_years",
    "changed_bonds_fullouter", "changed_bonds_text", "reagent_split", "neutral_pairs", "canonical_spellings", "reaction_fingerprints", "atom_map_numbers", "molecule_measures", "fp_sum", "sha256_manifest", "rxn_dedup_text",
)
