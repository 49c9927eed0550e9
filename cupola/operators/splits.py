"""The composite splitters: by author and document, by reaction class, by year, and bespoke class sets.

All take a reaction table with key, title, authors, name_rxn, name_rxn_def and year (NULL for unknown) and return
it with a `split` column; rows of no set are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cupola.functions.columns import author_name, core_title, in_class_set, matches_all, order_key
from cupola.operators.ordering import ranked, running
from cupola.operators.quota import QuotaError, assign, document_order, fill, levels_of, split_documents
from cupola.sources.tables import written


# --- by author and document -------------------------------------------------------------------------------------


def author_documents(rows: DataFrame) -> DataFrame:
    """Distinct (author, doc) of rows with a known title and authors; names in small letters, trimmed."""
    return rows.where(F.col("doc").isNotNull() & (F.size("authors") > 0)).select(F.explode(F.transform("authors", author_name)).alias("author"), "doc").where("author is not null").distinct()


def author_ranks(pairs: DataFrame, seed: int) -> DataFrame:
    authors = pairs.select("author").distinct().withColumn("_h", order_key(F.col("author"), seed, "author"))
    return ranked(authors, "_h", "author", "author_rank").select("author", "author_rank")


def claims(pairs: DataFrame, ranks: DataFrame) -> DataFrame:
    """(doc, author_rank): every document belongs to the first author in seeded order that lists it."""
    return pairs.join(ranks, "author").groupBy("doc").agg(F.min("author_rank").alias("author_rank"))


def author_levels(rows: DataFrame, spec: list, seed: int, overbuffer: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """((doc, author_level), [(level, last author rank)]): a level takes authors in order until their claimed documents hold its target plus the overbuffer."""
    # tables of authors and documents are written, as each level reads them again
    pairs = written(author_documents(rows), "authordocuments")
    claimed = written(claims(pairs, author_ranks(pairs, seed)), "claims")
    sizes = rows.groupBy("doc").agg(F.count("*").alias("cnt"))
    per = claimed.join(sizes, "doc").groupBy("author_rank").agg(F.sum("cnt").alias("cnt"))
    cum = running(per, "author_rank", "author_rank", F.col("cnt"), "cum", part=F.floor(F.col("author_rank") / 100_000))
    cum = written(cum, "authors")
    base, ends = 0, []
    for level in spec:
        target = sum(n for inner in level for _, n in inner) + overbuffer
        found = cum.where(F.col("cum") - base >= target).agg(F.min(F.struct("author_rank", "cum")).alias("x")).first().x
        if found is None:
            raise QuotaError(f"authors run out at level {len(ends)}")
        ends.append((len(ends), found.author_rank))
        base = found.cum
    limits = rows.sparkSession.createDataFrame([(k, ends[k - 1][1] if k else 0, end) for k, end in ends], "author_level int, after long, upto long")
    return claimed.join(F.broadcast(limits), (F.col("author_rank") > F.col("after")) & (F.col("author_rank") <= F.col("upto"))).select("doc", "author_level"), ends


def split_authors(rows: DataFrame, spec: list, seed: int, overbuffer: int = 0, leeway: int = 0, jurisdiction: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Nested split: author levels by first claim, each split further by documents; and of each author level its number and `n_authors_used`, the authors it and those before it used up.

    spec: author levels of document levels of (name, size). Only (key, doc, author_level) pass through the levels; the rows,
    which are read four times, are written once and meet what was assigned in one join. A key stands in one row, as dedup leaves it.
    """
    levels_of([sum(([*inner] for inner in level), []) for level in spec])  # names and sizes are sound
    known = rows.withColumn("doc", core_title(F.col("title"))).where(F.col("doc").isNotNull() & (F.size("authors") > 0))
    known = written(known, "authorrows")
    levels, ends = author_levels(known.select("key", "doc", "authors"), spec, seed, overbuffer)
    pools, out = written(known.select("key", "doc").join(levels, "doc"), "authorpools"), None
    for k, level in enumerate(spec):
        one = split_documents(pools.where(F.col("author_level") == k), "key", "doc", level, seed + k, leeway, jurisdiction)
        out = one if out is None else out.unionByName(one)
    assigned = out.select("key", "doc", "author_level", "level", "split")
    return known.join(assigned, ["key", "doc"]), [{"author_level": k, "n_authors_used": end} for k, end in ends]


def split_author_documents(rows: DataFrame, spec: list, seed: int, overbuffer: int = 0, leeway: int = 0, jurisdiction: str | None = None) -> DataFrame:
    """The rows of split_authors."""
    return split_authors(rows, spec, seed, overbuffer, leeway, jurisdiction)[0]


def author_document_sets(rows: DataFrame, od_author: int, od_doc: int, train: int, id_test: int, valid: int, seed: int, finetune: int = 0, overbuffer: int = 200, leeway: int = 0, jurisdiction: str | None = None) -> tuple[DataFrame, list[dict]]:
    """The usual shape: authors held out first; then held-out documents with the fine-tuning set; then train, id_test and valid. With the authors used, as split_authors."""
    spec = [[[("author_od_test", od_author)]], [[("doc_od_test", od_doc), ("ft", finetune)], [("train", train), ("id_test", id_test), ("valid", valid)]]]
    return split_authors(rows, spec, seed, overbuffer, leeway, jurisdiction)


# --- by class ---------------------------------------------------------------------------------------------------


def term_warnings(rows: DataFrame, terms: list[list[str]]) -> DataFrame:
    """Distinct (name_rxn_def, name_rxn, term_group) where all terms of a group are in the definition: classes that may belong to the excluded ones."""
    out = None
    for group in terms:
        one = rows.where(matches_all(F.col("name_rxn_def"), group)).select("name_rxn_def", "name_rxn", F.lit("+".join(group)).alias("term_group")).distinct()
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.select("name_rxn_def", "name_rxn", F.lit("").alias("term_group")).limit(0)


def classed(rows: DataFrame) -> DataFrame:
    """Rows whose class is known and recognised, with their doc."""
    return rows.where(F.col("name_rxn").isNotNull() & (F.col("name_rxn") != "0.0")).withColumn("doc", core_title(F.col("title")))


def class_pools(rows: DataFrame, codes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(out-of-distribution rows, other rows) among those whose class is known and recognised."""
    known, inside = classed(rows), in_class_set(F.col("name_rxn"), codes)
    return known.where(inside), known.where(~inside)


def without_documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of other documents; a row of unknown title counts as one of the same document."""
    return rows.where("doc is not null").join(docs.select("doc").where("doc is not null").distinct(), "doc", "left_anti").select(*rows.columns)


def split_classes(rows: DataFrame, codes: list[str], valid: int, id_test: int, train_limit: int, od_test: int, finetune: int, seed: int, exclude_all_docs: bool = True, leeway: int = 200, jurisdiction: str | None = None) -> DataFrame:
    """Sets ft and od_test from the classes, valid, id_test and train from all others, no document in both.

    Rows are read once to count every document's rows in the classes and outside, then once a side to assign them. No
    row meets an anti-join: which documents are free follows from the counts, and a side's rows meet its documents only.
    """
    od, rest = class_pools(rows, codes)
    inside = in_class_set(F.col("name_rxn"), codes)
    docs = written(classed(rows).groupBy("doc").agg(F.count_if(inside).alias("n_od"), F.count_if(~inside).alias("n_rest")), "classdocuments")
    every, titled = docs.agg(F.coalesce(F.sum("n_od"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("doc").isNotNull(), F.col("n_od"))), F.lit(0))).first()
    docs, chosen = docs.where("doc is not null"), None
    if every:
        if titled < finetune:
            raise QuotaError(f"{titled} rows can't fill {finetune} of fine-tuning")
        spec = [[("ft", finetune)], [("od_test", min(od_test, titled - finetune))]]
        chosen = split_documents(od, "key", "doc", spec, seed, leeway, jurisdiction, docs.where("n_od > 0").select("doc", F.col("n_od").alias("cnt")))
    free = docs.where("n_rest > 0").select("doc", "n_od", F.col("n_rest").alias("cnt"))
    if exclude_all_docs or chosen is None:
        free = free.where("n_od = 0")
    else:
        free = written(free.join(chosen.select("doc").distinct(), "doc", "left_anti"), "freedocuments")
    left = (free.agg(F.sum("cnt")).first()[0] or 0) - valid - id_test
    if left < 0:
        raise QuotaError(f"valid and id_test want {-left} rows more than there are")
    spec = [[("valid", valid)], [("id_test", id_test)], [("train", min(train_limit, left))]]
    other = split_documents(rest, "key", "doc", spec, seed + 1, leeway, jurisdiction, free)
    return other if chosen is None else chosen.unionByName(other)


# --- by year ----------------------------------------------------------------------------------------------------


def year_sizes(rows: DataFrame, test_amount: int, valid_proportion: float) -> DataFrame:
    """(year, n, test, train, valid): a test set only where a year has more than twice its size; years before 1900 or unknown are left out."""
    counts = rows.where("year is not null and year >= 1900").groupBy("year").agg(F.count("*").alias("n"))
    sized = counts.withColumn("test", F.when(F.col("n") > 2 * test_amount, F.lit(test_amount)).otherwise(F.lit(0)).cast("long"))
    sized = sized.withColumn("train", ((F.col("n") - F.col("test")) * F.lit(1 - valid_proportion)).cast("long"))
    return sized.withColumn("valid", F.col("n") - F.col("test") - F.col("train"))


#: Rows by which a year's level may fall short of its target.
YEAR_LEEWAY = 750


def _year_levels(rows: DataFrame, test_amount: int, valid_proportion: float, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows of known year and title, documents in order, limits, sets) of a split by year and document."""
    sizes = year_sizes(rows, test_amount, valid_proportion)
    titled = rows.where("year is not null and year >= 1900").withColumn("doc", core_title(F.col("title"))).where("doc is not null")
    # levels in the order test (where there is one), valid, train
    order = F.array(F.struct(F.lit("test").alias("split"), F.col("test").alias("size")), F.struct(F.lit("valid").alias("split"), F.col("valid").alias("size")), F.struct(F.lit("train").alias("split"), F.col("train").alias("size")))
    kept = F.filter(order, lambda x: (x["split"] != "test") | (x["size"] > 0))
    sets = sizes.select("year", F.posexplode(kept).alias("level", "s")).select("year", "level", "s.split", F.lit(0).cast("long").alias("start"), "s.size")
    docs = document_order(titled, "doc", seed, ("year",))
    return titled, docs, fill(docs, sets.select("year", "level", F.col("size").alias("target")), ("year",)), sets


def year_shortfalls(rows: DataFrame, test_amount: int, valid_proportion: float, seed: int) -> DataFrame:
    """(year, split, target, n_rows, short): what each year's sets are to hold, hold, and lack. A year without known titles has nothing to take."""
    _, docs, limits, sets = _year_levels(rows, test_amount, valid_proportion, seed)
    taken = sets.join(limits.select("year", "level", F.least("target", F.col("end") - F.col("base")).alias("n_rows")), ["year", "level"], "left")
    out = taken.select("year", "split", F.col("size").alias("target"), F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"))
    return out.withColumn("short", F.col("target") - F.col("n_rows"))


def split_years(rows: DataFrame, test_amount: int, valid_proportion: float, seed: int, by_document: bool = True, leeway: int | None = YEAR_LEEWAY) -> DataFrame:
    """rows with split test, valid or train, every year split by itself in one pass.

    By document, a document that overflows a set is cut and its rest belongs to none, so a later set can fall short.
    Raises QuotaError, before any row is assigned, if one does by more than the leeway (None: never).
    """
    if not 0 <= valid_proportion <= 1:
        raise ValueError("valid_proportion must be from 0 to 1")
    sizes = year_sizes(rows, test_amount, valid_proportion)
    usable = rows.where("year is not null and year >= 1900").withColumn("doc", core_title(F.col("title")))
    if not by_document:
        ordered = ranked(usable.withColumn("_h", order_key(F.col("key"), seed)), "_h", "key", "_rn", ("year",)).join(F.broadcast(sizes), "year")
        split = F.when(F.col("_rn") <= F.col("train"), "train").when(F.col("_rn") <= F.col("train") + F.col("valid"), "valid").otherwise("test")
        return ordered.withColumn("split", split).select(*usable.columns, "split")
    titled, docs, limits, sets = _year_levels(rows, test_amount, valid_proportion, seed)
    if leeway is not None:
        lack = F.col("target") - F.least("target", F.col("end") - F.col("base"))
        worst = limits.select("year", "level", lack.alias("lack")).orderBy(F.desc("lack"), "year").first()
        if worst and worst.lack > leeway:
            raise QuotaError(f"a set of year {worst.year} falls short by {worst.lack} rows, the leeway is {leeway}")
    return assign(titled, "doc", "key", docs, limits, sets, seed, ("year",)).drop("level")


def set_sizes(split: DataFrame) -> DataFrame:
    """(year, train, valid, test) with 0 where a year has no such set."""
    pivoted = split.groupBy("year").pivot("split", ["train", "valid", "test"]).count()
    return pivoted.select("year", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("train", "valid", "test")])


def controlled_size(split: DataFrame, cutoffs: list[int], most: int, control: bool) -> int:
    """Training rows of every cutoff: all that the earliest cutoff has if sizes are controlled, but `most` at most."""
    if not control:
        return most
    return min(most, split.where((F.col("split") == "train") & (F.col("year") <= min(cutoffs))).count())


def cutoff_sets(split: DataFrame, cutoffs: list[int], most_train: int, most_valid: int, seed: int) -> DataFrame:
    """(cutoff, split, ...rows): training and validation rows of all years up to each cutoff, mixed, the first of a seeded order."""
    marks = split.sparkSession.createDataFrame([(int(c), s, m) for c in cutoffs for s, m in (("train", most_train), ("valid", most_valid))], "cutoff int, _split string, _most long")
    # rows of each year and set, one row each: what a cutoff has to choose from
    sizes = split.groupBy("year", "split").agg(F.count("*").alias("_c")).join(F.broadcast(marks), (F.col("year") <= F.col("cutoff")) & (F.col("split") == F.col("_split")))
    sizes = sizes.groupBy("cutoff", "_split", "_most").agg(F.sum("_c").alias("_n")).collect()
    # the order is an even hash, so the first `most` of n lie below a share of its range that holds a little more than that;
    # what lies above needs no rank. Six deviations more are wanted; a share that still holds too few is counted and undone
    share = {(r.cutoff, r["_split"]): min(1.0, (r["_most"] + 6 * (r["_most"] + 9) ** 0.5) / r["_n"]) for r in sizes}
    order = F.md5(F.concat("key", F.lit(f":{seed}:"), F.col("cutoff").cast("string")).cast("binary"))

    def near(share: dict) -> DataFrame:
        limits = split.sparkSession.createDataFrame([(int(c), s, int(m), "g" if share.get((c, s), 1.0) >= 1 else format(int(share[c, s] * 16**12), "012x")) for c in cutoffs for s, m in (("train", most_train), ("valid", most_valid))], "cutoff int, _split string, _most long, _below string")
        wide = split.join(F.broadcast(limits), (F.col("year") <= F.col("cutoff")) & (F.col("split") == F.col("_split")))
        return wide.withColumn("_h", order).where(F.substring("_h", 1, 12) < F.col("_below"))

    held = {(r.cutoff, r.split): r["count"] for r in near(share).groupBy("cutoff", "split").count().collect()} if any(x < 1 for x in share.values()) else {}
    share = {k: 1.0 if x < 1 and held.get(k, 0) < next(r["_most"] for r in sizes if (r.cutoff, r["_split"]) == k) else x for k, x in share.items()}
    return ranked(near(share), "_h", "key", "_rn", ("cutoff", "split")).where("_rn <= _most").select("cutoff", *split.columns)


def cutoff_amounts(split: DataFrame, cutoffs: list[int], most_train: int, most_valid: int) -> DataFrame:
    """(cutoff, split, possible, selected, excluded): training and validation rows of all years up to each cutoff, and how many of them its sets leave out."""
    marks = split.sparkSession.createDataFrame([(int(c), s, int(m)) for c in cutoffs for s, m in (("train", most_train), ("valid", most_valid))], "cutoff int, split string, most long")
    counts = split.groupBy("year", "split").agg(F.count("*").alias("n"))  # one row a year and set
    met = marks.alias("m").join(counts.alias("c"), (F.col("m.split") == F.col("c.split")) & (F.col("c.year") <= F.col("m.cutoff")), "left")
    summed = met.groupBy("cutoff", "m.split", "most").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("possible"))
    return summed.select("cutoff", "split", "possible", F.least("possible", "most").alias("selected"), F.greatest(F.col("possible") - F.col("most"), F.lit(0)).cast("long").alias("excluded"))


# --- bespoke ----------------------------------------------------------------------------------------------------


def bespoke(rows: DataFrame, codes: list[str], excluded: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all rows of the classes, those whose key is in none of the excluded training sets)."""
    collected = rows.where(in_class_set(F.col("name_rxn"), codes))
    gone = None
    for x in excluded:
        gone = x.select("key") if gone is None else gone.union(x.select("key"))
    return collected, collected if gone is None else collected.join(gone.distinct(), "key", "left_anti").select(*collected.columns)


def missing_keys(excluded: DataFrame, clean: DataFrame) -> DataFrame:
    """Keys of excluded sets that the clean table lacks; must be empty."""
    return excluded.select("key").distinct().join(clean.select("key"), "key", "left_anti")


def overlap_report(collected: DataFrame, excluded: dict[str, DataFrame]) -> DataFrame:
    """(dataset, n_overlap) for each excluded set."""
    out = None
    for name, x in excluded.items():
        one = collected.join(x.select("key"), "key", "left_semi").agg(F.lit(name).alias("dataset"), F.count("*").alias("n_overlap"))
        out = one if out is None else out.unionByName(one)
    return out
