"""Document-dense splitting: levels filled with whole documents in a seeded order, then cut into named sets.

Levels share no document; the sets of one level may. A level takes documents in order until its target is met; the
document that overflows is cut and its rest belongs to no set; the next level begins with the next document. A
level with target 0 uses up one document. With `by`, every group (such as a year) is split by itself, with its own
targets, in the same pass.

Only the table of documents is ordered (see ordering: no window takes it whole). Each level is one aggregate over
it, one row a group. Rows are touched once, by a join with the level limits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cupola.functions.columns import author_name, order_key
from cupola.operators.ordering import ranked, running
from cupola.sources.tables import written


class QuotaError(RuntimeError):
    """Levels can't be filled within the leeway, or the documents are not of the expected jurisdiction."""


@dataclass(frozen=True)
class Level:
    """The named sets of a level and their sizes, in order."""

    sets: tuple[tuple[str, int], ...]

    @property
    def target(self) -> int:
        return sum(n for _, n in self.sets)


def levels_of(spec: list[list[tuple[str, int]]]) -> list[Level]:
    levels = [Level(tuple((str(n), int(k)) for n, k in level)) for level in spec]
    names = [n for level in levels for n, _ in level.sets]
    if len(set(names)) != len(names):
        raise ValueError("a set is named twice")
    if any(k < 0 for level in levels for _, k in level.sets):
        raise ValueError("a size is negative")
    return levels


def document_order(rows: DataFrame, doc: str, seed: int, by: tuple[str, ...] = (), counts: DataFrame | None = None) -> DataFrame:
    """(by, doc, cnt, cum): documents with their row counts and the running count in seeded order. Where the counts (by, doc, cnt) are known already, rows aren't read."""
    docs = rows.groupBy(*by, doc).agg(F.count("*").alias("cnt")) if counts is None else counts.select(*by, doc, "cnt")
    # every level reads this table again: it is written, so nothing stays in the executors and a lost one loses nothing
    return written(running(docs.withColumn("_h", order_key(F.col(doc), seed, "doc")), "_h", doc, F.col("cnt"), "cum", by).drop("_h"), "documents")


def fill(docs: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, level, base, end, target): which running counts a level's documents have (base < cum <= end).

    targets has (by, level, target); a level begins where the one before it ends. Groups and levels are few (years,
    sets): their limits, one row each, pass through the driver; documents don't.
    """
    by = list(by)
    wanted: dict[int, dict] = {}
    for r in targets.select(*by, "level", "target").collect():
        wanted.setdefault(r["level"], {})[tuple(r[c] for c in by)] = int(r["target"])
    groups = {tuple(r[c] for c in by): 0 for r in docs.select(*by).distinct().collect()} if by else {(): 0} if docs.limit(1).count() else {}
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in by]
    made = []
    for level in sorted(wanted):
        own = {g: t for g, t in wanted[level].items() if g in groups}
        rows = docs.sparkSession.createDataFrame([(*g, groups[g], t) for g, t in own.items()], ", ".join([*kinds, "base long", "target long"]))
        joined = docs.select(*by, "cum").join(F.broadcast(rows), by) if by else docs.select("cum").withColumns({"base": F.lit(groups.get((), 0)).cast("long"), "target": F.lit(own.get((), 0)).cast("long")})
        met = F.min(F.when(F.col("cum") - F.col("base") >= F.col("target"), F.col("cum")))
        for r in joined.where("cum > base").groupBy(*by).agg(F.coalesce(met, F.max("cum")).alias("end")).collect() if own else []:
            g = tuple(r[c] for c in by)
            if r["end"] is not None:
                made.append((*g, level, groups[g], r["end"], own[g]))
                groups[g] = r["end"]
                del own[g]
        made += [(*g, level, groups[g], groups[g], t) for g, t in own.items()]  # no document is left
    return docs.sparkSession.createDataFrame(made, ", ".join([*kinds, "level int, base long, end long, target long"]))


def assign(rows: DataFrame, doc: str, key: str, docs: DataFrame, limits: DataFrame, sets: DataFrame, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with level and split, those of no set left out. sets has (by, level, split, start, size)."""
    held = docs.alias("d").join(F.broadcast(limits).alias("l"), [*[F.col(f"d.{c}") == F.col(f"l.{c}") for c in by], F.col("d.cum") > F.col("l.base"), F.col("d.cum") <= F.col("l.end")])
    held = held.select(*[F.col(f"d.{c}").alias(c) for c in by], F.col(f"d.{doc}").alias(doc), "level", (F.col("d.cum") - F.col("d.cnt") - F.col("l.base")).alias("_at"), "target")
    inside = Window.partitionBy(*by, doc).orderBy(order_key(F.col(key), seed), key)
    placed = rows.join(held, [*by, doc]).withColumn("_i", F.row_number().over(inside) - 1).where(F.col("_at") + F.col("_i") < F.col("target"))
    shuffled = ranked(placed.withColumn("_h", order_key(F.col(key), seed, "level")), "_h", key, "_rn", (*by, "level"))
    cut = [shuffled[c] == sets[c] for c in (*by, "level")] + [shuffled["_rn"] > sets["start"], shuffled["_rn"] <= sets["start"] + sets["size"]]
    return shuffled.join(F.broadcast(sets), cut).select(*[shuffled[c] for c in rows.columns], shuffled["level"], "split")


def split_documents(rows: DataFrame, key: str, doc: str, spec: list[list[tuple[str, int]]], seed: int, leeway: int = 0, jurisdiction: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """rows that belong to a set, with level and split. With counts (doc, cnt) only these documents are split, and rows of others belong to no set. Raises QuotaError before any row is assigned if a level falls short by more than the leeway, if there is no document, or if documents are not all of the jurisdiction (their first two characters)."""
    spark, levels = rows.sparkSession, levels_of(spec)
    titled = rows.where(F.col(doc).isNotNull())
    docs = document_order(titled, doc, seed, counts=counts)
    if jurisdiction:
        found = [r[0] for r in docs.select(F.substring(doc, 1, 2)).distinct().limit(2).collect()]
        if found != [jurisdiction]:
            raise QuotaError(f"expected documents of {jurisdiction} only, found {found}")
    targets = spark.createDataFrame([(i, x.target) for i, x in enumerate(levels)], "level int, target long")
    limits = fill(docs, targets).collect()
    if not limits:
        raise QuotaError("there are no documents")
    short = max(r.target - min(r.target, r.end - r.base) for r in limits)
    if short > leeway:
        raise QuotaError(f"a level falls short by {short} rows, the leeway is {leeway}")
    limits = spark.createDataFrame(limits, "level int, base long, end long, target long")
    starts = [(i, n, sum(k for _, k in x.sets[:j]), k) for i, x in enumerate(levels) for j, (n, k) in enumerate(x.sets)]
    sets = spark.createDataFrame(starts, "level int, split string, start long, size long")
    return assign(titled, doc, key, docs, limits, sets, seed)


def unknown_counts(rows: DataFrame, title: str = "title", doc: str = "doc", authors: str = "authors") -> DataFrame:
    """One row: rows, those of unknown title, those without authors, distinct documents, distinct authors (in small letters, trimmed)."""
    one = rows.agg(F.count("*").alias("n_rows"), F.sum(F.col(title).isNull().cast("long")).alias("unknown_titles"), F.sum((F.coalesce(F.size(authors), F.lit(0)) <= 0).cast("long")).alias("unknown_authors"))
    docs = rows.select(doc).where(F.col(doc).isNotNull()).distinct().agg(F.count("*").alias("n_docs"))
    names = rows.select(F.explode(F.transform(authors, author_name)).alias("author")).distinct().agg(F.count("author").alias("n_authors"))
    return one.crossJoin(docs).crossJoin(names)  # one row each


def split_meta(rows: DataFrame, doc: str, spec: list[list[tuple[str, int]]], seed: int) -> DataFrame:
    """One row a level: target, rows used, documents used so far, documents in all."""
    levels = levels_of(spec)
    docs = document_order(rows.where(F.col(doc).isNotNull()), doc, seed)
    targets = rows.sparkSession.createDataFrame([(i, x.target) for i, x in enumerate(levels)], "level int, target long")
    limits = fill(docs, targets)
    used = docs.join(F.broadcast(limits), docs["cum"] <= limits["end"]).groupBy("level").agg(F.count("*").alias("n_docs_used"))
    total = docs.count()
    return limits.join(used, "level", "left").select("level", "target", F.least("target", F.col("end") - F.col("base")).alias("n_rows"), F.coalesce("n_docs_used", F.lit(0).cast("long")).alias("n_docs_used"), F.lit(total).cast("long").alias("n_docs_total"))
