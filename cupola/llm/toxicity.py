"""Toxicity by nearest labelled examples: exact TF-IDF cosine through block-max inverted indexes.

Terms are words in small letters and stems, the first STEMS letters of longer words. Those whose presence tells the label
among the learning rows (log-likelihood ratio of EVIDENT or more, and a share of toxic rows TELLING times that of all rows or more,
or as much less; at most TERMS) span the space; a text is a vector of
(1 + ln tf) * idf, brought to length 1, with document frequencies over all documents. Words that say nothing about the
label are left out of the space, as the cosine of whole texts measures their subject and length.

Examples are learning rows with a vector. They lie in blocks of BLOCK alike ones; an inverted list holds, by term and
block, the entries and the largest weight. A query's bound for a block is the sum of its weights times those; blocks are
read by descending bound until no bound reaches the k-th similarity, so the NEAR nearest are exact. They vote by the
square of the similarity; ties go by the texts' hashes. The share of votes is calibrated by isotonic regression on the
learning rows themselves, each judged without itself; texts without a term of the space have a value of their own
there. The nearest examples (doc_id:label:similarity) are the evidence.

Learned from is a bounded sample: of the labelled rows, chosen by hash, about LEARN at most; of texts alike (the same, or
with the same smallest hash of their five-word shingles) one. All documents are counted and scored, from whole texts.

Several labels of one document: any that says toxic counts. A null or empty text is a text without terms. Rows that
share an id are each judged by their own text; rows without an id aren't held out, nor learned from. Without labels all
scores are 0; with one class, all scores are that class. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cupola.llm.common import stored, table

#: Learning rows, about, and terms of the space, at most.
LEARN, TERMS = 12_000, 4096
#: Least log-likelihood ratio of a term (chi-square with one degree of freedom: one of 130,000 terms by chance).
EVIDENT = 20.0
#: Factor between the share of toxic rows among a term's rows and that among all: frequent words can be evident and yet tell next to nothing.
TELLING = 2.0
STEMS = (4, 5, 6)
BLOCK, NEAR, SHOWN = 64, 15, 3
#: Score from which a document counts as toxic.
TOXIC = 0.3
BINS = 50
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms(text: str | None) -> Counter:
    """Words and stems with their counts; a stem ends in `~`."""
    found = Counter(_WORD.findall(text.lower())) if text else Counter()
    for word, n in list(found.items()):
        for k in STEMS:
            if len(word) > k:
                found[word[:k] + "~"] += n
    return found


def _alike(text: str) -> int:
    """The smallest hash of a text's five-word shingles: near copies mostly share it, other texts don't."""
    words = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) >> 1


def examples(docs: DataFrame, labels: DataFrame, learn: int = LEARN) -> DataFrame:
    """(doc_id, toxic, mark, terms, tfs) of the learning rows, texts alike once; mark is a hash of the text."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    share = lambda n, *of: F.pmod(F.xxhash64(*of, F.lit(13)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, learn / max(1, n)))
    chosen = marked.where(share(marked.count(), "doc_id"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    n = rows.select("doc_id").count()
    if n > 2 * learn:  # many rows share an id
        rows = rows.where(share(n, "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                ids, toxic, text = (c.to_pylist() for c in batch.slice(i, 512).columns)
                found = [terms(t) for t in text]
                cols = [pa.array([str(x) for x in ids]), pa.array(toxic, pa.int32()), pa.array([xxhash.xxh64_intdigest(t) >> 1 for t in text], pa.int64()), pa.array([_alike(t) for t in text], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))], names=_EXAMPLE)

    made = stored(rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id string, toxic int, mark long, alike long, terms array<string>, tfs array<int>"), "examples")
    # the choice is made on narrow rows; of one text labelled both ways the row labelled toxic counts
    first = made.groupBy("alike").agg(F.min(F.struct("mark", (-F.col("toxic")).alias("other"), "doc_id")).alias("x")).select("alike", "x.mark", (-F.col("x.other")).alias("toxic"), "x.doc_id")
    return made.join(F.broadcast(first), ["alike", "mark", "toxic", "doc_id"]).dropDuplicates(["alike"])


_EXAMPLE = ["doc_id", "toxic", "mark", "alike", "terms", "tfs"]


def space(learning: DataFrame, most: int = TERMS, evident: float = EVIDENT, telling: float = TELLING) -> list[str]:
    """The terms that tell the label, by the log-likelihood ratio of presence and label."""
    total = learning.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, pos = total.n, total.pos
    if not 0 < pos < n:
        return []
    counts = learning.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("hit"))
    cell = lambda x, expected: F.when(x > 0, 2 * x * F.log(x / expected)).otherwise(0.0)
    df, hit = F.col("df").cast("double"), F.col("hit").cast("double")
    p = pos / n
    ratio = cell(hit, df * p) + cell(df - hit, df * (1 - p)) + cell(pos - hit, (n - df) * p) + cell(n - pos - df + hit, (n - df) * (1 - p))
    tells = (hit >= telling * p * df) | (hit <= p * df / telling)
    return sorted(r.term for r in counts.withColumn("g", ratio).where((F.col("g") >= evident) & tells).orderBy(F.desc("g"), "term").limit(most).collect())


def vectors(docs: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """(doc_id, ids, tfs) of every row: the terms of the space that its text holds."""
    stems = [{w[:-1]: i for w, i in numbers.items() if w[-1] == "~" and len(w) == k + 1} for k in STEMS]
    shared = docs.sparkSession.sparkContext.broadcast(({w: i for w, i in numbers.items() if w[-1] != "~"}, list(zip(STEMS, stems, strict=True))))

    def vector(text: str | None) -> list[tuple[int, int]]:
        """As terms(), but only stems of the space are made."""
        whole, stems = shared.value
        own: Counter = Counter()
        for word, n in Counter(_WORD.findall(text.lower())).items() if text else ():
            if word in whole:
                own[whole[word]] += n
            for k, known in stems:
                if len(word) > k and (i := known.get(word[:k])) is not None:
                    own[i] += n
        return sorted(own.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                own = [vector(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([[x[k] for x in row] for row in own], pa.list_(pa.int32())) for k in (0, 1)]], names=["doc_id", "ids", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>, tfs array<int>")


class Index:
    """Labelled vectors in blocks, with inverted lists by (block, term) and each list's largest weight."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[str, int, int, list[int], list[int]]]):
        """rows: (doc_id, toxic, mark, ids, tfs), ids not empty."""
        self.idf = idf
        weighed = [(*r, self.weigh(r[3], r[4])) for r in rows]
        # alike ones side by side: by heaviest term, then label
        weighed.sort(key=lambda r: (r[3][int(np.argmax(r[5]))], r[1], r[2]))
        self.ids, self.toxic, self.marks = [r[0] for r in weighed], np.array([r[1] for r in weighed], np.float64), np.array([r[2] for r in weighed], np.int64)
        self.rows = [(r[3], r[4]) for r in weighed]
        self.blocks = -(-len(weighed) // BLOCK)
        sizes = [len(r[3]) for r in weighed]
        row = np.repeat(np.arange(len(weighed)), sizes)
        term = np.array([t for r in weighed for t in r[3]], np.int64)
        weight = np.concatenate([r[5] for r in weighed]) if weighed else np.zeros(0)
        order = np.lexsort((row, term, row // BLOCK))
        self.row, self.weight = row[order], weight[order]
        cell = (row // BLOCK * len(idf) + term)[order]
        self.starts = np.searchsorted(cell, np.arange(self.blocks * len(idf) + 1)).astype(np.int64)
        self.most = np.zeros((len(idf), self.blocks))
        np.maximum.at(self.most, (term, row // BLOCK), weight)

    def weigh(self, ids: list[int], tfs: list[int]) -> np.ndarray:
        w = (1 + np.log(np.asarray(tfs, np.float64))) * self.idf[ids]
        return w / math.sqrt(float(w @ w))

    def nearest(self, ids: list[int], tfs: list[int], k: int = NEAR, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the k most similar examples of similarity above 0, row `without` left out."""
        w = self.weigh(ids, tfs)
        bounds = w @ self.most[ids]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        rows, near, limit, step, i = np.zeros(0, np.int64), np.zeros(0), 0.0, 4, 0
        width = len(self.idf)
        while i < len(order) and bounds[order[i]] >= limit - 1e-9:
            held = np.sort(order[i : i + step])
            i, step = i + step, step * 2
            cells = held[:, None] * width + np.asarray(ids)
            a, n = self.starts[cells].ravel(), (self.starts[cells + 1] - self.starts[cells]).ravel()
            at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            found, place = np.unique(self.row[at], return_inverse=True)
            score = np.bincount(place, self.weight[at] * np.repeat(np.tile(w, len(held)), n), len(found))
            found, score = found[found != without], score[found != without]
            rows, near = np.concatenate((rows, found)), np.concatenate((near, np.round(score, 9)))
            best = np.lexsort((self.marks[rows], -near))[:k]
            rows, near = rows[best], near[best]
            limit = near[-1] if len(near) == k else 0.0
        return rows, near

    def vote(self, ids: list[int], tfs: list[int], without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """(share of the votes for toxic, rows, similarities); -1 without a neighbour."""
        if not len(ids) or not self.blocks:
            return -1.0, np.zeros(0, np.int64), np.zeros(0)
        rows, near = self.nearest(ids, tfs, NEAR, without)
        return (float((near**2) @ self.toxic[rows] / (near**2).sum()) if len(rows) else -1.0), rows, near


def isotonic(counts: list[tuple[int, int, int]], prior: float) -> dict[int, float]:
    """bin -> probability from (bin, rows, toxic rows): ascending, neighbours that would fall are pooled, each pool smoothed by one row of the prior."""
    pools: list[list] = []
    for b, n, pos in sorted(counts):
        pools.append([[b], n, pos])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return {b: (pos + prior) / (n + 1) for bins, n, pos in pools for b in bins}


class Calibration:
    def __init__(self, counts: list[tuple[int, int, int]]):
        """counts: (bin, rows, toxic rows), bin -1 for texts without neighbours."""
        n, pos = sum(c[1] for c in counts), sum(c[2] for c in counts)
        self.prior = pos / n if n else 0.0
        self.alone = next(((p + self.prior) / (k + 1) for b, k, p in counts if b < 0), self.prior)
        known = isotonic([c for c in counts if c[0] >= 0], self.prior)
        self.table = np.interp(np.arange(BINS + 1), list(known), list(known.values())) if known else np.full(BINS + 1, self.prior)

    def score(self, share: float) -> float:
        return self.alone if share < 0 else float(np.interp(share * BINS, np.arange(BINS + 1), self.table))


def model(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Index, Calibration]:
    """(vectors of all rows, index, calibration)."""
    spark = docs.sparkSession
    learning = stored(examples(docs, labels), "learning")
    chosen = space(learning)
    numbers = {t: i for i, t in enumerate(chosen)}
    found = stored(vectors(docs, numbers), "vectors")
    n = found.count()
    df = np.zeros(len(chosen))
    for r in found.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # a row a term of the space
        df[r.t] = r["count"]
    idf = np.log((n + 1) / (df + 1)) + 1
    held = F.filter(F.arrays_zip("terms", "tfs"), lambda x: F.array_contains(F.lit(chosen) if chosen else F.array(F.lit("")), x["terms"]))
    rows = learning.select("doc_id", "toxic", "mark", held.alias("x")).select("doc_id", "toxic", "mark", F.col("x.terms").alias("terms"), F.col("x.tfs").alias("tfs")).collect()
    vector = lambda r: zip(*sorted((numbers[t], k) for t, k in zip(r.terms, r.tfs, strict=True)), strict=True)
    index = Index(idf, [(r.doc_id, r.toxic, r.mark, *map(list, vector(r))) for r in rows if chosen and r.terms])
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            places = batch.column(0).to_pylist()
            shares = [own.vote(*own.rows[i], without=i)[0] for i in places]
            yield pa.RecordBatch.from_arrays([pa.array([-1 if s < 0 else round(s * BINS) for s in shares], pa.int32()), pa.array([int(own.toxic[i]) for i in places], pa.int32())], names=["bin", "toxic"])

    judged = spark.range(len(index.ids)).repartition(max(1, len(index.ids) // 500)).mapInArrow(run, "bin int, toxic int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).collect()
    counts = Counter()
    for b, k, p in [(r.bin, r.n, r.pos) for r in judged] + [(-1, 1, r.toxic) for r in rows if not (chosen and r.terms)]:
        counts[b, 0] += k
        counts[b, 1] += p
    return found, index, Calibration([(b, counts[b, 0], counts[b, 1]) for b in sorted({b for b, _ in counts})])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every document row."""
    found, index, calibration = model(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((index, calibration))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = shared.value
        for batch in batches:
            cache: dict[bytes, tuple[float, str]] = {}
            out = []
            for ids, tfs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key = struct.pack(f"{2 * len(ids)}i", *ids, *tfs)
                if key not in cache:
                    share, rows, near = own.vote(ids, tfs)
                    cache[key] = known.score(share), " ".join(f"{own.ids[i]}:{int(own.toxic[i])}:{s:.4f}" for i, s in zip(rows[:SHOWN].tolist(), near[:SHOWN].tolist(), strict=True))
                out.append(cache[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.string())], names=["doc_id", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = found.mapInArrow(run, f"doc_id {kind}, score double, evidence string")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "evidence")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
