"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, intervals of scores, no random access.

A term's impact in a document is what it adds to the document's score, a whole number (`impacts`). Documents are dealt
to shards; a shard holds, for each term of the queries, its documents by descending impact. A query reads its terms'
lists from the top, some entries at a time. A document's lower bound is the sum of the impacts read of it, its upper bound
adds the next unread impact of every list that has not shown it; a document that no list has shown can reach the sum of
these. Reading ends when no unseen document can reach the k-th lower bound, and every document whose upper bound
reaches it has lower = upper: then membership, ties and scores are final. Lists that no open document waits for are not
read on. A shard's first k by (score, id) are exact, so the first k of all shards are found by one ranking of these.

Counts over all documents (how many have a term, how long they are) come from one pass that counts the queries' terms in
every whole text and writes them; shards are read from that table. Shards are bounded in documents and entries, a
task keeps one shard and k rows a query. Queries go in blocks of ITEMS, whose terms are broadcast.

An item is a distinct (item_id, text); null texts have no terms and find nothing. Null document texts have no terms. Repeated
document rows each count and rank as a document; ties go by ascending doc_id, a null id last. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cupola.llm.common import stored, table

#: Rows that a query finds.
MOST = 50
#: Queries of a block.
ITEMS = 2048
#: Documents and list entries of a shard.
SHARD, ENTRIES = 1 << 15, 1 << 22
#: Entries of a list that are read first; each further read takes twice as many.
FIRST = 128
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(raw: bytes | None) -> list[bytes]:
    """Runs of ASCII digits and letters and of all characters beyond ASCII, only A-Z lower-cased."""
    return _WORD.findall(raw.lower()) if raw else []


def counted(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row: its number of words, and the numbers and counts of the given terms in it."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                ids, tfs, ends, n = [], [], [0], []
                for raw in part.column(1).cast(pa.binary()).to_pylist():
                    found = words(raw)
                    own = [(known[w], c) for w, c in Counter(found).items() if w in known]
                    ids += [k for k, _ in own]
                    tfs += [c for _, c in own]
                    ends.append(len(ids))
                    n.append(len(found))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tfs)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


def weight(docs: int, holding: int) -> int:
    """What a term weighs that `holding` of `docs` documents hold."""
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What terms of weight w that stand tf times in documents of n words add to their scores; `length` words in `docs` documents."""
    m = 50 + 50 * n * docs // length
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


def first_k(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, entries read): by NRA, all places of a shard of `size` that can be among the first k whatever breaks ties, with exact scores. lists are (places, impacts), impacts above 0 and descending."""
    lower, seen = np.zeros(size, np.int64), np.zeros((len(lists), size), bool)
    depth = [0] * len(lists)
    heads = np.array([x[1][0] for x in lists], np.int64)
    wanted, step, alive = range(len(lists)), FIRST, None
    while True:
        for t in wanted:
            places, own = lists[t]
            a, b = depth[t], min(depth[t] + step, len(places))
            lower[places[a:b]] += own[a:b]
            seen[t, places[a:b]] = True
            depth[t], heads[t] = b, own[b] if b < len(places) else 0
        unread = np.flatnonzero(heads)
        reach = int(heads.sum())
        # documents that may still count: all that were shown, or those left over once no other can enter
        at = np.flatnonzero(lower) if alive is None else alive
        least = lower[at]
        limit = int(np.partition(least, len(at) - k)[len(at) - k]) if len(at) > k else 0
        gap = np.full(len(at), reach, np.int64)
        for t in unread:
            gap[seen[t, at]] -= heads[t]
        near = least + gap >= limit
        at, gap = at[near], gap[near]
        closed = reach < limit or reach == 0
        if closed:
            alive = at
            waiting = at[gap > 0]
            wanted = [t for t in unread if not seen[t, waiting].all()]
            if not wanted:
                return at, lower[at], sum(depth)
        else:
            wanted = unread
        step *= 2


def search(docs: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """(item_id, rank, doc_id, score): the `most` highest-scoring documents of every item, scores above 0."""
    items = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    blocks = max(1, -(-items.count() // ITEMS))
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        one = _search_block(docs, rows, most, items.schema["item_id"].dataType.simpleString())
        out = one if out is None else out.unionByName(one)
    return out


def _search_block(docs: DataFrame, items: list, most: int, item_kind: str) -> DataFrame:
    spark = docs.sparkSession
    asked = [sorted(set(words(r.text.encode() if r.text is not None else None))) for r in items]
    numbers = {w: i for i, w in enumerate(sorted({w for x in asked for w in x}))}
    found = stored(counted(docs, numbers), "counted")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("length"), F.count_if(F.col("n") > 0).alias("docs")).first()
    holding = np.zeros(len(numbers), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row a term of the block
        holding[r.t] = r["count"]
    weights = np.array([weight(total.docs, int(x)) for x in holding], np.int64)
    shared = spark.sparkContext.broadcast((weights, [[numbers[w] for w in x] for x in asked], total.docs, total.length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, asked, n_docs, length = shared.value
        best: dict[int, list[tuple]] = {}

        def shard(parts: list[pa.RecordBatch]) -> None:
            """Searches one shard, and keeps of every query the first of what was there and what it found."""
            ids = [x for p in parts for x in p.column(0).to_pylist()]
            n = np.concatenate([p.column(1).to_numpy() for p in parts])
            sizes = np.concatenate([np.diff(p.column(2).offsets.to_numpy()) for p in parts])
            term, tf = (np.concatenate([p.column(c).flatten().to_numpy() for p in parts]).astype(np.int64) for c in (2, 3))
            place = np.repeat(np.arange(len(ids)), sizes)
            own = impacts(weights[term], tf, n[place], n_docs, max(1, length))
            term, place, own = term[own > 0], place[own > 0], own[own > 0]
            order = np.lexsort((-own, term))
            term, place, own = term[order], place[order], own[order]
            starts = np.searchsorted(term, np.arange(len(weights) + 1))
            for q, terms in enumerate(asked):
                lists = [(place[starts[t] : starts[t + 1]], own[starts[t] : starts[t + 1]]) for t in terms if starts[t] < starts[t + 1]]
                if lists:
                    at, score, _ = first_k(lists, len(ids), most)
                    kept = best.get(q, []) + [(-s, ids[i] is None, ids[i]) for i, s in zip(at.tolist(), score.tolist(), strict=True)]
                    best[q] = sorted(kept, key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[:most]

        held, rows, entries = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, entries = rows + batch.num_rows, entries + len(batch.column(2).flatten())
            if rows >= SHARD or entries >= ENTRIES:
                shard(held)
                held, rows, entries = [], 0, 0
        if held:
            shard(held)
        for q, own in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(own), pa.int32()), pa.array([x[2] for x in own], doc_type), pa.array([-x[0] for x in own], pa.int64())], names=["q", "doc_id", "score"])

    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    doc_type = pa.string() if doc_kind == "string" else pa.int32() if doc_kind == "int" else pa.int64()
    hits = found.where(F.size("terms") > 0).mapInArrow(run, f"q int, doc_id {doc_kind}, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(items)], f"q int, item_id {item_kind}")
    return ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH b AS (SELECT *, row_number() OVER () AS q FROM (SELECT DISTINCT item_id, text FROM benchmark)),
bt AS (
  SELECT DISTINCT q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM b),
d AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS n_all, CAST(sum(len(ws)) AS BIGINT) AS l_all FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM bt) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY term, n_all),
m AS (SELECT r, doc_id, 50 + (50 * len(ws) * n_all) // l_all AS m FROM d, s WHERE len(ws) > 0),
sc AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM bt JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE score > 0) WHERE rank <= 50
"""
