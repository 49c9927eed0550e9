"""Benchmark decontamination with an FM-index per shard of documents.

A window is 13 consecutive words of a benchmark item (all its words if it has fewer). Each task turns a shard of
documents into one sequence of word numbers, indexes it, searches all windows backwards through the wavelet tree
at once, locates their occurrences by sampled suffix positions, and merges the hit words into spans.

The index holds the words of the benchmark only: any other word can be in no occurrence, so a run of benchmark
words between two others stands by itself, and a run shorter than the shortest window can't hold one. What is
left out is decided by that rule alone; every word of every text is looked at.

The windows go to every task, so their number is bounded: the benchmark is dealt into blocks of at most
`block_words` words (a longer item is a block by itself). With one block, documents are indexed and searched in one
pass and nothing is written. With more, the shards' indexes are written once, over the words of all blocks, and each
block searches them as they are; only its hits are kept, and merged by document row. The words of all blocks are sent to
the indexing tasks; if they are more than VOCABULARY different ones, the items are divided into groups with fewer, and
each group has its own indexes.

Null or empty texts have no words and no hits. An item without words has no window; items that share an id count
once; an item with a null id is named "null". Repeated document rows each keep their row. Null doc_ids are kept.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cupola.llm.common import give_back, stored, table
from cupola.llm.fmindex import FMIndex

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before letters are lowered.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SIZE = 13
#: Words of the benchmark that a task holds at once.
BLOCK_WORDS = 1_000_000
#: Different benchmark words that an indexing task holds at once.
VOCABULARY = 2_000_000
#: A shard's index is built when it has this many symbols or comes from this many words.
SHARD_SYMBOLS, SHARD_WORDS = 1_000_000, 2_000_000
#: A-Z lowered, other bytes outside words blank.
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def numbered(texts: Iterable[str | None]) -> dict[bytes, int]:
    """The different words of texts, numbered from 1."""
    number: dict[bytes, int] = {}
    for text in texts:
        for w in (text or "").encode().translate(LOWERED).split():
            number.setdefault(w, len(number) + 1)
    return number


class Windows:
    """The distinct windows of a block of items: their words as numbers, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], number: dict[bytes, int], size: int = SIZE):
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [number[w] for w in (text or "").encode().translate(LOWERED).split()]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                owners.setdefault(tuple(ids[i : i + size]), set()).add(item)
        keys = list(owners)
        self.items = [sorted(owners[k]) for k in keys]
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.words = np.zeros((len(keys), size), np.int64)
        for i, k in enumerate(keys):
            self.words[i, : len(k)] = k


class Shard:
    """Documents as one sequence of word numbers, in which 0 is in no window, and the index of its runs of other numbers.

    A run that is shorter than the shortest window is left out. One blank stands between documents: no occurrence
    crosses.
    """

    def __init__(self, ids: list[np.ndarray], shortest: int, words: int):
        self.counts = np.array([len(x) for x in ids], np.int64)
        self.first = np.cumsum(self.counts + 1) - (self.counts + 1)
        flat = np.zeros(int((self.counts + 1).sum()), np.int64)
        for at, x in zip(self.first.tolist(), ids, strict=True):
            flat[at : at + len(x)] = x
        inside = np.concatenate(([False], flat > 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[0::2], edges[1::2]
        long = end - start >= shortest
        self.start, end, self.index = start[long], end[long], None
        # the kept runs, one separator after each
        size = end - self.start + 1
        self.place = np.cumsum(size) - size
        if len(self.start):
            where = np.arange(size.sum()) - np.repeat(self.place - self.start, size)
            self.index = FMIndex(np.where(where < np.repeat(end, size), flat[np.minimum(where, len(flat) - 1)], 0), words + 1)

    def hits(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of all occurrences in the sequence."""
        if self.index is None or not len(windows.items):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, hi = self.index.search(windows.words, windows.lengths)
        n = hi - lo
        at = self.index.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n))
        run = np.searchsorted(self.place, at, side="right") - 1
        return at - self.place[run] + self.start[run], np.repeat(np.arange(len(n)), n)

    def found(self, windows: Windows) -> Iterator[tuple[int, np.ndarray, list[str]]]:
        """(document's place, which of its words are hit, items) of documents with an occurrence."""
        start, window = self.hits(windows)
        if not len(start):
            return
        total = int((self.counts + 1).sum())
        change = np.bincount(start, minlength=total + 1) - np.bincount(start + windows.lengths[window], minlength=total + 1)
        hit = np.cumsum(change)[:-1] > 0
        doc = np.searchsorted(self.first, start, side="right") - 1
        items: dict[int, set[str]] = {}
        for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
            items.setdefault(d, set()).update(windows.items[w])
        for d, own in items.items():
            yield d, hit[self.first[d] : self.first[d] + self.counts[d]], sorted(own)


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    flags = np.concatenate(([False], hit, [False]))
    edges = np.flatnonzero(flags[1:] != flags[:-1]).tolist()
    return list(zip(edges[0::2], edges[1::2], strict=True))


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """The hit words of a text as merged ranges of code points, end exclusive."""
    at = [m.span() for m in re.finditer(WORD, text.translate(_ASCII_LOWER))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in _runs(hit)]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _sharded(batches: Iterator[pa.RecordBatch], number: dict[bytes, int], shortest: int, spans: bool = False) -> Iterator[tuple[list[pa.Array], list[str | None], Shard]]:
    """(keys, texts, shard) of the documents (key, text) of a task, in shards of bounded size (a longer document is one by itself). Texts are kept only where spans are wanted."""
    get, keys, texts, ids, symbols, words = number.get, [], [], [], 0, 0
    for batch in batches:
        rows = batch.column(1)
        for i in range(0, len(rows), 256):  # a bounded part of a batch at a time
            part = rows.slice(i, 256)
            keys.append(batch.column(0).slice(i, 256))
            for at, raw in enumerate(part.cast(pa.binary()).to_pylist()):
                found = raw.translate(LOWERED).split() if raw else []
                x = np.fromiter(map(get, found, repeat(0)), np.int64, len(found)).astype(np.int32)
                symbols, words = symbols + int((x > 0).sum()), words + len(x)
                if spans:
                    texts.append(part[at].as_py())
                ids.append(x)
            if symbols >= SHARD_SYMBOLS or words >= SHARD_WORDS:
                yield keys, texts, Shard(ids, shortest, len(number))
                keys, texts, ids, symbols, words = [], [], [], 0, 0
    if keys:
        yield keys, texts, Shard(ids, shortest, len(number))
    del keys, texts, ids
    pa.default_memory_pool().release_unused()
    give_back()  # what shards took, before the worker's next stage


def _one_pass(docs: DataFrame, items: list[tuple[str, str | None]], size: int, spans: bool) -> DataFrame:
    """Documents indexed and searched for all items at once."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbered(t for _, t in shared.value)
        windows = Windows(shared.value, number, size)
        for keys, texts, shard in _sharded(batches, number, int(windows.lengths.min(initial=size)), spans):
            n = len(shard.counts)
            n_hit, items, ranges = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
            for d, hit, own in shard.found(windows):
                n_hit[d], items[d] = hit.sum(), own
                if spans:
                    ranges[d] = _spans(texts[d], hit)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(shard.counts), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(ranges, _SPAN)], names=["id", "n_words", "n_hit", "items", "spans"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, {SCHEMA}")


def _indexed(docs: DataFrame, number: dict[bytes, int], shortest: int) -> DataFrame:
    """(rows, n_words, shard): one row a shard of the documents (row, text), with its index."""
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, shard in _sharded(batches, shared.value, shortest):
            rows = pa.concat_arrays(keys).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([rows], pa.list_(pa.int64())), pa.array([shard.counts.tolist()], pa.list_(pa.int64())), pa.array([pickle.dumps(shard)], pa.binary())], names=["rows", "n_words", "shard"])

    return stored(docs.mapInArrow(run, "rows array<long>, n_words array<long>, shard binary"), "fmindex")


def _searched(indexes: DataFrame, windows: Windows) -> DataFrame:
    """(row, items, ranges): documents with an occurrence, their items and the ranges of hit words."""
    shared = indexes.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, found = batch.column(0)[k].as_py(), list(pickle.loads(batch.column(1)[k].as_py()).found(shared.value))
                ranges = [[{"start": a, "end": b} for a, b in _runs(hit)] for _, hit, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array([rows[d] for d, _, _ in found], pa.int64()), pa.array([x for _, _, x in found], pa.list_(pa.string())), pa.array(ranges, _SPAN)], names=["row", "items", "ranges"])

    return indexes.select("rows", "shard").mapInArrow(run, "row long, items array<string>, ranges array<struct<start:long,end:long>>")


def _groups(items: DataFrame, words: int, most: int) -> int:
    """How many groups the items (item, text) are divided into by hash so that none has more than `most` different words, or each item is by itself."""
    groups, n = 1, 0
    while words > most:  # `words` bounds the different ones
        each = items.select(F.pmod(F.xxhash64("item", "text"), F.lit(groups)).alias("g"), F.explode(F.regexp_extract_all("text", F.lit(WORD_ANY_CASE), F.lit(0))).alias("w")).select("g", F.translate("w", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("w"))
        if (each.groupBy("g").agg(F.countDistinct("w").alias("n")).agg(F.max("n")).first()[0] or 0) <= most:
            break
        n = n or items.count()
        if groups >= n:
            break
        groups *= 2
    return groups


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = SIZE, block_words: int = BLOCK_WORDS, vocabulary: int = VOCABULARY, spans: bool = True) -> DataFrame:
    """(id, n_words, n_hit, items, spans) for every document row: words, words inside an occurrence of any window, the items of those windows, and the hit words as merged code-point ranges (none if not wanted)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("string").alias("text"))
    # two bytes a word at least: an upper bound of the words, so a block fits block_words on average
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // (2 * block_words)
    if blocks == 1:
        return _one_pass(docs, [tuple(r) for r in items.collect()], size, spans)
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    groups = _groups(items, total // 2, vocabulary)
    each = -(-blocks // groups)
    h = F.xxhash64("item", "text")
    items = items.select("item", "text", F.pmod(h, F.lit(groups)).cast("int").alias("g"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(each)).cast("int").alias("b"))
    hits, lengths = None, None
    for g in range(groups):
        own = [items.where((F.col("g") == g) & (F.col("b") == b)) for b in range(each)]
        words = items.where(F.col("g") == g).select(F.explode(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))).alias("w")).distinct()
        number = {w.encode(): i for i, w in enumerate(sorted(r.w for r in words.collect()), 1)}
        n_words = F.size(F.regexp_extract_all("text", F.lit(WORD_ANY_CASE), F.lit(0)))
        shortest = items.where(F.col("g") == g).select(n_words.alias("n")).where("n > 0").agg(F.min("n")).first()[0] or size
        indexes = _indexed(docs.select("row", "text"), number, min(size, shortest))
        lengths = indexes if lengths is None else lengths
        for part in own:
            windows = Windows([(r.item, r.text) for r in part.collect()], number, size)
            one = stored(_searched(indexes, windows), "hits")  # a block's windows need not outlive its search
            hits = one if hits is None else hits.unionByName(one)
    merged = hits.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"))
    # ranges of different blocks may overlap: each adds what lies beyond those before it
    covered = F.aggregate("ranges", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")), lambda a: a["n"])
    merged = merged.select("row", "items", "ranges", covered.alias("n_hit"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    if spans:
        merged = docs.select("row", "text").join(merged, "row").mapInArrow(_united, "row long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")
    else:
        merged = merged.select("row", "n_hit", "items", none.alias("spans"))
    words = lengths.select(F.explode(F.arrays_zip("rows", "n_words")).alias("x")).select(F.col("x.rows").alias("row"), "x.n_words")
    found = docs.select("row", "id").join(words, "row").join(merged, "row", "left")
    return found.select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans"))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of words as merged ranges of code points."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            hit = np.zeros(max((x["end"] for x in r["ranges"]), default=0), bool)
            for x in r["ranges"]:
                hit[x["start"] : x["end"]] = True
            rows.append({"row": r["row"], "n_hit": r["n_hit"], "items": r["items"], "spans": _spans(r["text"], hit)})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("row", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _SPAN)]))


def contaminated():
    """The rule: a document is contaminated if hit words are at least a twentieth of its words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=False)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go. The rows' other columns travel with the key through the same pass."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    found = contamination(row, table(spark, sf_dir, "benchmark"), id_col="row", spans=False)
    return found.where(~contaminated()).select("id.*").select(*docs.columns)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


OP3_SQL = r"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
