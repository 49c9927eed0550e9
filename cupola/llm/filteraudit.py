"""Filter interaction audit by wide packed counters.

Filters run one after the other, in some order; a document is removed by the first one that it fails. What a filter
removes thus depends on those before it, and the audit states it for every order of the filters. A document's outcome
in all orders follows from its mask, the set of filters that it fails: a mask is one big integer with a field of FIELD
bits for every (order, step), 1 where that step removes it. Integers times counts are summed per part and task, then per
part: 600 additions are one. A field holds up to 2**64 - 1 rows, more than a table can have, so none flows into the next.

What a step keeps, what it removes and what it would have removed follow from the fields: a filter's failures are what
it removes as the first step, those of no other filter what it removes as the last. The same integers are summed over
the documents labelled good, and over those labelled toxic.

Copies: a document fails `E` if a document with a smaller id has the same text. Rows are first counted by (text hash, part,
labels) before they move, so a group of copies is a few rows a task; its smallest id is found among these.

Null texts are empty. A null id is neither smaller nor larger than another; rows of one id and text don't fail E. Of several
labels of one id any that says good, or toxic, counts. Null parts count as the empty one. An empty table gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cupola.llm.common import table

FILTERS = "ABCDE"
#: Bits of a field.
FIELD = 64
#: Parts that a task sums at once; with more it hands on what it has.
PARTS = 1024
_BLANKS = r"[ \t-\r]+"
_KINDS = ("n", "removed", "good", "toxic")


def failures(text: Column) -> list[Column]:
    """Whether a text fails the filters A to D: few words, few distinct words, many capitals, symbols."""
    words = F.array_remove(F.split(text, _BLANKS, -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """(part, mask, good, toxic, n): rows by part, labels and the filters that they fail, filter k as bit k of mask."""
    body = F.coalesce(F.col(text), F.lit(""))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures(F.col("_text")))), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), body.alias("_text"))
    rows = rows.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("hash"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    kept = ["hash", "part", "bits", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]]
    # rows of one id first, so that the smallest id of a group comes with its number of rows
    known = rows.join(marks, "doc_id", "left").groupBy("doc_id", *kept).agg(F.count("*").alias("n"))
    named = F.col("doc_id").isNotNull()
    groups = known.groupBy("hash", "part", "bits", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(~named, F.col("n")).otherwise(0)).alias("nameless"), F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"))
    groups = groups.withColumn("smallest", F.min("first.doc_id").over(Window.partitionBy("hash")))
    fine = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("bits").alias("mask"), fine.alias("n")), F.struct((F.col("bits") + 16).alias("mask"), (F.col("n") - fine).alias("n"))))
    return groups.select("part", "good", "toxic", split.alias("x")).select("part", "x.mask", "good", "toxic", "x.n").where("n > 0")


def packed(mask: int, filters: str = FILTERS) -> int:
    """The big integer of a mask."""
    out = 0
    for o, order in enumerate(permutations(range(len(filters)))):
        step = next((s for s, k in enumerate(order) if mask >> k & 1), None)
        if step is not None:
            out += 1 << FIELD * (o * len(filters) + step)
    return out


def _size(filters: str) -> int:
    return FIELD // 8 * len(filters) * len(list(permutations(filters)))


def sums(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, n, removed, good, toxic): of each part the rows and the summed integers, as little-endian bytes. rows as from masks()."""
    size = _size(filters)
    known = {m: packed(m, filters) for m in range(1 << len(filters))}

    def sent(held: dict[str, list[int]]) -> pa.RecordBatch:
        cols = [pa.array(held, pa.string()), pa.array([v[0] for v in held.values()], pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, *[pa.array([v[k].to_bytes(size, "little") for v in held.values()], pa.binary()) for k in (1, 2, 3)]], names=["part", *_KINDS])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        for batch in batches:
            for part, mask, good, toxic, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, x = held.setdefault(part, [0, 0, 0, 0]), n * known[mask]
                own[0] += n
                own[1] += x
                own[2] += x if good else 0
                own[3] += x if toxic else 0
            if len(held) > PARTS:
                yield sent(held)
                held = {}
        yield sent(held)

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, [0, 0, 0, 0]
        for batch in batches:
            for part, n, *fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and now is not None:
                    yield sent({now: own})
                    own = [0, 0, 0, 0]
                now = part
                own = [own[0] + n, *[a + int.from_bytes(b, "little") for a, b in zip(own[1:], fields, strict=True)]]
        if now is not None:
            yield sent({now: own})

    kind = "part string, n long, removed binary, good binary, toxic binary"
    # a task sends a row a part, so what meets in one place is as many rows as there are tasks; it streams, sorted by part
    return rows.select("part", "mask", "good", "toxic", "n").mapInArrow(first, kind).repartition("part").sortWithinPartitions("part").mapInArrow(then, kind)


def outcomes(summed: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for every part, order and step, unpacked from the summed integers."""
    k, orders = len(filters), list(permutations(range(len(filters))))
    order = np.array(orders)
    begins = {f: next(o for o, x in enumerate(orders) if x[0] == f) for f in range(k)}
    ends = {f: next(o for o, x in enumerate(orders) if x[-1] == f) for f in range(k)}
    names = ["".join(filters[f] for f in x) for x in orders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, *fields in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                gone, good, toxic = (np.frombuffer(x, f"<u{FIELD // 8}").astype(np.int64).reshape(order.shape) for x in fields)
                fails, alone, all_orders = (np.array([v[f] for f in range(k)]) for v in (
                    {f: gone[begins[f], 0] for f in range(k)}, {f: gone[ends[f], -1] for f in range(k)}, {f: gone[order == f].sum() for f in range(k)},
                ))
                cols = [n - gone.cumsum(1), gone, fails[order] - gone, alone[order], good, toxic, all_orders[order]]
                made = [pa.array([part] * order.size), pa.array(np.repeat(names, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))]
                yield pa.RecordBatch.from_arrays([*made, *[pa.array(c.ravel()) for c in cols]], names=["part", "filter_order", "step", *_COUNTS])

    return summed.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(sums(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
firsts AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS tox FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT *, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS ws FROM d),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(tox, false) AS tox,
    [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > m, false)] AS fails
  FROM w JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS ng, count(*) FILTER (WHERE tox) AS nt FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (
  SELECT p.k || q.k || r.k || s.k || u.k AS filter_order FROM x p, x q, x r, x s, x u
  WHERE len(list_distinct([p.k, q.k, r.k, s.k, u.k])) = 5),
e AS (
  SELECT part, filter_order, n, ng, nt, step, ascii(substr(filter_order, step, 1)) - 64 AS own,
    fails[ascii(substr(filter_order, step, 1)) - 64] AS bad, len(list_filter(range(1, step), lambda i: fails[ascii(substr(filter_order, i, 1)) - 64])) > 0 AS before,
    len(list_filter(fails, lambda y: y)) AS n_fails
  FROM c, o, (SELECT unnest(range(1, 6)) AS step)),
g AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
    coalesce(sum(n) FILTER (WHERE NOT before AND NOT bad), 0) AS kept, coalesce(sum(n) FILTER (WHERE bad AND NOT before), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE bad AND before), 0) AS redundant, coalesce(sum(n) FILTER (WHERE bad AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(ng) FILTER (WHERE bad AND NOT before), 0) AS good_lost, coalesce(sum(nt) FILTER (WHERE bad AND NOT before), 0) AS toxic_lost
  FROM e GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM g
"""
