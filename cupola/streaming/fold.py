"""The displacement dedup over a stream of flat rows, with each key's survivor as keyed state.

State of a key: its settled survivor, the highest order it has seen, and its pending arrivals, those of the last `late`
positions of the order before that. An arrival may come that much behind a later one of its key and still be folded in its
place; arrivals further back are settled, in order, as the fold isn't associative. One that comes behind what is settled
can't be folded any more and fails the stream, so no row is dropped silently. An order number that is pending or settled last
already is the same arrival once more and changes nothing. State grows with keys, not with arrivals: a key holds at most
`late` pending ones, whatever its share of the rows.

A batch writes the keys whose survivor it changed, in a folder of its own that a repeated batch overwrites; `current` reads
the newest row of each key. So the cost of a batch follows the batch, not the table. Rows without a key or an order are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "key string, ord long, name_rxn string, year int"
#: has: whether anything is settled (ord, name, year); top: highest order seen; the arrays are the pending arrivals, in order.
HELD = "has boolean, ord long, name string, year int, top long, ords array<long>, names array<string>, years array<int>"

Arrival = tuple[int, str | None, int | None]


def later(cur: Arrival | None, new: Arrival) -> Arrival:
    """The survivor after one more arrival."""
    if cur is None or (new[1] is not None and cur[1] is None) or cur[2] is None or (new[2] is not None and new[2] < cur[2]):
        return new
    return cur


def _fold_key(late: int, key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A key's batch: sorted into its pending arrivals, settled up to `late` behind the highest, and its survivor if that changed."""
    has, order, name, year, top, ords, names, years = state.get if state.exists else (False, None, None, None, -1, [], [], [])
    settled: Arrival | None = (order, name, year) if has else None
    pending = dict(zip(ords, zip(names, years)))
    edge = top - late if top >= 0 else -1  # up to here all is settled
    before = settled
    for o in sorted(pending):
        before = later(before, (o, *pending[o]))
    for frame in frames:
        for o, n, y in zip(frame["ord"], frame["name_rxn"], frame["year"]):
            o = int(o)
            if o <= edge and not (settled and o == settled[0]):
                raise ValueError(f"arrival {o} of key {key[0]} comes more than {late} behind {top}")
            if o > edge:
                pending.setdefault(o, (None if pd.isna(n) else n, None if pd.isna(y) else int(y)))
    top = max([top, *pending])
    survivor = settled
    for o in sorted(pending):
        survivor = later(survivor, (o, *pending[o]))
        if o <= top - late:
            settled = survivor
            del pending[o]
    kept = sorted(pending)
    state.update((settled is not None, *(settled or (None, None, None)), top, kept, [pending[o][0] for o in kept], [pending[o][1] for o in kept]))
    if survivor is not None and survivor != before:
        yield pd.DataFrame({"key": [key[0]], "ord": [survivor[0]], "name_rxn": pd.Series([survivor[1]], dtype="object"), "year": pd.Series([survivor[2]], dtype="Int32")})


def survivors_of(rows: DataFrame, late: int = 0) -> DataFrame:
    """Of a streaming table (key, ord, name_rxn, year), in every batch the survivors that it changed."""
    sound = rows.where("key is not null and ord is not null").select("key", F.col("ord").cast("long").alias("ord"), "name_rxn", F.col("year").cast("int").alias("year"))
    fold = lambda key, frames, state: _fold_key(late, key, frames, state)
    return sound.groupBy("key").applyInPandasWithState(fold, STATE, HELD, "update", GroupStateTimeout.NoTimeout)


def fold_stream(rows: DataFrame, root: str, checkpoint: str, late: int = 0) -> StreamingQuery:
    """Starts the fold of a streaming table over all files that are there; begun again with the same checkpoint, it goes on where it was."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return survivors_of(rows, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, root: str) -> DataFrame:
    """(key, ord, name_rxn, year): the survivor of every key so far."""
    rows = spark.read.schema(f"{STATE}, batch long").parquet(root)
    newest = rows.groupBy("key").agg(F.max_by(F.struct("ord", "name_rxn", "year"), "batch").alias("s"))
    return newest.select("key", "s.ord", "s.name_rxn", "s.year")
