"""The keyed fold against one fold of all rows: batches of any cut, late files, restarts, repeated rows, nulls."""

import random

import pytest

from cupola.operators.dedup import survivors
from cupola.streaming import fold


def put(spark, path, rows):
    spark.createDataFrame(rows, fold.STATE).coalesce(1).write.parquet(path)


def run(spark, tmp_path, late=0):
    rows = spark.readStream.schema(fold.STATE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = fold.fold_stream(rows, str(tmp_path / "out"), str(tmp_path / "chk"), late)
    query.awaitTermination(120)
    return sorted(map(tuple, fold.current(spark, str(tmp_path / "out")).collect()), key=str)


def arrivals(n=60, seed=3):
    rnd = random.Random(seed)
    return [(rnd.choice("hhhab"), i, rnd.choice([None, "x", "y"]), rnd.choice([None, 1990, 1991, 2000])) for i in range(n)]


def test_late_files_restarts_and_repeats(spark, tmp_path):
    rows = arrivals()
    whole = spark.createDataFrame(rows, fold.STATE)
    want = sorted(map(tuple, survivors(whole, "key", "ord", "name_rxn", "year").select("key", "ord", "name_rxn", "year").collect()), key=str)
    parts = [rows[:20], rows[30:45], rows[20:30]]  # the third comes behind the second
    for i, part in enumerate(parts):
        put(spark, str(tmp_path / f"in/{i}"), part)
    run(spark, tmp_path, 40)
    # begun again from its checkpoint with one file more; rows seen before come again, and rows without key or order
    put(spark, str(tmp_path / "in/3"), [*rows[45:], *rows[40:44], (None, 3, "x", 1), ("h", None, "x", 1)])
    assert run(spark, tmp_path, 40) == want
    # nothing new: nothing changes
    assert run(spark, tmp_path, 40) == want


def test_arrivals_behind_what_is_settled_fail(spark, tmp_path):
    put(spark, str(tmp_path / "in/0"), [("k", 10, None, 1990), ("k", 11, "a", 2000)])
    assert run(spark, tmp_path) == [("k", 11, "a", 2000)]
    put(spark, str(tmp_path / "in/1"), [("k", 5, "b", 1980)])
    with pytest.raises(Exception, match="comes more than 0 behind 11"):
        run(spark, tmp_path)


def test_pending_arrivals_are_bounded(spark):
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    import pandas as pd

    state, out, rows = State(), [], arrivals(500)
    for i in range(0, 500, 25):
        frame = pd.DataFrame([("k", o, n, y) for _, o, n, y in rows[i : i + 25]], columns=["key", "ord", "name_rxn", "year"])
        out += [x for f in fold._fold_key(7, ("k",), iter([frame]), state) for x in f["ord"]]
        assert len(state.get[5]) <= 7
    plain = None
    for _, o, n, y in rows:
        plain = fold.later(plain, (o, n, y))
    assert out[-1] == plain[0] and len(set(out)) == len(out)
