"""Strings are worked on once each, by all tasks, however few files or distinct strings there are."""

import pytest
from pyspark.sql import functions as F

from cupola.functions import molecules
from cupola.functions import structure as S
from cupola.functions.columns import tokenizes
from cupola.operators import dictionary
from cupola.plans import registry


@pytest.mark.parametrize("name", ["reagent_split", "reaction_fingerprints", "changed_bonds_text", "neutral_pairs", "unreadable_filter"])
def test_rows_of_one_file_are_dealt_to_all_tasks(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).rdd.getNumPartitions() >= 16


def test_distinct_strings_are_worked_on_once(spark):
    rows = spark.createDataFrame([(i, None if i == 7 else "" if i == 8 else "C" * (1 + i % 3)) for i in range(40)], "id int, s string")
    seen = []

    def made(strings):
        seen.append((sorted(r.s for r in strings.select("s").collect()), strings.rdd.getNumPartitions()))
        return strings.withColumn("len", F.length("s"))

    found = {r.id: r.len for r in dictionary.once(rows, "s", made).collect()}
    assert found == {i: 0 if i in (7, 8) else 1 + i % 3 for i in range(40)}
    assert seen[0][0] == ["", "C", "CC", "CCC"] and seen[0][1] >= 16


def test_once_gives_what_each_row_gives(spark, sf):
    rows = registry.QUERIES["reagent_split"](spark, sf)
    from cupola.plans.queries import mapped_reactions

    plain = S.with_reagents(mapped_reactions(spark, sf), "rxn").drop("rxn")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("name, read_again", [("audit_author_containment", "lineitem"), ("author_doc_split", "lineitem"), ("cutoff_training_sets", "orders")])
def test_joined_rows_are_made_once(spark, sf, name, read_again):
    """What is read several times was written: the result's own plan doesn't join the tables once more."""
    files = registry.QUERIES[name](spark, sf.replace("sf0.001", "sf0.01")).inputFiles()
    assert not [f for f in files if f.endswith(f"{read_again}.parquet")]


def test_foreign_texts_are_told_before_their_tokens(spark):
    """Only texts that no tokens make up are told by their first words; what a bracket hides isn't."""
    texts = ["a b", "CC d", "C[x y]C", "[x y]C z", "CCl", "C\\nC", "CC]", "", None, "BrCH", "C%12CC%12", "C@?>*$~", "\n", "é", "C" * 50 + " "]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    found = rows.select("s", F.col("s").rlike(molecules.FOREIGN).alias("foreign"), tokenizes(F.col("s")).alias("whole"), molecules.readable(F.col("s")).alias("ok")).collect()
    assert not any(r.foreign and r.whole for r in found)
    assert {r.s for r in found if r.foreign} >= {"a b", "CC d", "CC]", "BrCH", "C" * 50 + " "}
    assert {r.s for r in found if r.ok} == {"CCl", "C\\nC", "C%12CC%12"}
