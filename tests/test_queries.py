import pytest

import __spark_entry__ as entry
from cupola.plans import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, sf, name):
    if name in ("author_doc_split", "audit_author_containment"):  # the smallest tables have too few suppliers for its levels
        sf = sf.replace("sf0.001", "sf0.01")
    same(spark, sf, registry.QUERIES[name], registry.ORACLE_SQL[name])


#: Queries whose sets' sizes or shortfalls follow the tables'.
SIZED = ("time_split_assign", "time_set_sizes", "cutoff_training_sets", "train_size_control", "time_split_shortfalls", "author_doc_split", "audit_author_containment", "namerxn_split")


@pytest.mark.parametrize("name", SIZED)
def test_query_matches_its_sql_on_larger_tables(spark, sf, name):
    same(spark, sf.replace("sf0.001", "sf0.1"), registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["key", "doc", "name_rxn", "split"]
    assert df.count() > 0


def test_every_query_is_registered():
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
