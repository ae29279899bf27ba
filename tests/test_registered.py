"""Every registered query against its SQL twin, and the contract of the entry points."""

import __spark_entry__ as entry
import compare
import pytest


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, sf_dir, name):
    why, _, _ = compare.differences(spark, con, name, sf_dir)
    assert not why


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["mean", "std", "auroc", "aurac", "balanced_acc"]
    assert df.count() == 1


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
