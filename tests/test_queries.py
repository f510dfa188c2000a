"""Every registered query of the document engine against its SQL, or for its rows."""

import pytest

from quirelake.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, small, same_as_duckdb, name):
    same_as_duckdb(catalogue.QUERIES[name](spark, small), catalogue.ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows(spark, small, name):
    df = catalogue.QUERIES[name](spark, small)
    if "converted" in df.columns:
        assert df.where("error is not null or converted is null").count() == 0
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
