import pytest
from oracle import same_rows

from packetlane.plans import analysis, catalog, drafts, forms, scans  # noqa: F401 - the others add their queries to the catalogue


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, data, name):
    same_rows(catalog.QUERIES[name](spark, str(data)), catalog.SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, str(data)).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
