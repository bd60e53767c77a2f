import pytest
from oracle import same_rows

from packetlane.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, data, name):
    same_rows(queries.QUERIES[name](spark, str(data)), queries.SQL[name], data)
