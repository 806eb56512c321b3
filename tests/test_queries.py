import pytest

from keyflow.plans import registry
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_sql(spark, folder, name):
    same(registry.queries()[name](spark, folder), connect(folder).sql(registry.oracle_sql()[name]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["window_start", "window_end", "key", "count", "avg_value"]
    assert set(registry.queries()) <= set(__spark_entry__.queries())
