import oracle
import pytest

from lumidex.plans import registry

CONNECTION = None


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    global CONNECTION
    CONNECTION = CONNECTION or oracle.connect()
    oracle.same(registry.queries()[name](spark, oracle.DATA), registry.oracle_sql()[name], CONNECTION)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
